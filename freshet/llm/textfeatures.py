"""Counts and hashed n-grams of many texts at once, on arrays of code points.

Texts are joined with a newline between them and handled in groups of bounded size. A polynomial hash of every
stretch follows from running sums, so words, lines, word n-grams and character n-grams cost a few array operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

GROUP = 1 << 18  # code points handled at once, or one longer text
BITS = 17  # hashed features: 2 ** BITS for words and as many for characters
CHAR_GRAMS = (2, 4)
DENSE = 8
DIM = 2 * (1 << BITS) + DENSE

_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
_SYMBOLS = np.zeros(128, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_SPACE = np.zeros(128, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_P, _P_INVERSE)):
            table = np.full(max(n, GROUP + 64), base, np.uint64)
            table[0] = 1
            _powers[i] = np.cumprod(table)  # modulo 2 ** 64
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@dataclass
class Group:
    """Some texts; every array has one entry for each text, or each word with the number of its text."""

    n: int
    points: np.ndarray
    text_of: np.ndarray  # of each code point
    sums: np.ndarray
    starts: np.ndarray  # of words
    ends: np.ndarray
    word_text: np.ndarray
    word_hash: np.ndarray
    text_starts: np.ndarray
    text_ends: np.ndarray

    def stretch_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * _powers[1][starts])


def groups(texts: list[str | None]) -> Iterator[tuple[int, Group]]:
    """Groups of consecutive texts, with the number of the first."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        text = text or ""
        if held and size + len(text) > GROUP:
            yield first, make_group(held)
            first, held, size = i, [], 0
        held.append(text)
        size += len(text) + 1
    if held:
        yield first, make_group(held)


def make_group(texts: list[str]) -> Group:
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    lengths = np.array([len(t) + 1 for t in texts])
    text_ends = np.cumsum(lengths)
    text_starts = text_ends - lengths
    powers, _ = _power_tables(len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points + np.uint32(1)).astype(np.uint64) * powers[: len(points)], out=sums[1:])
    low = np.minimum(points, 127).astype(np.uint8)
    inside = np.ones(len(points) + 2, np.int8)
    inside[0] = 0
    inside[1:-1] = ~_SPACE[low]
    inside[-1] = 0
    change = np.diff(inside)
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    text_of = np.repeat(np.arange(len(texts)), lengths)
    group = Group(len(texts), points, text_of, sums, starts, ends, text_of[starts] if len(starts) else starts, starts, text_starts, text_ends - 1)
    group.word_hash = group.stretch_hash(starts, ends)
    return group


def per_text(text: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(text, weights=weights, minlength=n)


def repeated(text: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur more than once in their text, and which of them aren't the first there."""
    both = mix(keys + text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(both, kind="stable")
    ordered = both[order]
    same = np.zeros(len(keys), bool)
    same[1:] = ordered[1:] == ordered[:-1]
    many = same.copy()
    many[:-1] |= same[1:]
    out, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    out[order], later[order] = many, same
    return out, later


@dataclass
class Counts:
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray


def counts(g: Group) -> Counts:
    n_words = per_text(g.word_text, g.n)
    word_chars = per_text(g.word_text, g.n, g.ends - g.starts).astype(np.int64)
    symbols = np.flatnonzero(_SYMBOLS[np.minimum(g.points, 127)])
    n_symbols = per_text(g.text_of[symbols], g.n)

    breaks = np.flatnonzero(g.points == 10)  # a text's end is one too
    line_starts = np.concatenate([[0], breaks[:-1] + 1])
    has_word = np.diff(np.searchsorted(g.starts, np.append(line_starts, len(g.points)))) > 0
    line_starts, breaks = line_starts[has_word], breaks[has_word]
    _, later = repeated(g.text_of[line_starts], g.stretch_hash(line_starts, breaks))
    n_dup_lines = per_text(g.text_of[line_starts][later], g.n)

    n_repeat = np.zeros(g.n, np.int64)
    if len(g.starts) >= 3:
        h = g.word_hash
        window = h[:-2] * np.uint64(3) + mix(h[1:-1]) * np.uint64(5) + mix(mix(h[2:])) * np.uint64(7)
        whole = g.word_text[:-2] == g.word_text[2:]
        many = np.zeros(len(h) - 2, bool)
        many[whole], _ = repeated(g.word_text[:-2][whole], window[whole])
        covered = np.zeros(len(h), bool)
        for i in range(3):
            covered[i : len(h) - 2 + i] |= many
        n_repeat = per_text(g.word_text[covered], g.n)
    return Counts(n_words, word_chars, n_symbols, n_dup_lines, n_repeat)


def features(g: Group, c: Counts) -> list[tuple[np.ndarray, np.ndarray]]:
    """Families of hashed features as (text, feature number) of each occurrence; each family is averaged over a text."""
    half = np.uint64((1 << BITS) - 1)
    h = g.word_hash
    pair = mix(h[:-1] * np.uint64(3) + mix(h[1:])) if len(h) > 1 else h[:0]
    inside = g.word_text[:-1] == g.word_text[1:] if len(h) > 1 else np.zeros(0, bool)
    same = h[:-1] == h[1:] if len(h) > 1 else inside
    pair = np.where(same, np.uint64(1), pair)  # a word said twice is one feature, whichever word
    words = (np.concatenate([g.word_text, g.word_text[:-1][inside]]), (np.concatenate([h, pair[inside]]) & half).astype(np.int64))
    texts, numbers = [], []
    for size in CHAR_GRAMS:
        starts = np.arange(max(0, len(g.points) - size))
        starts = starts[g.text_of[starts] == g.text_of[starts + size]]
        texts.append(g.text_of[starts])
        numbers.append(((g.stretch_hash(starts, starts + size) + np.uint64(size)) & half).astype(np.int64) + (1 << BITS))
    return [words, (np.concatenate(texts), np.concatenate(numbers))]


def dense(g: Group, c: Counts) -> np.ndarray:
    """Shares that n-grams can't show, between 0 and about 1: (texts, DENSE)."""
    size = np.maximum(1, g.text_ends - g.text_starts)
    words = np.maximum(1, c.n_words)
    low = np.minimum(g.points, 127)
    of = lambda mask: per_text(g.text_of[mask], g.n)
    upper = of((low >= 65) & (low <= 90))
    digits = of((low >= 48) & (low <= 57))
    marks = of((low > 32) & (low < 127) & ~((low >= 48) & (low <= 57)) & ~((low >= 65) & (low <= 90)) & ~((low >= 97) & (low <= 122)))
    _, later = repeated(g.word_text, g.word_hash) if len(g.starts) else (None, np.zeros(0, bool))
    again = per_text(g.word_text[later], g.n)
    return np.stack([c.n_repeat_words / words, c.n_symbols / size, upper / size, digits / size, marks / size, c.n_dup_lines / words, again / words, np.minimum(1, np.log1p(c.n_words) / 10)], 1)


SCALE = 8.0  # of a family's averages, so that common features are of the size of the dense ones


def linear(g: Group, c: Counts, weights: np.ndarray, families: list | None = None, shares: np.ndarray | None = None) -> np.ndarray:
    """The product of each text's features with `weights` (DIM of them); `features` and `dense` may be given."""
    out = (dense(g, c) if shares is None else shares) @ weights[-DENSE:]
    for text, number in features(g, c) if families is None else families:
        total = per_text(text, g.n, weights[number])
        out += SCALE * total / np.maximum(1, per_text(text, g.n))
    return out


UNIT = float(1 << 32)  # one, in sums that must not depend on the order of texts


def back(g: Group, families: list, shares: np.ndarray, of_text: np.ndarray) -> np.ndarray:
    """The product of the transposed features with `of_text` (at most 1/4), in whole `UNIT`ths: a group's sums stay below 2 ** 53, so they are exact."""
    out = np.zeros(DIM)
    for text, number in families:
        each = np.rint(SCALE * UNIT * of_text / np.maximum(1, per_text(text, g.n)))
        out += np.bincount(number, weights=each[text], minlength=DIM)
    out[-DENSE:] += np.rint(UNIT * shares * of_text[:, None]).sum(0)
    return out.astype(np.int64)


def sparse(g: Group, c: Counts) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text, its feature numbers and their values."""
    parts = []
    for text, number in features(g, c):
        key, n = np.unique(text.astype(np.int64) * DIM + number, return_counts=True)
        at = key // DIM
        parts.append((at, key % DIM, SCALE * n / np.maximum(1, per_text(text, g.n))[at]))
    shares = dense(g, c)
    at, column = np.nonzero(shares)
    parts.append((at, DIM - DENSE + column, shares[at, column]))
    text, number, value = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.argsort(text, kind="stable")
    cut = np.searchsorted(text[order], np.arange(1, g.n))
    return list(zip(np.split(number[order].astype(np.int32), cut), np.split(value[order].astype(np.float32), cut)))
