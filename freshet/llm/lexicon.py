"""BPE encoding and decoding with a minimal acyclic transducer as its lexicon.

Frequent words are counted over the whole corpus, encoded, and compiled into an automaton that shares suffixes as
well as prefixes. Its arcs carry numbers that add up, along a word's path, to the word's rank among all words of
the lexicon; that rank leads to the word's ids. The automaton is one block of arrays; each worker maps it into memory from a
file without a name. A word that it doesn't hold is merged exactly, by rank.

Words are counted in two steps that need little traffic: a partition reports the words that make up at least
`SHARE` of its own words. A word with that share of the corpus has it in one partition at least, so none is
missed, and no more than 1 / SHARE words come from a partition. The lexicon decides how fast encoding is, never its result.

Cases: a null text is an empty one (no ids); an empty table gives an empty lexicon and no rows; repeated rows and null
ids each get their row; ties among frequent words go by the word; other columns are ignored. Special strings inside a
text become their ids, as the tokenizers library does by default. Texts are encoded whole, in groups of bounded size or
one by one; very long words go to the library, whose merging stays near-linear.
"""

from __future__ import annotations

import functools
import hashlib
import mmap
import os
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm import bytebpe
from freshet.llm.common import arrow_schema, map_rows, to_batch

SHARE = 1 / 100_000
WORDS = 50_000  # of the lexicon
WORD_BYTES = 48  # of a word of the lexicon; longer ones are merged
MEMO = 300_000  # words that a worker remembers; beyond it, those that aren't of the lexicon are let go


def frequent_words(df: DataFrame, text_col: str = "text", share: float = SHARE, words: int = WORDS) -> list[str]:
    """The most frequent space-separated words of the whole corpus, at most `words`."""
    schema = "word string, n long"
    arrow = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        total = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = text.split() if text else []
                total += len(found)
                seen.update(found)
                if len(seen) > 4 / share:
                    # Misra-Gries: the median is taken from all tallies. Half of them lose it whole, so a word loses
                    # less than share / 2 of the words read.
                    less = sorted(seen.values())[len(seen) // 2]
                    seen = Counter({w: n - less for w, n in seen.items() if n > less})
        least = share * total / 2
        rows = [(w, n) for w, n in seen.items() if n >= least and len(w) <= WORD_BYTES]
        if rows:
            yield to_batch({"word": [w for w, _ in rows], "n": [n for _, n in rows]}, arrow)

    counted = df.select(text_col).mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(words).collect()]  # at most `words` short strings


class Builder:
    """Incremental construction of the minimal automaton from words in ascending order of bytes."""

    def __init__(self) -> None:
        self.register: dict[tuple, int] = {}
        self.states: list[tuple] = []  # (final, ((byte, target), ...)) of finished states
        self.path: list[list] = [[False, []]]  # states still open, along the last word
        self.last = b""

    def _close(self, depth: int) -> None:
        while len(self.path) > depth + 1:
            final, arcs = self.path.pop()
            key = (final, tuple(arcs))
            at = self.register.get(key)
            if at is None:
                at = self.register[key] = len(self.states)
                self.states.append(key)
            self.path[-1][1].append((self.last[len(self.path) - 1], at))

    def add(self, word: bytes) -> None:
        same = len(os.path.commonprefix([word, self.last]))
        self._close(same)
        self.path += [[False, []] for _ in word[same:]]
        self.path[-1][0] = True
        self.last = word

    def finish(self) -> int:
        self._close(0)
        key = (self.path[0][0], tuple(self.path[0][1]))
        self.states.append(key)
        return len(self.states) - 1


def compile_lexicon(outputs: dict[bytes, list[int]]) -> bytes:
    """The transducer of `outputs` as one block: six sizes, then arrays."""
    builder = Builder()
    ordered = sorted(w for w in outputs if w)
    for word in ordered:
        builder.add(word)
    root = builder.finish()
    below: list[int] = []  # words that a state accepts; targets come before their sources
    keys, targets, adds, finals = [], [], [], []
    for state, (final, arcs) in enumerate(builder.states):
        count = int(final)
        for byte, target in arcs:
            keys.append(state << 8 | byte)
            targets.append(target)
            adds.append(count)
            count += below[target]
        below.append(count)
        finals.append(final)
    ids = [outputs[w] for w in ordered]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]) if ids else np.zeros(1)
    arrays = [keys, targets, adds, starts, list(chain.from_iterable(ids)), finals]
    return np.array([root, *map(len, arrays)], "<u4").tobytes() + b"".join(np.array(a, dtype="<u4").tobytes() for a in arrays)


class Lexicon:
    """Look-ups in a compiled transducer, many words at once.

    An arc's key is its state and byte; keys ascend, so that one binary search a byte moves all words on.
    """

    def __init__(self, block) -> None:
        root, *sizes = np.frombuffer(block, "<u4", 7).tolist()
        at, views = 28, []
        for n in sizes:
            views.append(np.frombuffer(block, "<u4", n, at))
            at += 4 * n
        self.root = root
        self.keys, self.targets, self.adds, self.starts, self.ids, self.finals = views

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Each word's rank among the lexicon's words; -1 for a word that it doesn't hold."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(sizes) - sizes
        state, rank = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        out = np.full(len(words), -1, np.int64)
        at = np.flatnonzero(sizes > 0) if len(self.keys) else np.empty(0, np.int64)
        depth = 0
        while len(at):
            key = (state[at] << 8 | data[begin[at] + depth]).astype(np.uint32)
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[arc] == key
            at, arc = at[found], arc[found]
            rank[at] += self.adds[arc]
            state[at] = self.targets[arc]
            depth += 1
            done = sizes[at] == depth
            ends = at[done]
            ends = ends[self.finals[state[ends]] == 1]
            out[ends] = rank[ends]
            at = at[~done]
        return out

    def get(self, word: bytes) -> tuple[int, ...] | None:
        rank = int(self.ranks([word])[0])
        return None if rank < 0 else tuple(self.ids[self.starts[rank] : self.starts[rank + 1]].tolist())


def mapped(block: bytes) -> Lexicon:
    """Map the block from a file in memory that has no name: it takes no folder and ends with the worker."""
    with open(os.memfd_create("lexicon"), "w+b") as f:
        f.write(block)
        f.flush()
        return Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


class Codec:
    """Words to ids through the lexicon, else by merging; remembers a bounded number of words, the lexicon's for good."""

    def __init__(self, bpe: bytebpe.ByteBpe, lexicon: Lexicon) -> None:
        import regex

        self.bpe, self.lexicon = bpe, lexicon
        self.words = regex.compile(bytebpe.WORDS).findall
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(bpe.special, key=len, reverse=True))) + ")") if bpe.special else None
        self.known: dict[str, bytes] = {}  # ids as little-endian uint32: joining them makes no number objects
        self.held: dict[str, bytes] = {}
        self.decimal = [str(i) for i in range(bpe.size)]

    def merge(self, raw: bytes) -> list[int]:
        """The ids of a word that the lexicon doesn't hold."""
        whole = self.bpe.ranks.get(raw)
        if whole is not None:
            return [whole]
        if len(raw) >= bytebpe.LONG_RUN:
            return self.bpe.library.encode(raw.decode("utf-8"), add_special_tokens=False).ids
        return self.bpe._fast._core_bpe.encode_single_piece(raw)

    def learn(self, words: set[str]) -> None:
        """Look up words that aren't known yet."""
        some = list(words)
        raws = [w.encode("utf-8") for w in some]
        ranks = self.lexicon.ranks(raws)
        starts, ids = self.lexicon.starts, self.lexicon.ids
        for i in np.flatnonzero(ranks >= 0).tolist():
            rank = ranks[i]
            self.known[some[i]] = self.held[some[i]] = ids[starts[rank] : starts[rank + 1]].tobytes()
        rest = np.flatnonzero(ranks < 0).tolist()
        merged = [self.merge(raws[i]) for i in rest]
        data = np.fromiter(chain.from_iterable(merged), np.uint32).astype("<u4").tobytes()
        at = 0
        for i, n in zip(rest, map(len, merged)):
            self.known[some[i]] = data[at : at + 4 * n]
            at += 4 * n

    def split(self, text: str) -> list[str | tuple[str]]:
        """The words of a text; a special string is a tuple, so that it equals no word."""
        if self.specials is None or not self.specials.search(text):
            return self.words(text)
        out: list[str] = []
        for i, part in enumerate(self.specials.split(text)):
            out += [(part,)] if i % 2 else self.words(part)
        return out

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in groups of bounded size."""
        for low, high in spans(texts):
            if len(self.known) > MEMO:
                self.known = dict(self.held)
            split = [self.split(t) for t in texts[low:high]]
            fresh = set().union(*split) - self.known.keys()
            specials = {w for w in fresh if isinstance(w, tuple)}
            self.learn(fresh - specials)
            self.known.update({w: np.array([self.bpe.special[w[0]]], "<u4").tobytes() for w in specials})
            get = self.known.__getitem__
            for words in split:
                yield np.frombuffer(b"".join(map(get, words)), "<u4")

    def decode(self, ids: list[int]) -> str:
        return self.bpe.decode(ids)

    def decimals(self, ids: list[int]) -> str:
        return ",".join(map(self.decimal.__getitem__, ids))


def spans(texts: list[str], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Stretches of texts of about `size` characters, or one longer text."""
    low, held = 0, 0
    for i, text in enumerate(texts):
        if i > low and held + len(text) > size:
            yield low, i
            low, held = i, 0
        held += len(text)
    if texts:
        yield low, len(texts)


def build(words: list[str], bpe: bytebpe.ByteBpe) -> bytes:
    """The compiled lexicon of the pieces of `words`, each as it stands after a space and at a line's start."""
    import regex

    pattern = regex.compile(bytebpe.WORDS)
    pieces = {p for w in words for form in (w, " " + w) for p in pattern.findall(form)}
    return compile_lexicon({raw: bpe._fast._core_bpe.encode_single_piece(raw) for p in pieces if len(raw := p.encode("utf-8")) <= WORD_BYTES})


@functools.lru_cache(maxsize=2)
def _codec(path: str, digest: str, block: bytes) -> Codec:
    return Codec(bytebpe.load(path), mapped(block))


def encode_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens and, as asked, ids (array of int), or digests of the ids and of the text decoded from them."""
    block = build(frequent_words(df, text_col), bytebpe.load(tokenizer))
    held = df.sparkSession.sparkContext.broadcast(block)  # at most WORDS words, each of bounded length
    digest = hashlib.sha256(block).hexdigest()
    schema = "doc_id long, n_tokens long" + ", ids_sha256 string, decoded_sha256 string" * digests + ", ids array<int>" * keep_ids

    def run(batch):
        codec = _codec(tokenizer, digest, held.value)
        out: dict[str, list] = {name.split()[0]: [] for name in schema.split(", ")}
        out["doc_id"] = batch.column(0)
        for ids in codec.encode([text or "" for text in batch.column(1).to_pylist()]):
            out["n_tokens"].append(len(ids))
            if digests:
                plain = ids.tolist()
                out["ids_sha256"].append(hashlib.sha256(codec.decimals(plain).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(codec.decode(plain).encode("utf-8")).hexdigest())
            if keep_ids:
                out["ids"].append(ids.astype(np.int32))
        return out

    return map_rows(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), schema, run)


def decode_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text of its ids; null ids give an empty text."""

    def run(batch):
        bpe = bytebpe.load(tokenizer)
        return {"doc_id": batch.column(0), "text": [bpe.decode(ids or []) for ids in batch.column(1).to_pylist()]}

    return map_rows(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")), "doc_id long, text string", run)
