"""Byte-level BPE read from a tokenizers .json file: fast ids, bytes of every id, and special strings.

The ids equal those of the tokenizers library. Two engines stand behind `encode`: a rank-based one for
ordinary text and, for a text with a run of thousands of characters without a break, the library itself,
whose merging stays near-linear on such runs.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np

#: The word pattern of byte-level BPE (fixed value of this tokenizer family).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A run this long may go to the library; one half as long again does.
LONG_RUN = 1500
_RUN = re.compile(r"\S{%d}|\s{%d}" % (LONG_RUN, LONG_RUN))


def has_long_run(text: str) -> bool:
    """Whether a run of one kind, spaces or not, is so long that merging it by rank could take quadratic time."""
    for at in range(0, len(text) - LONG_RUN + 1, LONG_RUN // 2):
        stretch = text[at : at + LONG_RUN]
        if " " not in stretch or stretch.isspace():
            return _RUN.search(text) is not None
    return False


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, path: str):
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        letters = byte_alphabet()
        self.path = path
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.size = 1 + max(*self.ranks.values(), *self.special.values())
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, i in self.ranks.items():
            self.bytes_of[i] = token
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.lengths = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self._fast = tiktoken.Encoding("byte_bpe", pat_str=WORDS, mergeable_ranks=self.ranks, special_tokens=self.special)
        self._buffer = self._fast._core_bpe.encode_to_tiktoken_buffer
        self._allowed = set(self.special)

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.no_truncation()
        out.no_padding()
        return out

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text, uint32."""
        if has_long_run(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.frombuffer(self._buffer(text, self._allowed), dtype="<u4")

    def decode(self, ids) -> str:
        """As the library's decode(ids, skip_special_tokens=False): ids without bytes give nothing, broken UTF-8 gives U+FFFD."""
        try:
            raw = b"".join(map(self.bytes_of.__getitem__, ids))
        except IndexError:
            raw = b"".join([self.bytes_of[i] for i in ids if i < self.size])
        return raw.decode("utf-8", errors="replace")


@functools.lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    """One engine for each worker process."""
    return ByteBpe(path)
