"""Token counts by overlap resynchronisation.

A document longer than a chunk is encoded in overlapping chunks with byte offsets. Two chunks are spliced at
a boundary that both have and that is *proven stable*: a white-space byte (space or newline) right after a
visible ASCII character. The word pattern never looks back and can hold such a white-space byte only as the
first character of a word, so every encoding starts a new word there, whatever lies before. A left chunk's
boundaries within `GUARD` bytes of its end aren't used: what follows could still change them. When an
overlap holds no such boundary it is widened, at last to the whole chunk, and then the chunk grows.

Cases: null text counts as empty (0 tokens); an empty table gives no rows; repeated rows and null ids each get their
row; texts of any length are counted whole, chunk by chunk; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm import bytebpe
from freshet.llm.common import map_rows

CHUNK = 1 << 15  # bytes of text in a chunk
OVERLAP = 512  # bytes that neighbouring chunks share at first
GUARD = 16  # no boundary this near to a chunk's cut end is trusted
LIMIT = 512


def _cut(data: bytes, at: int) -> int:
    """The nearest start of a UTF-8 character at or before `at`."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def stable(data: bytes, at: np.ndarray) -> np.ndarray:
    """Which of the positions `at` (over 0) are boundaries in every encoding."""
    raw = np.frombuffer(data, np.uint8)
    here, before = raw[at], raw[at - 1]
    return ((here == 32) | (here == 10)) & (before > 32) & (before < 127)


def encode_chunked(text: str, bpe: bytebpe.ByteBpe, chunk: int = CHUNK, overlap: int = OVERLAP):
    """Yield the ids of `text` piece by piece; together they equal bpe.encode(text)."""
    data = text.encode("utf-8")
    n, start, size = len(data), 0, chunk
    ids = None  # of data[start:end], cut to begin at start
    end = 0
    while True:
        if ids is None:
            end = _cut(data, min(n, start + size))
            ids = bpe.encode(data[start:end].decode("utf-8"))
        if end >= n:
            yield ids
            return
        ends = start + np.cumsum(bpe.lengths[ids])
        wide, joined = overlap, False
        while True:
            low = _cut(data, max(start, end - wide))
            right_end = _cut(data, min(n, low + max(chunk, 2 * wide)))
            right = bpe.encode(data[low:right_end].decode("utf-8"))
            right_starts = low + np.concatenate([[0], np.cumsum(bpe.lengths[right])[:-1]]).astype(np.int64)
            common = np.intersect1d(ends, right_starts)
            common = common[(common > max(low, start)) & (common <= end - GUARD)]
            common = common[stable(data, common)] if len(common) else common
            if len(common):
                at = int(common[-1])
                yield ids[: int(np.searchsorted(ends, at)) + 1]
                ids, start, end = right[int(np.searchsorted(right_starts, at)) :], at, right_end
                joined, size = True, chunk
                break
            if low <= start:
                break
            wide *= 2
        if not joined:  # no boundary in the whole chunk: a longer one
            size = 2 * max(size, end - start)
            ids = None


def count(text: str, bpe: bytebpe.ByteBpe, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    if len(text) <= chunk // 4:
        return len(bpe.encode(text))
    return sum(len(ids) for ids in encode_chunked(text, bpe, chunk, overlap))


def token_counts(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of `df`."""

    def run(batch):
        bpe = bytebpe.load(tokenizer)
        texts = batch.column(1).to_pylist()
        tokens = [count(t, bpe, chunk, overlap) if t else 0 for t in texts]
        return {"doc_id": batch.column(0), "n_bytes": batch.column(2), "n_tokens": tokens, "over_limit": [n > limit for n in tokens]}

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    return map_rows(rows, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", run)
