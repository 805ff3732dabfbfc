"""Token-id output compressed by Re-Pair grammars.

Ids are written in blocks of whole documents, in ascending document order. In each block, frequent pairs of ids are
replaced by nonterminals, round after round, each round taking every pair that is left at least as often as the
round's limit, and rules are stored with the lengths they expand to. A document, or any stretch of ids, is read
by finding the symbols that cover it from the sums of their lengths and expanding only those.

A block's format: `base` (the first nonterminal's number), `rules` (pairs of uint32: a rule's symbols may be
nonterminals of earlier rules), `lengths` (uint32 per rule), `low` (uint16 per symbol) and `high` (for each further
bit of a symbol, one bit per symbol), `n_symbols`; beside them the documents' ids and where each begins.

Blocks are rows of a Parquet table in the shared folder, so Spark's commit protocol covers lost executors.

Cases: a null or empty text is the end id alone; an empty table has no blocks; repeated ids keep their rows, in the
order of their texts' hashes, null ids first, so that starts are the same in every run; a very long text is one document
of one block; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm import bytebpe
from freshet.llm.common import arrow_schema, materialise, shuffle_partitions, to_batch

END = 2
BLOCK_IDS = 1 << 20  # a block is closed at the first document end from here on
LIMITS = (256, 64, 24, 10)  # a round replaces the pairs that occur at least so often in a full block
_BUCKETS = 1 << 20

BLOCK_SCHEMA = "part int, block int, base int, rules binary, lengths binary, low binary, high binary, n_symbols int, doc_ids array<long>, starts array<long>, part_start long, n_ids long"


def _round(symbols: np.ndarray, least: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Replace every pair that occurs `least` times: the new symbols, and the pairs by number from `base`."""
    left, right = symbols[:-1], symbols[1:]
    bucket = ((left * np.uint32(2654435761)) ^ (right * np.uint32(2246822519))) >> np.uint32(12)
    counts = np.bincount(bucket, minlength=_BUCKETS)
    at = np.flatnonzero((counts >= least)[bucket])  # a bucket counts its pairs and maybe others: none is missed
    if not len(at):
        return symbols, np.empty((0, 2), np.uint32)
    keys = (left[at].astype(np.uint64) << np.uint64(32)) | right[at]
    order = np.argsort(keys, kind="stable")
    new = np.empty(len(keys), bool)
    new[0] = True
    new[1:] = keys[order][1:] != keys[order][:-1]
    group = np.cumsum(new) - 1
    size = np.bincount(group)
    number = np.empty(len(keys), np.int64)
    number[order] = group
    chosen = size[number] >= least
    at, number = at[chosen], number[chosen]
    if not len(at):
        return symbols, np.empty((0, 2), np.uint32)
    # Where chosen pairs overlap, every second one of the run is replaced.
    begins = np.empty(len(at), bool)
    begins[0] = True
    begins[1:] = np.diff(at) != 1
    run_start = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
    take = (np.arange(len(at)) - run_start) % 2 == 0
    at, number = at[take], number[take]
    used, compact = np.unique(number, return_inverse=True)
    pairs = keys[order][new][used]
    out = symbols.copy()
    out[at] = base + compact.astype(np.uint32)
    keep = np.ones(len(symbols), bool)
    keep[at + 1] = False
    return out[keep], np.stack([(pairs >> np.uint64(32)).astype(np.uint32), pairs.astype(np.uint32)], 1)


def compress(ids: np.ndarray, base: int, limits=LIMITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules (n, 2) and expansion lengths of a block of ids, all below `base`."""
    symbols = np.asarray(ids, np.uint32)
    rules = np.empty((0, 2), np.uint32)
    for least in limits:
        if len(symbols) < 2:
            break
        symbols, more = _round(symbols, least, base + len(rules))
        rules = np.concatenate([rules, more])
    return symbols, rules, rule_lengths(rules, base)


def rule_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """A rule refers to earlier rounds only, so a pass for each round fills all lengths."""
    lengths = np.zeros(len(rules), np.int64)
    known = np.zeros(len(rules), bool)
    while not known.all():
        size, ready = np.ones(rules.shape, np.int64), np.ones(rules.shape, bool)
        inner = rules >= base
        size[inner] = lengths[rules[inner] - base]
        ready[inner] = known[rules[inner] - base]
        now = ready.all(1) & ~known
        lengths[now] = size[now].sum(1)
        known |= now
    return lengths


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    symbols = np.asarray(symbols, np.uint32)
    while len(symbols):
        inner = symbols >= base
        if not inner.any():
            break
        width = 1 + inner.astype(np.int64)
        out = np.repeat(symbols, width)
        first = (np.cumsum(width) - width)[inner]
        pair = rules[symbols[inner] - base]
        out[first], out[first + 1] = pair[:, 0], pair[:, 1]
        symbols = out
    return symbols


def to_block(ids: np.ndarray, base: int, limits=LIMITS) -> dict:
    symbols, rules, lengths = compress(ids, base, limits)
    bits = max(16, int(symbols.max(initial=0)).bit_length())
    high = b"".join(np.packbits((symbols >> np.uint32(b)) & np.uint32(1)).tobytes() for b in range(16, bits))
    return {"base": base, "rules": rules.astype("<u4").tobytes(), "lengths": lengths.astype("<u4").tobytes(), "low": symbols.astype("<u2").tobytes(), "high": high, "n_symbols": len(symbols), "n_ids": len(ids)}


class Block:
    """A stored block, read at random."""

    def __init__(self, row: dict) -> None:
        n = row["n_symbols"]
        self.base = row["base"]
        self.symbols = np.frombuffer(row["low"], "<u2").astype(np.uint32)
        plane = (n + 7) // 8
        for b in range(len(row["high"]) // plane if plane else 0):
            self.symbols |= np.unpackbits(np.frombuffer(row["high"], np.uint8, plane, b * plane), count=n).astype(np.uint32) << np.uint32(16 + b)
        self.rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
        self.lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        # What every symbol expands to, one after another: an id to itself, then the rules.
        self.table = np.concatenate([np.arange(self.base, dtype=np.uint32), expand(np.arange(self.base, self.base + len(self.rules)), self.rules, self.base)])
        self.size = np.concatenate([np.ones(self.base, np.int64), self.lengths])
        self.first = np.cumsum(self.size) - self.size
        self.ends = np.cumsum(self.size[self.symbols])

    def read(self, start: int, end: int) -> np.ndarray:
        """Ids start..end of the block; only the symbols that cover them are expanded."""
        if end <= start:
            return np.empty(0, np.uint32)
        i, j = np.searchsorted(self.ends, [start, end - 1], "right")
        begin = int(self.ends[i - 1]) if i else 0
        symbols = self.symbols[i : j + 1]
        before = np.append(begin, self.ends[i:j]) - begin
        at = np.repeat(self.first[symbols] - before, self.size[symbols]) + np.arange(int(self.ends[j]) - begin)
        return self.table[at][start - begin : end - begin]


def write_blocks(df: DataFrame, tokenizer: str, end: int = END, block_ids: int = BLOCK_IDS, limits=LIMITS, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode the documents in ascending order of their ids and store them; returns the stored table."""
    arrow = arrow_schema(df.sparkSession, BLOCK_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bytebpe.load(tokenizer)
        part, number, part_start = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        doc_ids: list = []
        starts: list[int] = []
        n = 0

        def close() -> pa.RecordBatch:
            row = to_block(np.concatenate(held), bpe.size, limits) | {"part": part, "block": number, "doc_ids": doc_ids, "starts": starts, "part_start": part_start}
            return to_batch({name: [row[name]] for name in arrow.names}, arrow)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = np.append(bpe.encode(text.as_py() or ""), np.uint32(end))
                doc_ids.append(doc_id.as_py())
                starts.append(n)
                held.append(ids)
                n += len(ids)
                if n >= block_ids:
                    yield close()
                    part_start, number = part_start + n, number + 1
                    held, doc_ids, starts, n = [], [], [], 0
        if held:
            yield close()

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # Rows of one id go by their texts. Rows with the same id and text are alike: their number only keeps them from one range.
    order = ["doc_id", "_h1", "_h2", "_row"]
    keyed = rows.select("*", F.xxhash64("text").alias("_h1"), F.xxhash64(F.lit(7), "text").alias("_h2"), F.monotonically_increasing_id().alias("_row"))
    ordered = keyed.repartitionByRange(partitions or shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order).select("doc_id", "text")
    return materialise(ordered.mapInArrow(run, BLOCK_SCHEMA), "grammar-blocks")


def read_documents(blocks: DataFrame, keep_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, as asked, ids, from stored blocks."""
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = totals.selectExpr("part", "coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0) as base")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids
    arrow = arrow_schema(blocks.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                block, first = Block(row), row["base_ids"] + row["part_start"]
                whole = block.read(0, row["n_ids"]).astype("<u4")
                starts = row["starts"] + [row["n_ids"]]
                pieces = [whole[a:b] for a, b in zip(starts, starts[1:])]
                out = {"doc_id": row["doc_ids"], "start": [first + a for a in row["starts"]], "n_tokens": [len(p) for p in pieces], "ids_crc32": [zlib.crc32(p.tobytes()) for p in pieces]}
                if keep_ids:
                    out["ids"] = [p.astype(np.int32) for p in pieces]
                yield to_batch(out, arrow)

    # One row for each partition that was written, as many as write_blocks was given.
    return blocks.join(F.broadcast(base.withColumnRenamed("base", "base_ids")), "part").mapInArrow(run, schema)
