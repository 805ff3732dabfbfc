"""Removal of long repeated passages: bytes of strings of 50 bytes that a document with a smaller id has too (op11).

The suffixes of all documents are brought together in buckets, which are sorted one at a time, so that a task's memory is
that of a bucket. Most suffixes never go there: a difference cover decides first.

* The cover is a set D of residues modulo a period v such that any two positions meet both in D after the same d < v
  steps. Two suffixes that have `length` bytes in common therefore meet at two positions of the cover that have
  length - v + 1 bytes in common. Only the cover's positions, four of thirteen, are ranked in advance: their strings are
  sorted by buckets, and those found in a single document drop out.
* A suffix with no ranked position of the cover within its first v bytes can't have a long tie. The others, the
  candidates, are sorted in buckets by their first `length` bytes; a tie is a repeat.

Documents are held in blocks of a few MB in the order of their ids, so that a string's first document lies in its first
block. A block sends each of its strings once, however often it holds them: a passage of very many documents comes to
its bucket once for each block. Back comes one bit for each string. Strings are known by a name of 64 bits (cover's
strings by 32 bits in their bucket: a false tie there only makes a candidate more), candidates by 64 bits and the
bucket, which is drawn independently.

Cases: null texts are empty; documents without an id, and texts shorter than `length`, lose nothing, and those without
an id take nothing from others; rows of the same id don't take from each other, and make one block together; equal texts of
other ids lose all but the first; an empty table gives no rows; bytes, not characters, are removed, so what is kept need not be valid UTF-8; columns
other than id and text are not read. A text is held whole by its task, with about 40 bytes of memory for each of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import arrow_schema, materialise, to_batch
from freshet.scratch import scope, tidy_shuffles

LENGTH = 50
#: Period and residues of perfect difference sets (fixed values).
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}
PERIOD = 13
#: Bytes of text in a block; strings in a bucket.
BLOCK_BYTES = 2 << 20
BUCKET = 1 << 21
#: Positions that are named at once.
STRETCH = 1 << 16

_BLOCK = "block long, doc_ids array<long>, lengths array<int>, n_bytes long, bytes binary"
_SENT = "bucket int, block long, names binary"
_BACK = "bucket int, block long, bits binary"

_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def _mixed(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """64 bits from an ordered pair of 64 bits."""
    x = a * _K[seed] + (b ^ (b >> np.uint64(31))) * _K[seed + 1]
    x ^= x >> np.uint64(32)
    x *= _K[seed + 2]
    x ^= x >> np.uint64(29)
    return x


def _names_of(buf: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    x = buf.astype(np.uint64)
    width = 1
    while width < 8 and 2 * width <= length:  # bytes one after another
        x = x[:-width] | (x[width:] << np.uint64(8 * width))
        width *= 2
    seed = 0
    while 2 * width <= length:
        x = _mixed(x[:-width], x[width:], seed % 3)
        width *= 2
        seed += 1
    rest = length - width
    a, b = x[: len(x) - rest], x[rest:]
    return _mixed(a, b, 2), _mixed(b, a, 3)


def names(buf: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of the string of `length` bytes at each position of `buf` (uint8) that has so many."""
    n = len(buf) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    pieces = [_names_of(buf[at : min(at + STRETCH, n) + length - 1], length) for at in range(0, n, STRETCH)]
    return np.concatenate([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces])


def _bits_for(strings: int, least: int) -> int:
    """As many leading bits as make buckets of at most BUCKET strings on average, and `least` buckets."""
    return max(int(least - 1).bit_length(), int(-(-strings // BUCKET) - 1).bit_length() if strings > BUCKET else 0)


def _packed(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True) if size else b"", np.uint8)


def coded(names: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as their differences, each in as many bytes as the largest of these needs."""
    steps = np.diff(names, prepend=np.uint64(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def decoded(data: bytes) -> np.ndarray:
    width = data[0]
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    steps = np.zeros((len(raw), 8), np.uint8)
    steps[:, :width] = raw
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


class Block:
    """Documents one after another, as stored in a row."""

    def __init__(self, row: dict) -> None:
        self.row = row
        self.buf = _unpacked(row["bytes"], row["n_bytes"])
        self.lengths = np.asarray(row["lengths"], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        self.ids = np.asarray(row["doc_ids"], np.int64)

    def room(self) -> np.ndarray:
        """For each position, the bytes of its document from there on."""
        return np.repeat(self.ends, self.lengths) - np.arange(len(self.buf))

    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids), dtype=np.int32), self.lengths)

    def cover(self, length: int, period: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the cover that have length - period + 1 bytes in their document, and the strings' names."""
        size = length - period + 1
        step = np.arange(len(self.buf)) - np.repeat(self.starts, self.lengths)
        chosen = np.zeros(period, bool)
        chosen[list(COVERS[period])] = True
        at = np.flatnonzero(chosen[step % period] & (self.room() >= size))
        return at, names(self.buf, size)[0][at] if len(at) else np.zeros(0, np.uint64)


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None) -> DataFrame:
    """The documents that have an id, in the order of their ids, in blocks that are named by their first id."""
    arrow = arrow_schema(docs.sparkSession, _BLOCK)
    full = block_bytes or BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        texts: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            return to_batch({"block": [ids[0]], "doc_ids": [ids], "lengths": [[len(t) for t in texts]], "n_bytes": [size], "bytes": [_packed(b"".join(texts))]}, arrow)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                if size >= full and doc_id != ids[-1]:
                    yield close()
                    ids, texts, size = [], [], 0
                ids.append(doc_id)
                texts.append(text.as_py() or b"")
                size += len(texts[-1])
        if ids:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    return rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, _BLOCK)


def _by_bucket(block: int, names: np.ndarray, buckets: np.ndarray, bits: int, narrow: bool) -> Iterator[dict]:
    """A row for each bucket of `names`, which are sorted by bucket and name."""
    if not len(names):
        return
    first = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
    for a, b in zip(first, np.append(first[1:], len(names))):
        part = ((names[a:b] << np.uint64(bits)) >> np.uint64(32)).astype("<u4").tobytes() if narrow else coded(names[a:b])
        yield {"bucket": int(buckets[a]), "block": block, "names": part}


def _leading(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(x), np.int64)


def _rows(dicts: list[dict], arrow: pa.Schema) -> pa.RecordBatch:
    return to_batch({name: [d[name] for d in dicts] for name in arrow.names}, arrow)


def _strings(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By the `keys`, least weighty first: the number of each row's string, and the first and last row of each string, strings in order."""
    order = np.lexsort(keys) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    for key in keys:
        new[1:] |= key[order[1:]] != key[order[:-1]]
    new[:1] = True
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return which, order[new], order[np.append(new[1:], True)] if len(order) else order


def _cover_strings(block: Block, length: int, period: int, bits: int) -> tuple[np.ndarray, ...]:
    """The block's cover: positions, the number of each one's string, each string's first and last row; the strings, sorted, and their buckets."""
    at, name = block.cover(length, period)
    which, first, last = _strings(name)
    return at, which, first, last, name[first], _leading(name[first], bits)


def _suffixes(block: Block, candidate: np.ndarray, length: int, bits: int) -> tuple[np.ndarray, ...]:
    """The block's candidates: positions, the number of each one's string, each string's first row; the strings, sorted by bucket and name, and their buckets."""
    at = np.flatnonzero(candidate)
    name, other = (x[at] for x in names(block.buf, length)) if len(at) else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    bucket = _leading(other, bits)
    which, first, _ = _strings(name, bucket)
    return at, which, first, name[first], bucket[first]


def _told(row: dict, buckets: np.ndarray) -> np.ndarray:
    """The bits that came back for a block's strings, in the strings' order."""
    out = np.zeros(len(buckets), bool)
    for back in row["back"] or ():
        a, b = np.searchsorted(buckets, [back["bucket"], back["bucket"] + 1])
        out[a:b] = np.unpackbits(np.frombuffer(back["bits"], np.uint8), count=b - a).astype(bool)
    return out


def _ties(parts: list[np.ndarray], first_too: bool) -> list[np.ndarray]:
    """For each string of each part (none twice in a part) whether an earlier part has it too, or with `first_too` any other part."""
    joined = np.concatenate(parts)
    order = np.argsort(joined, kind="quicksort" if first_too else "stable")
    same = joined[order[1:]] == joined[order[:-1]]
    tie = np.zeros(len(joined), bool)
    tie[order[1:]] = same
    if first_too:
        tie[order[:-1]] |= same
    return np.split(tie, np.cumsum([len(p) for p in parts])[:-1])


def _shared(table: pa.Table) -> pa.Table:
    """One bucket of the cover's strings: a bit for each that another block has too."""
    return _back(table, _ties([np.frombuffer(x.as_py(), "<u4") for x in table["names"].combine_chunks()], True))


def _repeated(table: pa.Table) -> pa.Table:
    """One bucket of suffixes: a bit for each string that an earlier block has."""
    table = table.take(pa.array(np.argsort(table["block"].to_numpy(), kind="stable")))
    return _back(table, _ties([decoded(x.as_py()) for x in table["names"].combine_chunks()], False))


def _back(table: pa.Table, bits: list[np.ndarray]) -> pa.Table:
    told = [i for i, b in enumerate(bits) if b.any()]
    at = pa.array(told, pa.int64())
    return pa.table({"bucket": table["bucket"].take(at), "block": table["block"].take(at), "bits": pa.array([np.packbits(bits[i]).tobytes() for i in told], pa.binary())})


def _replies(sent: DataFrame, answer: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """What the buckets of `sent` answer each block: block and back. They are written, so that what was sent can go."""
    replies = sent.groupBy("bucket").applyInArrow(answer, _BACK)
    return materialise(replies.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("back")), "repeats-replies")


def _each(df: DataFrame, schema: str, fn) -> DataFrame:
    """Rows (dicts) that `fn` makes of each block's row."""
    arrow = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                out = list(fn({name: batch.column(name)[i].as_py() for name in batch.schema.names}))
                if out:
                    yield _rows(out, arrow)

    return df.mapInArrow(run, schema)


def removed(docs: DataFrame, length: int = LENGTH, period: int = PERIOD, id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (start, end of each removed run, in bytes) and kept (the bytes that remain) of every document."""
    if not 1 <= period <= length:
        raise ValueError("the cover's period must not exceed the length of repeats")
    spark = docs.sparkSession
    least = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def cover_sent(bits: int):
        def of(row: dict) -> Iterator[dict]:
            *_, strings, buckets = _cover_strings(Block(row), length, period, bits)
            return _by_bucket(row["block"], strings, buckets, bits, narrow=True)

        return of

    def candidates(bits: int):
        def of(row: dict) -> Iterator[dict]:
            block = Block(row)
            at, which, first, last, strings, buckets = _cover_strings(block, length, period, bits)
            # Strings of two documents of the block are ranked by the block itself.
            doc = block.document()[at]
            ranked = _told(row, buckets) | (doc[first] < doc[last])
            n = len(block.buf)
            up_to = np.zeros(n + period, np.int32)
            up_to[1 + at[ranked[which]]] = 1
            up_to[: n + 1].cumsum(out=up_to[: n + 1])
            up_to[n + 1 :] = up_to[n]
            near = (up_to[period:] > up_to[:-period]) & (block.room() >= length)
            yield {name: row[name] for name in ("block", "doc_ids", "lengths", "n_bytes", "bytes")} | {"n_candidates": int(near.sum()), "candidates": _packed(np.packbits(near).tobytes())}

        return of

    def near_of(block: Block) -> np.ndarray:
        return np.unpackbits(_unpacked(block.row["candidates"], (len(block.buf) + 7) // 8), count=len(block.buf)).astype(bool)

    def suffixes_sent(bits: int):
        def of(row: dict) -> Iterator[dict]:
            block = Block(row)
            *_, strings, buckets = _suffixes(block, near_of(block), length, bits)
            return _by_bucket(row["block"], strings, buckets, bits, narrow=False)

        return of

    def cut_out(bits: int):
        def of(row: dict) -> Iterator[dict]:
            block = Block(row)
            at, which, first, _, buckets = _suffixes(block, near_of(block), length, bits)
            own = block.ids[block.document()[at]]
            # Documents go by their ids, so a string's first row has its least one.
            goes = at[_told(row, buckets)[which] | (own[first][which] < own)]
            steps = np.zeros(len(block.buf) + 1, np.int32)
            steps[goes] += 1
            steps[goes + length] -= 1
            gone = np.cumsum(steps[:-1]) > 0
            for doc_id, a, b in zip(block.ids.tolist(), block.starts.tolist(), block.ends.tolist()):
                mask = gone[a:b]
                edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
                yield {"doc_id": doc_id, "n_bytes": b - a, "n_removed": int(mask.sum()), "n_spans": len(edge) // 2, "spans": [{"start": s, "end": e} for s, e in edge.reshape(-1, 2).tolist()], "kept": block.buf[a:b][~mask].tobytes()}

        return of

    with scope(spark) as held, tidy_shuffles(spark):
        stored = materialise(blocks(docs, id_col, text_col, block_bytes), "repeats-blocks")
        total = stored.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
        bits = _bits_for(total * len(COVERS[period]) // period, least)
        ranked = _replies(_each(stored, _SENT, cover_sent(bits)), _shared)
        marked = materialise(_each(stored.join(ranked, "block", "left"), _BLOCK + ", n_candidates long, candidates binary", candidates(bits)), "repeats-candidates")
        held.release(marked)
        total = marked.agg(F.coalesce(F.sum("n_candidates"), F.lit(0))).first()[0]
        bits = _bits_for(total, least)
        replies = _replies(_each(marked, _SENT, suffixes_sent(bits)), _repeated)
        held.keep(marked, replies)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary"
    out = _each(marked.join(replies, "block", "left"), schema, cut_out(bits))
    nameless = docs.where(F.col(id_col).cast("long").isNull())
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    none = F.array().cast("array<struct<start:long,end:long>>")
    zero = F.lit(0).cast("long")
    return out.unionByName(nameless.select(F.lit(None).cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), none.alias("spans"), text.alias("kept")))
