"""Packing by minimum bin slack over a histogram of lengths.

Every document is encoded, ended by one id and cut into pieces of the window's capacity; only the last piece of a
document is shorter. Windows are planned on the driver from the number of pieces of each length (at most
`capacity` numbers, whatever the corpus): the largest length left is fixed, a bitset subset-sum over the lengths
left finds the multiset that comes closest to the rest of the window, backtracking gives how often each length is
used, and the window is repeated as often as the counts allow. Pieces then take their places by their rank among
pieces of equal length; ranks come from counts per partition, so a length that many pieces share is never gathered.

Cases: a null or empty text is one piece of the end id alone; an empty table gives no rows; repeated rows and null ids
are packed like others; a very long text is cut into as many pieces as it needs; other columns are ignored.
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
from freshet.llm.common import arrow_schema, map_rows, materialise, to_batch

CAPACITY = 2048
END = 1


def pieces(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of each document with their place among the partition's pieces of that length."""
    schema = "part int, local_rank long, doc_id long, start long, length int, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids
    arrow = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bytebpe.load(tokenizer)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in arrow}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(bpe.encode(text or ""), np.uint32(end)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    cut = ids[start : start + capacity].tobytes()
                    length = len(cut) // 4
                    out["part"].append(part)
                    out["local_rank"].append(int(seen[length]))
                    seen[length] += 1
                    out["doc_id"].append(doc_id)
                    out["start"].append(start)
                    out["length"].append(length)
                    out["ids_crc32"].append(zlib.crc32(cut))
                    out["doc_tokens"].append(len(ids))
                    if keep_ids:
                        out["ids"].append(cut)
            if out["part"]:
                yield to_batch(out, arrow)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def closest_multiset(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, each at most as often as counted, whose sum comes closest to `room` without going over it."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length], room // length) if length <= room else 0
        if not left:
            continue
        steps.append((length, counts[length], reach))
        take = 1
        while left > 0:  # a count in binary parts: every smaller count is a sum of them
            take = min(take, left)
            reach |= (reach << (take * length)) & mask
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, count, before in reversed(steps):
        k = 0
        while not before >> (at - k * length) & 1:
            k += 1
        if k:
            used[length] = k
            at -= k * length
    return used


def plan_windows(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Windows as (how many alike, [(length, how often in each)])."""
    left = {length: n for length, n in histogram.items() if n}
    out = []
    while left:
        seed = max(left)
        rest = dict(left)
        rest[seed] -= 1
        window = closest_multiset({k: n for k, n in rest.items() if n}, capacity - seed)
        window[seed] = window.get(seed, 0) + 1
        times = min(left[length] // k for length, k in window.items())
        for length, k in window.items():
            left[length] -= k * times
            if not left[length]:
                del left[length]
        out.append((times, sorted(window.items(), reverse=True)))
    return out


def places(windows: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """For each length, rows of (first rank, used in each window, first sequence, offset in the window), by first rank."""
    rank: dict[int, int] = {}
    rows: dict[int, list] = {}
    sequence = 0
    for times, window in windows:
        offset = 0
        for length, k in window:
            rows.setdefault(length, []).append((rank.get(length, 0), k, sequence, offset))
            rank[length] = rank.get(length, 0) + k * times
            offset += k * length
        sequence += times
    return {length: np.array(r, dtype=np.int64) for length, r in rows.items()}


def pack(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece, with its ids on request."""
    cut = materialise(pieces(df, tokenizer, capacity, end, id_col, text_col, keep_ids), "pack-pieces")
    counts = materialise(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table = places(plan_windows(histogram, capacity))
    base = counts.selectExpr("length", "part", "coalesce(sum(n) over (partition by length order by part rows between unbounded preceding and 1 preceding), 0) as base")
    ranked = cut.join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("local_rank"))

    def place(batch):
        lengths = batch.column("length").to_numpy(zero_copy_only=False)
        ranks = batch.column("rank").to_numpy(zero_copy_only=False)
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        order = np.argsort(lengths, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
            length = int(lengths[at[0]])
            rows = table[length]
            row = rows[np.searchsorted(rows[:, 0], ranks[at], "right") - 1]
            i = ranks[at] - row[:, 0]
            sequence[at] = row[:, 2] + i // row[:, 1]
            offset[at] = row[:, 3] + i % row[:, 1] * length
        return {name: batch.column(name) for name in kept} | {"length": lengths.astype(np.int64), "sequence_id": sequence, "offset": offset}

    kept = ["doc_id", "start", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * keep_ids
    return map_rows(ranked.select(*kept, "length", "rank"), schema, place)


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad: int = 0) -> DataFrame:
    """sequence_id, ids (array of `capacity` ids, padded), n_ids: the sequences themselves, from pack(keep_ids=True)."""

    def run(batch):
        out: dict[str, list] = {"sequence_id": batch.column(0), "ids": [], "n_ids": []}
        for held in batch.column(1).to_pylist():
            ids = np.frombuffer(b"".join(x["ids"] for x in held), "<u4")
            out["n_ids"].append(len(ids))
            out["ids"].append(np.concatenate([ids, np.full(capacity - len(ids), pad, "<u4")]).astype(np.int64))
        return out

    held = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("held"))  # at most `capacity` pieces
    return map_rows(held, "sequence_id long, ids array<long>, n_ids long", run)
