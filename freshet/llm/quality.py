"""Quality rules: base counts, then a calibrated logistic regression on hashed word and character n-grams.

The model is fitted on the driver from a bounded sample of labelled rows (`SAMPLE` ids, those with the smallest
seeded hash, and `NUMBERS` features of their texts at most), four fifths to train and the rest to calibrate by Platt's
method. All texts are then scored whole, in Arrow batches; only the weights (of a fixed number) are sent to the executors.

Cases: a null or empty text has no words and fails the base rules; without labels of both kinds the method rejects
nothing; equal texts get equal results; labels repeated for an id count as the higher one; documents that share a
labelled id give one row to the sample, and each its own result; an empty table gives no rows; a null id is kept; a very
long text is scored whole by its task and gives the sample one row of at most DIM features; other columns are left as
they are, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm import linear, textfeatures
from freshet.llm.common import map_rows, materialise, positions
from freshet.scratch import scope

SAMPLE = 3000  # labelled rows that the model is fitted on, at most
NUMBERS = 12_000_000  # features of the rows of a kind that a model is fitted on, at most (8 bytes each)
SLICES = 4  # in which they come to the driver
SEED = 29
THRESHOLD = 0.5  # documents below it go
MIN_WORDS = 50
STEPS, RATE, DECAY = 80, 0.05, 1e-4


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, group: textfeatures.Group, counts: textfeatures.Counts) -> np.ndarray:
        z = textfeatures.linear(group, counts, self.weights) + self.bias
        return linear.sigmoid(self.slope * z + self.shift)


KEEPS_ALL = Model(np.zeros(textfeatures.DIM, np.float32), 30.0)


def drawn(ids: DataFrame, n: int, seed: int) -> DataFrame:
    """The `n` rows with the smallest seeded hash of doc_id."""
    return ids.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(n)


def sparse_rows(docs: DataFrame, named: DataFrame, mark: str, numbers: int = NUMBERS) -> tuple[linear.Rows, np.ndarray, np.ndarray]:
    """On the driver, in order of mark and id: features, marks and ids of the documents in `named` (doc_id and `mark`; a bounded number of rows).

    An id stands for one text, that of the least hash. Of each mark, rows are taken by the hash of their id as long as their
    features are `numbers` at most. Features are written by the executors and come to the driver slice by slice.
    """

    def run(batch):
        rows = []
        for _, group in textfeatures.groups(batch.column("text").to_pylist()):
            rows += textfeatures.sparse(group, textfeatures.counts(group))
        return {"doc_id": batch.column("doc_id"), "mark": batch.column("mark"), "n": [len(n) for n, _ in rows], "number": [n.tobytes() for n, _ in rows], "value": [v.tobytes() for _, v in rows]}

    with scope(docs.sparkSession):
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(named.select("doc_id", F.col(mark).cast("int").alias("mark"))), "doc_id")
        one = texts.groupBy("doc_id", "mark").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("first")).select("doc_id", "mark", "first.text")
        written = materialise(map_rows(one, "doc_id long, mark int, n long, number binary, value binary", run), "sparse-rows")
        listed = written.select("doc_id", "mark", "n").toArrow()  # as many rows as `named` has, at most
        ids, marks, sizes = (listed[name].to_numpy().astype(np.int64) for name in ("doc_id", "mark", "n"))
        taken = np.zeros(len(ids), bool)
        for kind in np.unique(marks):
            at = np.flatnonzero(marks == kind)
            at = at[np.argsort(textfeatures.mix(ids[at].astype(np.uint64)), kind="stable")]
            taken[at[np.cumsum(sizes[at]) <= numbers]] = True
        ids, marks, sizes = ids[taken], marks[taken], sizes[taken]
        order = np.lexsort((ids, marks))
        ids, marks, sizes = ids[order], marks[order], sizes[order]
        starts = np.append(0, np.cumsum(sizes)).astype(np.int64)
        place = {key: i for i, key in enumerate(zip(marks.tolist(), ids.tolist()))}
        number, value = np.empty(starts[-1], np.int32), np.empty(starts[-1], np.float32)
        for part in range(SLICES if place else 0):
            table = written.where(F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)) == part).toArrow()
            for batch in table.to_batches():
                for j, key in enumerate(zip(batch.column("mark").to_pylist(), batch.column("doc_id").to_pylist())):
                    if key in place:
                        i = place[key]
                        number[starts[i] : starts[i + 1]] = np.frombuffer(batch.column("number")[j].as_buffer(), np.int32)
                        value[starts[i] : starts[i + 1]] = np.frombuffer(batch.column("value")[j].as_buffer(), np.float32)
            del table
            pa.default_memory_pool().release_unused()
        return linear.Rows(number, value, starts), marks, ids


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> Model:
    marked = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    rows, y, ids = sparse_rows(docs, drawn(marked, sample, seed), "quality")
    rank = np.argsort(np.argsort(textfeatures.mix(ids.astype(np.uint64) + np.uint64(seed)), kind="stable"), kind="stable")
    train = rank % 5 != 0
    if len(set(y[train].tolist())) < 2:
        return KEEPS_ALL
    share = train / train.sum()
    weights, bias = linear.minimise(rows, lambda z: share * (linear.sigmoid(z) - y), textfeatures.DIM, STEPS, RATE, DECAY)
    slope, shift = linear.platt((rows.product(weights) + bias)[~train], y[~train]) if not train.all() else (1.0, 0.0)
    return Model(weights, bias, slope, shift)


def score(df: DataFrame, model: Model, id_col: str | Column = "doc_id", text_col: str | Column = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base counts, base_failed, probability and kept for each row of `df`."""
    held = df.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def run(batch):
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        out = {name: np.zeros(batch.num_rows, np.int64) for name in names} | {"probability": np.zeros(batch.num_rows)}
        for first, group in textfeatures.groups(batch.column(1).to_pylist()):
            counts = textfeatures.counts(group)
            for name in names:
                out[name][first : first + group.n] = getattr(counts, name)
            out["probability"][first : first + group.n] = held.value.probability(group, counts)
        failed = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
        return out | {"doc_id": batch.column(0), "base_failed": failed, "kept": ~failed & (out["probability"] >= threshold)}

    id_col, text_col = (F.col(c) if isinstance(c, str) else c for c in (id_col, text_col))
    return map_rows(
        df.select(id_col.cast("long").alias("doc_id"), text_col.alias("text")),
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double",
        run,
    )


def filtered(df: DataFrame, model: Model, threshold: float = THRESHOLD, base_rules: bool = True) -> DataFrame:
    """The rows of `df` that the rules keep, all columns as they are."""
    held = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index("text")

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for first, group in textfeatures.groups(batch.column(at).to_pylist()):
                counts = textfeatures.counts(group)
                good = held.value.probability(group, counts) >= threshold
                if base_rules:
                    good &= (counts.n_words >= MIN_WORDS) & (100 * counts.n_repeat_words <= 50 * counts.n_words)
                keep[first : first + group.n] = good
            yield batch.filter(pa.array(keep))

    return positions(df, lambda plain: plain.mapInArrow(run, plain.schema))
