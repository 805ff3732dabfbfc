"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows of quality 1; unlabelled text is every document. A first classifier of positives
against some unlabelled text is only a score and a place to start. By its score, all unlabelled text that it wasn't
trained on gives the share that is positive: the least ratio of the shares of both kinds above a threshold, with a
confidence margin (best-bin estimation). With that prior the classifier minimises the non-negative unbiased risk: the risk of unlabelled text taken as
negative, less the positives' part in it, never counts below zero; where it would, that step goes against its
gradient. The loss is the bounded sigmoid loss, so that an error in the prior can't outweigh the few negatives;
the first classifier, stretched to least risk, is where the descent starts.

The labelled sample and the first classifier's unlabelled one are bounded (`POSITIVES`, `UNLABELLED`; smallest seeded
hash of the id). Prior, start and descent take all documents: these are dealt by id into parts of at least `UNLABELLED`
on average, as many as the descent has steps at most, and a step sums the gradient of one part in the executors, so each
document is used once or more. Sums are of whole numbers and don't depend on how the table is dealt. All of it keeps to
rows outside the held-out fold. Every document is scored whole, from its text alone.

Cases: null and empty texts get the score of a text without features; without positives every score is 1; an empty
table gives no rows; documents that share an id give one row to the first classifier's sample, and each its own score;
a null id is scored but not trained on; a very long text is one row, held whole by its task; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm import linear, quality, textfeatures
from freshet.llm.common import map_rows, materialise
from freshet.scratch import scope

POSITIVES = 2000
UNLABELLED = 3000
SEED = 31
FOLDS = 5
THRESHOLD = 0.3
FIRST = (40, 0.05, 1e-4)  # steps, rate and weight decay of the first classifier
SECOND = (40, 0.01, 1e-5)  # and of the descent from it
TASKS = 48  # sums of DIM numbers that the driver adds up, at most


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; fold 0 is held out."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """The positives' share of unlabelled text, from both kinds' products on rows kept apart."""
    cuts = np.sort(positive)
    return prior_of(np.bincount(np.searchsorted(cuts, unlabelled, "right"), minlength=len(cuts) + 1), delta)


def prior_of(reached: np.ndarray, delta: float = 0.1) -> float:
    """The same from how many unlabelled products reach none, the first, the first two ... of the sorted positive ones."""
    n_p, n_u = len(reached) - 1, reached.sum()
    above_p = 1 - np.arange(n_p) / n_p
    above_u = 1 - np.cumsum(reached)[:-1] / n_u
    margin = np.sqrt(np.log(4 / delta) / (2 * n_u)) + np.sqrt(np.log(4 / delta) / (2 * n_p))
    best = np.argmin((above_u + margin) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def risk(p: np.ndarray, u_mean: float, prior: float) -> float:
    """Non-negative unbiased risk under the sigmoid loss, from the positives' sigmoids and the unlabelled ones' mean."""
    return float(prior * (1 - p).mean() + max(0.0, u_mean - prior * p.mean()))


def tried(z: np.ndarray) -> list[tuple[float, float]]:
    """Slopes, and points to take as zero, to try on the products; `z` are the positives'.

    The sigmoid loss is flat far from zero, so the descent needs products of about 1 with a zero between the kinds. The
    positives' kind ends below nearly all of them: zeros lie under a few low quantiles, by a part of the distance from
    the median to the first percentile. The data decide between them, by the least risk.
    """
    zeros = np.quantile(z, [0.002, 0.005, 0.01, 0.02, 0.05]) - 0.3 * (np.median(z) - np.quantile(z, 0.01))
    return [(slope, float(zero)) for slope in (1.0, 2.0, 4.0) for zero in zeros]


def packed(total: np.ndarray) -> pa.RecordBatch:
    """Whole numbers byte by byte, most of which are zero, compressed: small results keep the driver's memory small."""
    return pa.RecordBatch.from_pydict({"total": pa.array([zlib.compress(total.view(np.uint8).reshape(len(total), 8).T.tobytes(), 1)], pa.binary())})


def unpacked(held: pa.Scalar, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(held.as_buffer()), np.uint8).reshape(8, n).T).view(np.int64)[:, 0]


def summed(part: DataFrame, add: Callable[[textfeatures.Group, np.ndarray], np.ndarray], n: int) -> np.ndarray:
    """`n` whole numbers: what `add` gives for each group of texts of `part` and their ids, added up.

    Each task adds up its texts; where there are more than TASKS of them, a second level of tasks adds up their sums.
    """

    def run(batches):
        total = np.zeros(n, np.int64)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, group in textfeatures.groups(batch.column(1).to_pylist()):
                total += add(group, ids[first : first + group.n])
        yield packed(total)

    def again(batches):
        total = np.zeros(n, np.int64)
        for batch in batches:
            for held in batch.column(0):
                total += unpacked(held, n)
        yield packed(total)

    sums = part.select("doc_id", "text").mapInArrow(run, "total binary")
    if sums._jdf.queryExecution().toRdd().getNumPartitions() > TASKS:
        sums = sums.repartition(TASKS).mapInArrow(again, "total binary")
    out = np.zeros(n, np.int64)
    for held in sums.toArrow()["total"]:
        out += unpacked(held, n)
    pa.default_memory_pool().release_unused()
    return out


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, seed: int = SEED) -> tuple[quality.Model, float]:
    """The model and the estimated prior."""
    trained = fold(F.col("doc_id")) != 0
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    good = labels.where("quality = 1 and doc_id is not null").where(trained).select(doc_id).distinct()
    all_text = docs.where("doc_id is not null").where(trained).select(doc_id, "text")
    # Marks: 0 for positives, 1 for unlabelled text; a document may be both.
    drawn = quality.drawn(good, positives, seed).withColumn("mark", F.lit(0)).unionAll(quality.drawn(all_text.select("doc_id"), unlabelled, seed + 1).distinct().withColumn("mark", F.lit(1)))
    rows, mark, ids = quality.sparse_rows(docs, drawn, "mark")
    n_p, n_u = int((mark == 0).sum()), int((mark == 1).sum())
    if n_p < 4 or n_u < 4:
        return quality.KEEPS_ALL, 1.0
    # Every third row of a kind is kept apart for the prior; rows come in order of id, which says nothing of their text.
    apart = np.concatenate([np.arange(n_p), np.arange(n_u)]) % 3 == 0
    share = np.where(mark == 0, 0.5 / (~apart & (mark == 0)).sum(), 0.5 / (~apart & (mark == 1)).sum()) * ~apart
    weights, bias = linear.minimise(rows, lambda z: share * (linear.sigmoid(z) - (mark == 0)), textfeatures.DIM, *FIRST)
    seen = ids[~apart & (mark == 1)]
    end = rows.starts[n_p]
    rows = linear.Rows(rows.number[:end].copy(), rows.value[:end].copy(), rows.starts[: n_p + 1])  # the positives
    z = rows.product(weights) + bias

    with scope(docs.sparkSession):
        parts = max(1, min(SECOND[0], all_text.count() // max(1, unlabelled)))
        dealt = F.pmod(F.xxhash64(F.lit(seed + 2), "doc_id"), F.lit(parts)).cast("int")
        texts = materialise(all_text.withColumn("part", dealt).coalesce(8 * docs.sparkSession.sparkContext.defaultParallelism), "pu-texts", "part")
        prior, slope, shift = start(texts, weights, bias, z, apart[:n_p], seen)
        weights, bias = descent(texts, parts, rows, prior, (slope * weights, slope * bias + shift))
        return quality.Model(weights, bias), prior


def start(texts: DataFrame, weights: np.ndarray, bias: float, z: np.ndarray, apart: np.ndarray, seen: np.ndarray) -> tuple[float, float, float]:
    """The prior, and slope and shift of least risk, of the first classifier. z: the positives' products; seen: ids that it was trained on as unlabelled."""
    cuts, lines = np.sort(z[apart]), tried(z)
    held = texts.sparkSession.sparkContext.broadcast((weights, bias, cuts, lines, seen))

    def add(group: textfeatures.Group, ids: np.ndarray) -> np.ndarray:
        weights, bias, cuts, lines, seen = held.value
        z = textfeatures.linear(group, textfeatures.counts(group), weights) + bias
        reached = np.bincount(np.searchsorted(cuts, z[~np.isin(ids, seen)], "right"), minlength=len(cuts) + 1)
        means = [np.rint(textfeatures.UNIT * linear.sigmoid(slope * (z - zero))).sum() for slope, zero in lines]
        return np.concatenate([reached, means, [group.n]]).astype(np.int64)

    out = summed(texts, add, len(cuts) + 2 + len(lines))
    held.destroy()
    reached, means = out[: len(cuts) + 1], out[len(cuts) + 1 : -1] / textfeatures.UNIT / out[-1]
    prior = prior_of(reached)
    _, slope, zero = min((risk(linear.sigmoid(slope * (z - zero)), mean, prior), slope, zero) for (slope, zero), mean in zip(lines, means))
    return prior, slope, -slope * zero


def descent(texts: DataFrame, parts: int, positive: linear.Rows, prior: float, begin: tuple[np.ndarray, float]) -> tuple[np.ndarray, float]:
    """Descent on the non-negative risk; each step takes all positives and the next part of the unlabelled text."""
    context = texts.sparkSession.sparkContext

    def gradient(step: int, weights: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
        held = context.broadcast((weights, bias))

        def add(group: textfeatures.Group, _: np.ndarray) -> np.ndarray:
            weights, bias = held.value
            c = textfeatures.counts(group)
            families, shares = textfeatures.features(group, c), textfeatures.dense(group, c)
            u = linear.sigmoid(textfeatures.linear(group, c, weights, families, shares) + bias)
            ends = [np.rint(textfeatures.UNIT * u * (1 - u)).sum(), np.rint(textfeatures.UNIT * u).sum(), group.n]
            return np.append(textfeatures.back(group, families, shares, u * (1 - u)), np.array(ends, np.int64))

        out = summed(texts.where(F.col("part") == step % parts), add, textfeatures.DIM + 3)
        held.destroy()
        n = max(1, out[-1])  # a part may be empty in a table of many equal ids
        of_u, mean = out[:-2] / textfeatures.UNIT / n, out[-2] / textfeatures.UNIT / n
        p = linear.sigmoid(positive.product(weights) + bias)
        of_p = prior * p * (1 - p) / len(p)
        of_p = np.append(positive.back(of_p, textfeatures.DIM), of_p.sum())
        # Where the risk of the negatives came out below zero: back.
        full = of_p - of_u if mean < prior * p.mean() else of_u - 2 * of_p
        return full[:-1], full[-1]

    return linear.descend(gradient, textfeatures.DIM, *SECOND, begin)


def classify(df: DataFrame, model: quality.Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of `df`."""
    held = df.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def run(batch):
        score = np.zeros(batch.num_rows)
        for first, group in textfeatures.groups(batch.column(1).to_pylist()):
            score[first : first + group.n] = held.value.probability(group, textfeatures.counts(group))
        return {"doc_id": batch.column(0), "held_out": batch.column(2), "score": score, "predicted": (score >= threshold).astype(np.int32)}

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (fold(F.col("doc_id")) == 0).alias("held_out"))
    return map_rows(rows, "doc_id long, held_out boolean, score double, predicted int", run)
