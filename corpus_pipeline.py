"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

Cases, beside those that the stages' operators state: an empty table passes all stages and gives no pieces; null and
empty texts fail the quality rules; rows with the same id, or without one, are judged one by one, and stay unless their
texts are near copies; other columns are carried through unchanged, but n_chars, which follows a masked text; very long
texts are judged, masked and packed whole. Without labels of both kinds the classifiers reject nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import bytebpe, ngram_join, packing, pii, positive_unlabelled, quality
from freshet.llm.common import documents, materialise
from freshet.scratch import scope


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the calibrated classifier go."""
    return quality.filtered(docs, quality.fit(documents(spark, sf_dir), labels(spark, sf_dir)))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier predicts as 0 go; it is fitted on the whole table's labels and texts."""
    model, _ = positive_unlabelled.fit(documents(spark, sf_dir), labels(spark, sf_dir))
    return quality.filtered(docs, model, positive_unlabelled.THRESHOLD, base_rules=False)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies stays: that of the least id."""
    return ngram_join.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the texts; n_chars follows the text."""
    masked = pii.masked(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in their windows."""
    return packing.pack(docs, bytebpe.default_path())


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("packing", pack),
]

#: SQL can't express the classifiers, the tokenizer or the packing; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`."""
    docs = documents(spark, sf_dir)
    with scope(spark) as held:
        for name, stage in STAGES[:-1]:
            docs = materialise(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
            held.release(docs)  # the tables of the stages before have served
        held.keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
