"""Job: take in flow files as they are delivered, tell usable ones from broken ones, and keep their observations.

Agencies send monthly flow files again and again, some cut short, some with words where numbers should be, and one such
line stops a model run. A delivery is a row of a text table: doc_id, text, source. The job is a stream that takes what has
arrived since its last run, by the checkpoint that it keeps, and ends. It writes under `out`:

* `deliveries`, by source and batch: doc_id, n_lines, n_rows (lines of 14 tokens or more), n_short (other lines that aren't
  empty), n_bad (rows with a year or value that isn't a plain number), text_sha256, copy_of (the delivery that had the
  same text first) and status: empty (no rows), broken (bad rows), copy or usable;
* `observations`, by batch and year: doc_id, date, gage_id and acft of the usable deliveries.

A batch that failed half way is taken again under its own number and replaces what it had written, so reruns change
nothing. Null texts are empty; null ids and sources stay null; texts are read whole.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.operators.joins import spread_join
from freshet.scratch import cut, scope
from freshet.sources import flo
from jobs.common import counted, main

log = logging.getLogger("jobs.delivery_intake")

_DELIVERIES = "doc_id long, n_lines long, n_rows long, n_short long, n_bad long, text_sha256 string, copy_of long, status string, source string, batch long"
_OBSERVATIONS = "doc_id long, date date, gage_id string, acft double, batch long, year int"


@dataclass
class Config:
    deliveries: str
    out: str
    checkpoint: str
    files_per_batch: int = 1000


def lines_of(text: str):
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def audited(deliveries: DataFrame) -> DataFrame:
    """Counts of each delivery's lines, and the digest of its text."""
    tokens = F.transform(lines_of("text"), flo.tokens)
    held = deliveries.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), F.transform(tokens, flo.state).alias("states"))
    n = lambda state: F.size(F.filter("states", lambda s: s == state)).cast("long")
    return held.select("doc_id", "source", "text_sha256", F.size("states").cast("long").alias("n_lines"), (n("row") + n("bad")).alias("n_rows"), n("short").alias("n_short"), n("bad").alias("n_bad"))


def first_copies(audit: DataFrame, known: DataFrame) -> DataFrame:
    """`audit` with copy_of: the first delivery of the same text, one that was `known` before, else that of the least id here."""
    new = audit.groupBy("text_sha256").agg(F.min("doc_id").alias("here"), F.count(F.lit(1)).alias("n"))
    before = known.where("copy_of is null").groupBy("text_sha256").agg(F.min("doc_id").alias("before"))
    firsts = new.join(before, "text_sha256", "left").select("text_sha256", "n", F.coalesce("before", "here").alias("first"))
    return spread_join(audit, firsts, "text_sha256", audit.count(), "left").withColumn("copy_of", F.when(F.col("first") != F.col("doc_id"), F.col("first"))).drop("first")


def written(spark: SparkSession, path: str, schema: str, batch: int | None = None) -> DataFrame:
    """The table at `path` as it stands, or of the batches before `batch`; no rows before the first one."""
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        return spark.createDataFrame([], schema)
    held = spark.read.schema(schema).parquet(path)
    return held if batch is None else held.where(F.col("batch") < batch)


def take(spark: SparkSession, batch: DataFrame, number: int, out: str) -> None:
    """One batch of deliveries into the two tables."""
    with scope(spark):
        deliveries, read = counted(batch.select("doc_id", "text", "source"), f"intake read {number}")
        audit = cut(audited(deliveries), "intake")
        status = F.when(F.col("n_rows") == 0, "empty").when(F.col("n_bad") > 0, "broken").when(F.col("copy_of").isNotNull(), "copy").otherwise("usable")
        held = first_copies(audit, written(spark, f"{out}/deliveries", _DELIVERIES, number)).withColumn("status", status).withColumn("batch", F.lit(number).cast("long"))
        held, wrote = counted(held, f"intake deliveries {number}")
        to = lambda df, name, *by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{out}/{name}")
        to(held, "deliveries", "source", "batch")
        log.info("batch %s: read %s deliveries, wrote %s rows to %s/deliveries", number, read.get["rows"], wrote.get["rows"], out)
        usable = written(spark, f"{out}/deliveries", _DELIVERIES).where((F.col("batch") == number) & (F.col("status") == "usable")).select("doc_id", "text_sha256")
        # Only texts with a row at all can be usable; their digests find them, null ids too.
        texts = batch.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "doc_id", "text").where(F.exists(F.transform(lines_of("text"), flo.tokens), lambda t: flo.state(t) == "row"))
        mine = texts.join(usable.withColumnRenamed("doc_id", "id"), "text_sha256").where(F.col("id").eqNullSafe(F.col("doc_id")))
        lines = mine.select("doc_id", F.explode(lines_of("text")).alias("value"))
        rows = flo.parse(lines, "doc_id").withColumn("batch", F.lit(number).cast("long")).withColumn("year", F.year("date"))
        rows, kept = counted(rows, f"intake observations {number}")
        to(rows, "observations", "batch", "year")
        log.info("batch %s: wrote %s rows to %s/observations", number, kept.get["rows"], out)


def stream_path(spark: SparkSession, path: str) -> str:
    """A folder as it is; a single file as a pattern that only it matches, since streams read folders and patterns."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return path
    parent, name = path.rstrip("/").rsplit("/", 1)
    return f"{parent}/{{{name}}}"


def run(spark: SparkSession, config: Config) -> None:
    """Take in what is new, and return when all of it is written."""
    schema = spark.read.parquet(config.deliveries).schema
    new = spark.readStream.schema(schema).option("maxFilesPerTrigger", config.files_per_batch).parquet(stream_path(spark, config.deliveries))
    stream = new.writeStream.foreachBatch(lambda batch, number: take(batch.sparkSession, batch, number, config.out))
    query = stream.option("checkpointLocation", config.checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%s: %s batches known, up to date", config.deliveries, written(spark, f"{config.out}/deliveries", _DELIVERIES).select("batch").distinct().count())


def result(spark: SparkSession, out: str) -> DataFrame:
    """The audit of every delivery so far."""
    return written(spark, f"{out}/deliveries", _DELIVERIES).drop("batch")


if __name__ == "__main__":
    main(run, Config, "Intake of delivered flow files")
