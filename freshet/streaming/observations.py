"""Flow files as they arrive: the same parsing as a bounded read, as a stream (Structured Streaming)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from freshet.functions.columns import acft_month_to_cms
from freshet.sources import flo


def read(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """date, gage_id, acft, flow_cms of every file that appears in `folder`."""
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return flo.parse(lines).withColumn("flow_cms", acft_month_to_cms("acft", "date"))


def append(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to a Parquet table, each file once, and stop."""
    return read(spark, folder).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
