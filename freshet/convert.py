"""Flowlines of any source as Parquet laid out by place: python -m freshet.convert --flowline-source ... --output-file ..."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet import sinks
from freshet.functions import crs, geometry
from freshet.sources import archives, flowlines

log = logging.getLogger("freshet")


def convert(spark: SparkSession, source: str, target: str, layer: str | None = None) -> DataFrame:
    """Write the flowlines once for many runs, and return them as read back.

    Lines of a projected system are brought to degrees, since Parquet doesn't name one. The ids that the source's order
    gives are kept. A second run replaces the first; a source that is its own target is refused.
    """
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("the target must not be the source")
    source = archives.prepare(source)
    lines, system = flowlines.read(spark, source, layer), flowlines.crs_of(spark, source)
    if "parts" not in lines.columns:
        raise ValueError(f"no shapes in {source}")
    if system and not system.geographic:
        lines = lines.withColumn("parts", geometry.transformed(F.col("parts"), crs.to_degrees(system)))
    if "file_row" not in lines.columns:
        lines = lines.withColumn("file_row", F.monotonically_increasing_id())
    sinks.write_flowlines(lines, target)
    out = flowlines.read(spark, target)
    log.info("%d flowlines of %s written to %s", out.count(), source, target)
    return out


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="freshet.convert", description="Write flowlines as Parquet laid out by place.")
    parser.add_argument("--flowline-source", required=True)
    parser.add_argument("--flowline-layer")
    parser.add_argument("--output-file", required=True)
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(message)s")
    spark = SparkSession.builder.appName("freshet-convert").getOrCreate()
    convert(spark, args.flowline_source, args.output_file, args.flowline_layer)
    spark.stop()


if __name__ == "__main__":
    main()
