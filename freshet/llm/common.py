"""What the operators share: row numbers over a sorted table, and Arrow maps; scratch tables are freshet.scratch's."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.scratch import cut as materialise


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_rows(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | dict]) -> DataFrame:
    """Apply `fn` to each Arrow batch. A dict of columns that it returns is cast to `schema`."""
    arrow = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield to_batch(fn(batch), arrow)

    return df.mapInArrow(run, schema)


def positions(df: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `fn` makes of `df` while its columns go by their positions, so that no name (dots, repeats) is in the way."""
    return fn(df.toDF(*[f"c{i}" for i in range(len(df.columns))])).toDF(*df.columns)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def to_batch(columns: dict | pa.RecordBatch, arrow: pa.Schema) -> pa.RecordBatch:
    if isinstance(columns, pa.RecordBatch):
        return columns
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)


def numbered(df: DataFrame, order: list, tag: str, within: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """Add `row_no` (from 0, gapless) over the total order `order`; with `within`, add `group_no` too, the number inside each group.

    One range shuffle sorts the rows; only counts per partition (and group) are combined, so no group is ever gathered in a task.
    The sorted rows are written once, so that the numbers can't change when a partition is computed again. What is
    broadcast has a row for each of `partitions`, whatever the table.
    """
    spark = df.sparkSession
    within = within or []
    spread = df.repartitionByRange(partitions or shuffle_partitions(spark), *order)
    placed = materialise(
        spread.sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()),
        tag,
    )
    placed = placed.withColumn("_part", F.shiftright("_m", 33)).withColumn("_at", F.col("_m").bitwiseAND((1 << 33) - 1))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    base = counts.selectExpr("_part", "coalesce(sum(_n) over (order by _part rows between unbounded preceding and 1 preceding), 0) as _base")
    out = placed.join(F.broadcast(base), "_part").withColumn("row_no", F.col("_base") + F.col("_at"))
    return out.drop("_m", "_at", "_base") if within else out.drop("_m", "_at", "_base", "_part")
