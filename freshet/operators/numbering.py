"""Row numbers over a total order without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.scratch import cut


def row_numbers(df: DataFrame, order: list[str], name: str, first: int = 1) -> DataFrame:
    """Add `name`: first, first + 1, ... in the order of the columns `order`.

    The rows are sorted by one range shuffle; numbers are positions in a partition plus the sizes of those before it.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    base = sizes.selectExpr("_part", "coalesce(sum(_n) over (order by _part rows between unbounded preceding and 1 preceding), 0) as _base")
    # One row for each partition.
    return placed.withColumn("_part", part).join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1) + first).drop("_part", "_base", "_at")
