"""Joins on keys of which one may hold a great share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that more than one row in so many has are hot; there can't be more of them than this.
MANY = 1000


def spread_join(df: DataFrame, side: DataFrame, keys: str | list[str], total: int, how: str = "inner", distinct: bool = False) -> DataFrame:
    """`df` joined with `side` on `keys` (inner or left), so that no task gets more than about a thousandth of `df` for one key.

    `side` has one row for each key and a column `n`: how many rows of `df` have the key, or more, but `total` over all
    keys at most. Keys with over total / MANY rows are therefore at most MANY: their rows of `side` are broadcast, and
    `df`'s stay where they are. All others meet by a shuffle. `n` isn't returned. A null key never matches. With
    `distinct`, one row of each key is returned; hot keys are thinned where they are, before they are shuffled.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    is_hot = F.col("n") * MANY > total
    hot, rest = side.where(is_hot).drop("n"), side.where(~is_hot).drop("n")
    warm = df.join(F.broadcast(hot), keys)
    thinned = df.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    if not distinct:
        return warm.unionByName(thinned.join(rest, keys, how))
    # The shuffle that brings equal keys together serves the join too.
    return warm.dropDuplicates(keys).unionByName(thinned.join(rest.hint("merge"), keys, how).dropDuplicates(keys))
