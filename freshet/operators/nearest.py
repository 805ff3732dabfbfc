"""Nearest sites by a tree over them (J6, SP9): a quadtree whose leaves are small wherever sites lie, and a bound that prunes it.

The tree is a table of cells, counted in passes over the sites: a cell with more than `leaf` sites has quarters, and so on
where sites crowd. `leaf` grows with the sites, so that a level has at most LEAVES cells with quarters, and the table at
most four times as many a level: it is broadcast. A query starts at the deepest cell that it lies in. If that is a leaf,
the nearest site there bounds the distance; else the far corner of the cell's sites does. The way down from the root takes
the cells whose sites' bounds are no further away than that, all in one stage, and the query is compared with the sites of the leaves
that it comes to.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.operators.joins import spread_join
from freshet.scratch import cut, scope, tidy_shuffles

#: Least number of sites that a cell is split at; cells with quarters in a level at most.
LEAF, LEAVES = 64, 16_384
#: Levels counted in a pass at most, and in all: cells of the last one aren't split.
LEVELS, DEPTH = 7, 28

_BOX = ("west", "south", "east", "north")


def _place(c: str, low: float, side: float) -> Column:
    """Where a coordinate lies among 2**DEPTH steps."""
    return F.greatest(F.lit(0), F.least(F.lit((1 << DEPTH) - 1), F.floor((F.col(c) - F.lit(low)) / F.lit(side) * F.lit(float(1 << DEPTH))))).cast("long")


def _at_level(level: Column) -> list[Column]:
    up = (F.lit(DEPTH) - level).cast("int")
    return [F.call_function("shiftright", F.col(c), up).alias(c) for c in ("cx", "cy")]


def _counted(cells: DataFrame) -> DataFrame:
    return cells.groupBy("level", "cx", "cy").agg(F.sum("n").alias("n"), F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"))


def _id(level: Column, cx: Column, cy: Column) -> Column:
    return level.cast("long") * (1 << 2 * DEPTH) + cx * (1 << DEPTH) + cy


def _step(n: int, crowded: int, leaf: int) -> int:
    """Levels to count next under `crowded` cells with `n` sites: as many as these need on average, so that a pass has about as many cells as leaves, not as sites."""
    return max(1, min(LEVELS, math.ceil(math.log(n / (crowded * leaf), 4))))


def _tree(sites: DataFrame, n: int, leaf: int) -> tuple[DataFrame, int]:
    """The cells that have sites and whose parent has more than `leaf`: id, parent, level, cx, cy, is_leaf and the bounds of their sites; the deepest level."""
    held, crowded, base, step = None, None, 0, _step(n, 1, leaf)
    while True:
        inside = sites if crowded is None else sites.join(F.broadcast(crowded), [F.call_function("shiftright", sites[c], F.lit(DEPTH - base)) == crowded[f"in_{c}"] for c in ("cx", "cy")], "left_semi")
        last = min(base + step, DEPTH)
        points = inside.select(F.lit(last).alias("level"), *[F.call_function("shiftright", F.col(c), F.lit(DEPTH - last)).alias(c) for c in ("cx", "cy")], F.lit(1).cast("long").alias("n"), F.col("sx").alias("west"), F.col("sy").alias("south"), F.col("sx").alias("east"), F.col("sy").alias("north"))
        up = F.col("level") - F.col("to")
        spread = _counted(points).withColumn("to", F.explode(F.sequence(F.lit(base + 1 if base else 0), F.lit(last))))
        spread = spread.select(F.col("to").alias("level"), *[F.call_function("shiftright", F.col(c), up).alias(c) for c in ("cx", "cy")], "n", *_BOX)
        counted = cut(_counted(spread), "tree-levels")
        held = counted if held is None else held.unionByName(counted)
        at_last = F.col("level") == last
        deepest, left, cells = counted.where(F.col("n") > leaf).agg(F.max("level"), F.sum(F.when(at_last, F.col("n"))), F.count_if(at_last)).first()
        # Cells of a pass lie below crowded ones, so their first level is there even where none of them is crowded; only the root may be alone.
        depth = min(DEPTH, (base + 1 if base else 0) if deepest is None else deepest + 1)
        base = last
        if deepest is None or deepest < last or last == DEPTH:
            break
        step = _step(left, cells, leaf)
        crowded = counted.where(at_last & (F.col("n") > leaf)).select(F.col("cx").alias("in_cx"), F.col("cy").alias("in_cy"))
    is_leaf = (F.col("n") <= leaf) | (F.col("level") == DEPTH)
    parent = F.when(F.col("level") > 0, _id(F.col("level") - 1, F.shiftright("cx", 1), F.shiftright("cy", 1)))
    named = held.select(_id(F.col("level"), F.col("cx"), F.col("cy")).alias("id"), parent.alias("parent"), "level", "cx", "cy", is_leaf.alias("is_leaf"), *_BOX)
    kept = named.join(named.where("not is_leaf").select(F.col("id").alias("parent")), "parent", "left_semi")
    return cut(kept.select(*named.columns).unionByName(named.where("level = 0")), "tree"), depth


def _square(a: Column) -> Column:
    return a * a


def _least(x: Column, y: Column) -> Column:
    zero = F.lit(0.0)
    return _square(F.greatest(F.col("west") - x, x - F.col("east"), zero)) + _square(F.greatest(F.col("south") - y, y - F.col("north"), zero))


def _most(x: Column, y: Column) -> Column:
    return F.greatest(_square(F.col("west") - x), _square(x - F.col("east"))) + F.greatest(_square(F.col("south") - y), _square(y - F.col("north")))


def nearest(queries: DataFrame, sites: DataFrame) -> DataFrame:
    """For each query (qid, x, y) the nearest site (comid, x, y), however far: qid, comid, distance. The lower comid wins a tie.

    Queries and sites without a place are left out; without sites there are no rows.
    """
    with scope(queries.sparkSession) as held, tidy_shuffles(queries.sparkSession):
        out = cut(_nearest(queries, sites), "nearest")
        held.keep(out)
    return out


def _nearest(queries: DataFrame, sites: DataFrame) -> DataFrame:
    queries = queries.select("qid", "x", "y").dropna(subset=["x", "y"])
    places = cut(sites.select("comid", F.col("x").alias("sx"), F.col("y").alias("sy")).dropna().groupBy("sx", "sy").agg(F.min("comid").alias("comid")), "nearest-sites")
    n, west, south, east, north = places.agg(F.count(F.lit(1)), F.min("sx"), F.min("sy"), F.max("sx"), F.max("sy")).first()
    if not n:
        return queries.select("qid", F.lit(None).cast("long").alias("comid"), F.lit(None).cast("double").alias("distance")).where(F.lit(False))
    side = max(east - west, north - south) or 1.0
    placed = lambda df, x, y: df.withColumn("cx", _place(x, west, side)).withColumn("cy", _place(y, south, side))
    cells, depth = _tree(placed(places, "sx", "sy"), n, max(LEAF, n // LEAVES))
    level = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")
    in_cell = lambda df, *keep: df.select(*keep, "cx", "cy", level).select(*keep, _id(F.col("level"), *_at_level(F.col("level"))).alias("id"))
    # At most `leaf` sites, but where they lie closer than the last level tells apart.
    leaves = in_cell(placed(places, "sx", "sy"), "comid", "sx", "sy").join(F.broadcast(cells.where("is_leaf").select("id")), "id")
    leaves = leaves.groupBy("id").agg(F.collect_list(F.struct("comid", "sx", "sy")).alias("sites"))

    x, y = F.col("x"), F.col("y")
    own = in_cell(placed(queries, "x", "y"), "qid", "x", "y").join(F.broadcast(cells.select("id", *_BOX)), "id")
    # Ids grow with levels.
    asked = own.groupBy("qid", "x", "y").agg(F.max(F.struct("id", _most(x, y).alias("bound"))).alias("s")).select("qid", "x", "y", "s.bound", F.lit(0).cast("long").alias("id"))
    down = cells.where("parent is not null").select(F.col("parent").alias("at"), "id", *_BOX).unionByName(cells.where("is_leaf").select(F.col("id").alias("at"), "id", *_BOX))
    for _ in range(depth):
        asked = asked.withColumnRenamed("id", "at").join(F.broadcast(down), "at").where(_least(x, y) <= F.col("bound")).select("qid", "x", "y", "bound", "id")
    asked = cut(asked.drop("bound"), "nearest-asked")
    # A leaf that many queries ask isn't gathered.
    wanted = asked.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    d2 = lambda s: _square(x - s.sx) + _square(y - s.sy)
    met = spread_join(asked, leaves.join(wanted, "id"), "id", asked.count())
    best = F.array_min(F.transform("sites", lambda s: F.struct(d2(s).alias("d2"), s.comid.alias("comid"))))
    return met.groupBy("qid").agg(F.min(best).alias("best")).select("qid", F.col("best.comid").alias("comid"), F.sqrt("best.d2").alias("distance"))
