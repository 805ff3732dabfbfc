"""Control points: snapping to segments and the paths between them (A2, J7, N7, N8, P9, SP10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions.columns import lookup
from freshet.operators.nearest import nearest
from freshet.operators.network import Powers, reach
from freshet.scratch import cut, scope, tidy_shuffles


def keep_first(points: DataFrame, key: str = "UP_CP") -> DataFrame:
    """A2: the first row of each key in the order of the file."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy("file_row"))
    return points.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def snap(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """SP10: every control point with UP_COMID, DS_COMID and snap_dist.

    `points` has UP_CP, Next_DS_CP, ChLosFac, file_row, x, y; `centroids` has comid, x, y of the segments in the same
    metres. A point's place is that of its first row; the next point downstream is looked up by its name and may be missing.
    """
    first = keep_first(points)
    nowhere = first.where(F.col("x").isNull() | F.isnan("x") | F.col("y").isNull() | F.isnan("y")).first()
    if nowhere:
        raise ValueError(f"control point {nowhere['UP_CP']} has no place")
    placed = nearest(first.select(F.col("UP_CP").alias("qid"), "x", "y"), centroids)
    snapped = first.join(placed, first.UP_CP == placed.qid).drop("qid").withColumnRenamed("comid", "UP_COMID").withColumnRenamed("distance", "snap_dist")
    snapped = cut(snapped, "snapped")
    return lookup(snapped, "Next_DS_CP", snapped, "UP_CP", "UP_COMID", "DS_COMID")


def pairs(snapped: DataFrame, segments: DataFrame) -> DataFrame:
    """step, up, ds, loss for the points whose both ends are in the network, in the order of the file."""
    inside = segments.select("comid")
    both = snapped.dropna(subset=["UP_COMID", "DS_COMID"]).select(F.col("file_row").alias("step"), F.col("UP_COMID").alias("up"), F.col("DS_COMID").alias("ds"), F.col("ChLosFac").alias("loss"))
    return both.join(inside.withColumnRenamed("comid", "up"), "up", "left_semi").join(inside.withColumnRenamed("comid", "ds"), "ds", "left_semi").select("step", "up", "ds", "loss")


def paths(steps: DataFrame, links: DataFrame, closure: Powers) -> DataFrame:
    """Step, pos, comid of a path of fewest hops from up to ds; steps without a path of two segments at least have no rows.

    Hops from every `up` come from the doubling closure. Among parents of equal hops the lowest comid is taken, which
    makes a tree for each `up`; a path is ds's ancestors in it, gathered by doubling too. The tree is made no deeper than
    the furthest ds of its `up`.
    """
    spark = steps.sparkSession
    with scope(spark) as held, tidy_shuffles(spark):
        steps = steps.where("up <> ds")
        reached = reach(steps.select(F.col("up").alias("comid")).distinct(), closure)
        out = cut(steps.join(reached, (steps.up == reached.src) & (steps.ds == reached.comid)).select("step", "src", F.col("comid").alias("node"), F.col("hops").alias("pos")), "cp-paths")
        furthest = out.groupBy("src").agg(F.max("pos").alias("furthest"))
        reached = cut(reached.join(furthest, "src").where("hops <= furthest").select("src", "comid", "hops"), "cp-reach")
        held.release(out, reached)
        above = reached.select("src", F.col("comid").alias("up"), (F.col("hops") + 1).alias("hops"))
        parent = reached.withColumnRenamed("comid", "node").join(links.withColumnRenamed("ds", "node"), "node").join(above, ["src", "up", "hops"])
        jump, width = cut(parent.groupBy("src", "node").agg(F.min("up").alias("to")), "cp-parents"), 1
        longest = out.agg(F.coalesce(F.max("pos"), F.lit(0))).first()[0]
        while width <= longest:
            further = out.join(jump, ["src", "node"]).select("step", "src", F.col("to").alias("node"), (F.col("pos") - width).alias("pos"))
            out = cut(out.unionByName(further), "cp-paths")
            width *= 2
            if width <= longest:
                second = jump.select("src", F.col("node").alias("to"), F.col("to").alias("next"))
                jump = cut(jump.join(second, ["src", "to"]).select("src", "node", F.col("next").alias("to")), "cp-parents")
            held.release(out, jump)
        held.keep(out)
    return out.select("step", F.col("pos").cast("int").alias("pos"), F.col("node").alias("comid"))


def members(path_rows: DataFrame) -> DataFrame:
    """step, comid: what a step's loss scales, the path without its head."""
    return path_rows.where("pos > 0").select("step", "comid")


def xy(points: DataFrame, x: Column, y: Column) -> DataFrame:
    return points.withColumn("x", x).withColumn("y", y)
