"""Connected components of a graph given as edges, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.operators.joins import spread_join
from freshet.scratch import cut, scope


def components(edges: DataFrame, tag: str) -> DataFrame:
    """node, root for each node that `edges` (a, b: long) names; the root is the component's least node.

    Each round takes the least label among neighbours, and the label's own label, so that paths shorten to their
    square root at least; stars end after two rounds. Labels are written at each round, and the round before is let go.
    A node with a great share of the edges, and a label with a great share of the nodes, are hot keys: they are broadcast,
    and there are few of them.
    """
    with scope(edges.sparkSession) as held:
        both = cut(edges.where("a <> b").select("a", "b").unionAll(edges.where("a <> b").selectExpr("b", "a")).distinct(), f"{tag}-edges")
        first = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root"), F.count(F.lit(1)).alias("degree"), F.lit(True).alias("changed"))
        labels = cut(first, f"{tag}-labels")
        links, nodes = both.count(), labels.count()
        while True:
            # Each node has as many edges that lead to it as edges that leave it.
            of_b = labels.select(F.col("node").alias("b"), F.col("root").alias("near"), F.col("degree").alias("n"))
            near = spread_join(both, of_b, "b", links).groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
            # Only labels that have a lower label themselves move anything.
            used = labels.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
            up = used.join(labels.where("root < node").select(F.col("node").alias("root"), F.col("root").alias("up")), "root")
            lifted = spread_join(labels.drop("changed"), up, "root", nodes, "left")
            lower = lifted.join(near, "node").select("node", F.least("root", "near", "up").alias("root"), "degree", (F.least("near", F.coalesce("up", "near")) < F.col("root")).alias("changed"))
            done = cut(lower, f"{tag}-labels")
            if done.where("changed").isEmpty():
                held.keep(done)
                return done.select("node", "root")
            held.release(both, done)
            labels = done
