"""Scratch tables, joins on hot keys, and components."""

import random
import threading
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from freshet import scratch
from freshet.operators import joins
from freshet.operators.components import components
from freshet.progress import ticking


def folders(spark):
    return {p.name for p in (Path(scratch.scratch_root(spark).removeprefix("file://")) / "freshet").glob("*")}


def test_a_scope_deletes_what_it_does_not_keep(spark):
    before = folders(spark)
    with scratch.scope(spark) as outer:
        with scratch.scope(spark) as inner:
            a, b = scratch.cut(spark.range(3).toDF("a"), "a"), scratch.cut(spark.range(4).toDF("b"), "b")
            inner.keep(b)
            assert len(folders(spark) - before) == 2
        assert b.count() == 4 and len(folders(spark) - before) == 1
        with pytest.raises(Exception, match="(?i)path|file"):
            a.count()
        c = scratch.cut(spark.range(5).toDF("c"), "c")
        outer.release(c)
        assert len(folders(spark) - before) == 1 and c.count() == 5
    assert folders(spark) == before
    with pytest.raises(ValueError), scratch.scope(spark) as failed:
        failed.keep(scratch.cut(spark.range(1).toDF("a"), "a"))
        raise ValueError
    assert folders(spark) == before


def test_scopes_of_two_threads(spark):
    """A table that one thread wrote outlives the scope of another that opened earlier and ends later, and the other way round."""
    opened, written, ended = threading.Event(), threading.Event(), threading.Event()
    rows = {}

    def one():
        with scratch.scope(spark):
            opened.set()
            assert written.wait(60)
        ended.set()

    def two():
        assert opened.wait(60)
        with scratch.scope(spark):
            table = scratch.cut(spark.range(7).toDF("a"), "threads")
            written.set()
            assert ended.wait(60)
            rows["two"] = table.count()

    threads = [threading.Thread(target=f) for f in (one, two)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert rows == {"two": 7}


def test_tidy_shuffles_leaves_settings_as_they_were(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    with scratch.tidy_shuffles(spark):
        assert spark.conf.get(key) == "true" and spark.range(100).repartition(3).groupBy("id").count().count() == 100
    assert spark.conf.get(key, None) == before


class Cluster:
    """A session of a cluster that names no shared folder."""

    class conf:
        get = staticmethod(lambda name, default: default)

    class sparkContext:
        master = "spark://host:7077"


def test_a_cluster_must_name_a_shared_folder():
    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        scratch.scratch_root(Cluster)


@pytest.mark.parametrize("many", [4, 1000])
def test_spread_join(spark, monkeypatch, many):
    monkeypatch.setattr(joins, "MANY", many)
    df = spark.range(300).select(F.when(F.col("id") % 3 == 0, F.lit(0)).when(F.col("id") % 50 != 1, F.col("id")).alias("k"), F.col("id").alias("v"))
    side = df.where("k is not null and k % 7 <> 5").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("most"))
    for how in ("inner", "left"):
        got = joins.spread_join(df, side, "k", 300, how)
        want = df.join(side.drop("n"), "k", how)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        once = joins.spread_join(df, side, "k", 300, distinct=True).collect()
        assert len(once) == len({r.k for r in once}) == side.count()


@pytest.mark.parametrize("many", [4, 1000])
def test_components(spark, monkeypatch, many):
    monkeypatch.setattr(joins, "MANY", many)
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500, 501 + i) for i in range(100)] + [(i, i + 1) for i in range(700, 760)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    before = folders(spark)
    got = components(spark.createDataFrame(edges, "a long, b long"), "test")
    assert {(r.node, r.root) for r in got.collect()} == {(x, find(x)) for e in edges if e[0] != e[1] for x in e}
    assert len(folders(spark) - before) == 1
    assert components(spark.createDataFrame([], "a long, b long"), "test").count() == 0


def test_ticks_rise_while_tasks_end(spark):
    def slow(batches):
        time.sleep(0.15)
        yield from batches

    seen = []
    with ticking(spark, seen.append, 42, 92, every=0.05):
        assert spark.range(0, 40, 1, 40).mapInArrow(slow, "id long").count() == 40
    assert len(seen) > 3 and seen == sorted(set(seen)) and 42 < seen[0] and seen[-1] < 92
    ended = list(seen)
    spark.range(10).count()
    assert seen == ended
    with pytest.raises(ZeroDivisionError), ticking(spark, seen.append, 0, 10):
        1 / 0
