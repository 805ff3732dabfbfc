"""Cutting lineage: tables written to the shared folder that the cluster names in spark.checkpoint.dir.

A table is let go when the `scope` it was written in ends, unless the scope keeps it, and in any case when the
session's JVM ends.
"""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: The scopes that are open in this thread or task, innermost last: queries of two threads don't share any.
_scopes: contextvars.ContextVar[tuple[Scope, ...]] = contextvars.ContextVar("scopes", default=())


def scratch_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this machine where that is unset, in local mode only: RuntimeError on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="freshet-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _at(spark: SparkSession, path: str):
    """The path's file system, and the path as it knows it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


class Scope:
    """The tables written while it is the innermost one."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.tables: list[tuple[DataFrame, str]] = []
        self.kept: list[tuple[DataFrame, str]] = []

    def keep(self, *tables: DataFrame) -> None:
        """Let `tables`, as `cut` returned them, outlive the scope; the surrounding scope owns them then."""
        self.kept += [(df, path) for df, path in self.tables if any(df is t for t in tables)]
        self.tables = [(df, path) for df, path in self.tables if not any(df is t for t in tables)]

    def release(self, *but: DataFrame) -> None:
        """Delete the tables written so far, without `but`. What was read from them must be written by now."""
        gone = [path for df, path in self.tables if not any(df is t for t in but)]
        self.tables = [(df, path) for df, path in self.tables if path not in gone]
        for path in gone:
            files, at = _at(self.spark, path)
            files.delete(at, True)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    """Tables written inside are deleted at the end, but for those kept; after an error, all of them."""
    held = Scope(spark)
    outer = _scopes.get()
    _scopes.set((*outer, held))
    try:
        yield held
    except BaseException:
        held.tables += held.kept
        held.kept = []
        raise
    finally:
        _scopes.set(outer)
        held.release()
        if outer:
            outer[-1].tables += held.kept


@contextlib.contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that end inside are deleted at their end, not when the driver's memory is next collected."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def new_folder(spark: SparkSession, tag: str) -> str:
    """A folder's path of its own in the shared folder; what is in it goes when the session's JVM ends."""
    path = f"{scratch_root(spark)}/freshet/{tag}-{uuid.uuid4().hex}"
    files, at = _at(spark, path)
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def cut(df: DataFrame, tag: str, *by: str) -> DataFrame:
    """Write `df` once, in folders by the columns `by`, and read it back. Loops do this each round: plans stay short and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/freshet/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    files, at = _at(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    if open_ := _scopes.get():
        open_[-1].tables.append((out, path))
    return out
