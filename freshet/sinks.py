"""Results as files (K1, K2), and flowlines laid out for pruned reads (S3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.functions import geometry
from freshet.functions.columns import clipped, scientific
from freshet.operators.numbering import row_numbers
from freshet.scratch import scope
from freshet.sources import shapefile, tables


def write_flows(flows: DataFrame, path: str) -> None:
    """K1: date, COMID, flow_cms, lat, lon in order of date and network.

    A path that ends in .csv becomes one file with a header; unknown numbers are empty in it. Any other path becomes
    Parquet by year, which has no single writer.
    """
    plain = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    order = ("date", "topo_level", "comid")
    if path.lower().endswith(".csv"):
        columns = [F.date_format("date", "yyyy-MM-dd").alias("date"), F.col("comid").alias("COMID"), *map(plain, ("flow_cms", "lat", "lon"))]
        _write_csv(flows.repartitionByRange(*order).sortWithinPartitions(*order).select(*columns), path)
    else:
        columns = ["date", F.col("comid").alias("COMID"), "flow_cms", "lat", "lon"]
        parted = flows.withColumn("year", F.year("date")).repartitionByRange("year", *order).sortWithinPartitions(*order)
        parted.select("year", *columns).write.mode("overwrite").partitionBy("year").parquet(path)


def _write_csv(df: DataFrame, path: str) -> None:
    """The rows as one file: sorted and written in parts by all tasks, then put one after another through Spark's file access."""
    spark = df.sparkSession
    jvm, parts = spark._jvm, path + "-parts"
    df.write.mode("overwrite").csv(parts)
    folder, target = jvm.org.apache.hadoop.fs.Path(parts), jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    files = folder.getFileSystem(conf)
    names = sorted(f.getPath().toString() for f in files.listStatus(folder) if f.getPath().getName().startswith("part-"))
    if files.exists(target):
        files.delete(target, True)
    out = files.create(target, True)
    try:
        out.write(bytearray((",".join(df.columns) + "\n").encode()))
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(name)
            part = files.open(at)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            part.close()
            files.delete(at, False)  # the rows aren't on disk twice
    finally:
        out.close()
    files.delete(folder, True)


def write_flowlines(lines: DataFrame, path: str, page_rows: int = 4096) -> None:
    """Lines as Parquet in the order of their places, each with its bounds, so that a read of a box skips files, row groups and pages.

    `file_row` becomes a number, 0, 1, ..., so that ids that follow the order of the source still do. Lines without a
    point keep null bounds, and no box holds them. Bounds are those of `tables.BOUNDS`, in the lines' own coordinates.
    """
    with scope(lines.sparkSession):
        numbered = row_numbers(lines.withColumnRenamed("file_row", "_place"), ["_place"], "file_row", first=0).drop("_place")
        bounded = numbered.withColumns(dict(zip(tables.BOUNDS, geometry.box(F.col("parts")))))
        whole = bounded.agg(F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax")).first()
        within = (0.0, 0.0, 0.0, 0.0) if whole[0] is None else tuple(whole)
        order = [geometry.curve((F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2, within), F.col("file_row")]
        placed = bounded.repartitionByRange(*order).sortWithinPartitions(*order)
        placed.write.mode("overwrite").option("parquet.page.row.count.limit", page_rows).option("parquet.block.size", 32 << 20).parquet(path)


def points_of(flows: DataFrame, day: str) -> DataFrame:
    """One month as DATE, COMID, FLOW_CMS, FLOW_TXT, LAT, LON; ValueError when the month isn't there."""
    month = flows.where(F.col("date") == F.lit(day).cast("date"))
    out = month.select(
        F.date_format("date", "yyyy-MM-dd").alias("DATE"),
        F.col("comid").alias("COMID"),
        clipped("flow_cms").alias("FLOW_CMS"),
        scientific("flow_cms").alias("FLOW_TXT"),
        F.col("lat").alias("LAT"),
        F.col("lon").alias("LON"),
    )
    if out.isEmpty():
        raise ValueError(f"no flows for {day}")
    return out


def write_points(flows: DataFrame, path: str, day: str) -> None:
    """K2: one month's points as a shapefile: one row for each segment."""
    shapefile.write_points(points_of(flows, day), path)
