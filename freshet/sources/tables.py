"""Delimited and columnar tables: control points, gage crosswalk, routing attributes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions import crs, geometry
from freshet.functions.columns import lower_names, require
from freshet.operators.numbering import row_numbers
from freshet.sources import shapefile

#: Columns of the control-point file (fixed values).
CP_COLUMNS = ("UP_CP", "Next_DS_CP", "ChLosFac", "LAT", "LONG")


#: Columns of Parquet tables that hold a shape's bounds, if they are there.
BOUNDS = ("xmin", "ymin", "xmax", "ymax")

Bbox = tuple[float, float, float, float]


def in_file_order(df: DataFrame) -> DataFrame:
    """`df`, as read from files, with file_row: a sort key (file, split, place in it) that follows the files' names and their rows."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return df.withColumn("file_row", at)


def read_any(spark: SparkSession, path: str, bbox: Bbox | None = None, ordered: bool = False) -> DataFrame:
    """A table by its suffix: .csv, .dbf, .shp, .json, GeoJSON lines (.geojsonl, .geojsons) or Parquet.

    Shapes are in `parts`; a Parquet table may have them as well-known binary in `geometry`. With `bbox`, shapes that
    lie outside it may be left out: those of a Parquet table whose rows have their bounds, before they are read. Rows
    without an id of their own are all kept, since their place gives them one. With `ordered`, rows get their place in
    the files as `file_row`, which shapefiles always have, and Parquet tables that keep one.
    """
    placed = in_file_order if ordered else lambda df: df
    kind = path.lower().rstrip("/").rsplit(".", 1)[-1]
    if kind == "csv":
        return placed(spark.read.csv(path, header=True))
    if kind in ("dbf", "shp"):
        return shapefile.read(spark, path, bbox)
    if kind in ("geojsonl", "geojsons"):
        return geojson_lines(spark, path, ordered)
    if kind == "json":
        return placed(spark.read.json(path))
    out = spark.read.parquet(path)
    lower = {c.lower(): c for c in out.columns}
    if bbox and set(BOUNDS) <= set(lower) and {"permanent_", "permanent_identifier"} & set(lower):
        west, south, east, north = bbox
        xmin, ymin, xmax, ymax = (F.col(lower[c]) for c in BOUNDS)
        out = out.where((xmin <= east) & (xmax >= west) & (ymin <= north) & (ymax >= south))
    out = out if "file_row" in lower else placed(out)
    at = lower.get("geometry")
    if at and dict(out.dtypes)[at] == "binary" and "parts" not in lower:
        out = geometry.from_wkb(out, at)
    return out


def crs_of(spark: SparkSession, path: str) -> crs.Crs | None:
    """The coordinate system that a source names: a shapefile's .prj, degrees for GeoJSON; None where nothing says it."""
    kind = path.lower().rstrip("/").rsplit(".", 1)[-1]
    if kind in ("geojsonl", "geojsons"):
        return crs.Crs()
    if kind != "shp":
        return None
    beside = spark._jvm.org.apache.hadoop.fs.Path(path[:-4] + ".prj")
    if not beside.getFileSystem(spark._jsc.hadoopConfiguration()).exists(beside):
        return None
    return crs.from_wkt(spark.read.text(path[:-4] + ".prj", wholetext=True).first()[0])


def geojson_lines(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """One feature a line: its properties as columns, and `parts`. Files of any size are read in parallel."""
    kinds = dict(spark.read.json(path).dtypes)
    if not kinds.get("properties", "").startswith("struct"):
        raise ValueError(f"no features with properties in {path}")
    held = spark.read.schema(f"properties {kinds['properties']}, geometry struct<type: string, coordinates: string>").json(path)
    held = in_file_order(held) if ordered else held
    return held.select("properties.*", geometry.from_geojson(F.col("geometry.type"), F.col("geometry.coordinates")).alias("parts"), *["file_row"] * ordered)


def control_points(spark: SparkSession, path: str) -> DataFrame:
    """Ids as text, so that leading zeros stay; `file_row` (0, 1, ...) is the order of the file, which later folds follow, of the files' names where there are several."""
    raw = in_file_order(require(spark.read.csv(path, header=True), *CP_COLUMNS).select(*CP_COLUMNS))
    numbered = row_numbers(raw.withColumnRenamed("file_row", "_place"), ["_place"], "file_row", first=0)
    return numbered.select("UP_CP", "Next_DS_CP", *[F.col(c).cast("double").alias(c) for c in CP_COLUMNS[2:]], "file_row")


def crosswalk(spark: SparkSession, path: str) -> DataFrame:
    """Distinct pairs of gage_id and COMID."""
    raw = require(spark.read.csv(path, header=True), "gage_id", "COMID")
    return raw.select("gage_id", F.col("COMID").cast("double").cast("long").alias("COMID")).distinct()


def vaa(spark: SparkSession, path: str) -> DataFrame:
    """A table of routing attributes, names in lower case."""
    return lower_names(read_any(spark, path))


def union_tiles(tables: list[DataFrame]) -> DataFrame:
    """All rows of all tiles; a column that a tile lacks is null there."""
    if not tables:
        raise ValueError("no tables to put together")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def vpu_codes(flowlines: DataFrame, rows: int = 200_000, names: int = 25) -> DataFrame:
    """The first region codes among the first rows, for a message. No other column is read."""
    return flowlines.select(F.col("vpuid").cast("string").alias("vpuid")).limit(rows).dropna().distinct().orderBy("vpuid").limit(names)


def vpu_sample(flowlines: DataFrame) -> list[str]:
    return [r.vpuid for r in vpu_codes(flowlines).collect()] if "vpuid" in flowlines.columns else []
