"""Flowline sources: which reader a path needs, and one shape for what they give."""

from __future__ import annotations

from collections.abc import Callable
from fnmatch import fnmatchcase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions import crs, geometry
from freshet.functions.columns import lower_names, number
from freshet.operators.numbering import row_numbers
from freshet.sources import shapefile, tables

#: Layer and file names of the source data (fixed values).
FLOWLINE_LAYERS = ("NetworkNHDFlowline", "NHDFlowline")
VAA_LAYER = "NHDPlusFlowlineVAA"
TILE_PATTERN = "NHDFlowline_*.shp"

Bbox = tables.Bbox
#: (spark, geodatabase path, layer, bbox or None) -> DataFrame with `parts` where the layer has shapes
LayerReader = Callable[[SparkSession, str, str, Bbox | None], DataFrame]


def driver_layer_reader(spark: SparkSession, path: str, layer: str, bbox: Bbox | None = None) -> DataFrame:
    """Reads a geodatabase layer with pyogrio, where that is installed, on the driver; convert large ones instead (README)."""
    try:
        from pyogrio.raw import read_arrow
    except ImportError as error:
        raise RuntimeError("file geodatabases need pyogrio; convert the layer to GeoJSON lines or Parquet (README)") from error
    meta, table = read_arrow(path, layer=layer, bbox=bbox)
    at = meta.get("geometry_name") or "wkb_geometry"
    out = spark.createDataFrame(table)
    return geometry.from_wkb(out, at) if at in out.columns else out


def read_layer(spark: SparkSession, path: str, preferred: str | None, bbox: Bbox | None, reader: LayerReader) -> DataFrame:
    """The preferred layer, else the usual ones in turn; the last error if none can be read."""
    error: Exception | None = None
    for layer in dict.fromkeys(filter(None, (preferred, *FLOWLINE_LAYERS))):
        try:
            return reader(spark, path, layer, bbox)
        except Exception as e:  # noqa: BLE001  any failure means the next layer
            error = e
    raise error


def _suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[1].lower() if "." in name else ""


def listed(spark: SparkSession, folder: str) -> list[tuple[str, bool]] | None:
    """What a folder holds and whether each is a folder, in order, on any store that Spark reaches; None if it isn't a folder.

    Paths have a scheme where `folder` has one.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at) or not files.getFileStatus(at).isDirectory():
        return None
    bare = at.toUri().getScheme() is None
    return sorted((f.getPath().toUri().getPath() if bare else f.getPath().toString(), f.isDirectory()) for f in files.listStatus(at))


def _tiles(spark: SparkSession, folder: str) -> list[str]:
    return [path for path, _ in listed(spark, folder) or () if fnmatchcase(path.rsplit("/", 1)[-1], TILE_PATTERN)]


def _stores(spark: SparkSession, source: str) -> list[str]:
    """The geodatabases, which are folders, at or below `source`, in order."""
    if _suffix(source) == ".gdb":
        return [source]
    below = listed(spark, source) or ()
    return sorted(store for path, is_folder in below if is_folder for store in _stores(spark, path))


def read(spark: SparkSession, source: str, layer: str | None = None, bbox: Bbox | None = None, reader: LayerReader = driver_layer_reader) -> DataFrame:
    """A .gdb, a folder of them (searched through), a folder of shapefile tiles, a folder of Parquet files, or one file."""
    if _suffix(source) == ".gdb":
        return normalised(read_layer(spark, source, layer, bbox, reader))
    held = None if _suffix(source) in (".parquet", ".csv", ".json", ".geojsonl", ".geojsons") else listed(spark, source)
    if held is None:
        return normalised(tables.read_any(spark, source, bbox, ordered=True))
    stores = _stores(spark, source)
    if stores:
        out = tables.union_tiles([read_layer(spark, s, layer, bbox, reader) for s in stores])
        if out.isEmpty():
            raise ValueError(f"no flowlines inside the bounds in {source}")
        return normalised(out)
    tiles = _tiles(spark, source)
    if tiles:
        return normalised(tables.union_tiles([shapefile.read(spark, t, bbox).withColumn("file_row", F.col("file_row") + (i << 40)) for i, t in enumerate(tiles)]))
    if any(_suffix(path) == ".parquet" or is_folder and "=" in path.rsplit("/", 1)[-1] for path, is_folder in held):
        return normalised(tables.read_any(spark, source, bbox, ordered=True))
    raise FileNotFoundError(f"{source} has neither geodatabases nor {TILE_PATTERN} nor Parquet files")


def crs_of(spark: SparkSession, source: str) -> crs.Crs | None:
    """The coordinate system of a source's lines, None where nothing says it; tiles of different systems are an error."""
    if listed(spark, source) is None:
        return tables.crs_of(spark, source)
    found = {str(held): held for held in (tables.crs_of(spark, t) for t in _tiles(spark, source)) if held}
    if len(found) > 1:
        raise ValueError(f"the tiles in {source} have {len(found)} coordinate systems")
    return next(iter(found.values()), None)


def embedded_vaa(spark: SparkSession, source: str, reader: LayerReader = driver_layer_reader) -> DataFrame:
    """The routing table of every geodatabase below `source`; ones that can't be read are left out."""
    found = []
    for store in _stores(spark, source):
        try:
            found.append(lower_names(reader(spark, store, VAA_LAYER, None)))
        except Exception:  # noqa: BLE001, S112  left out by intent
            continue
    if not found:
        raise ValueError(f"no routing table in {source}")
    out = tables.union_tiles(found)
    return out.withColumn("nhdplusid", number("nhdplusid")) if "nhdplusid" in out.columns else out


def normalised(df: DataFrame) -> DataFrame:
    """Lower-case names, `permanent_` as text from whichever column has it, `nhdplusid` as a number."""
    df = lower_names(df)
    if "permanent_" in df.columns:
        df = df.withColumn("permanent_", F.col("permanent_").cast("string"))
    elif "permanent_identifier" in df.columns:
        df = df.withColumn("permanent_", F.col("permanent_identifier").cast("string"))
    else:
        order = ["file_row"] if "file_row" in df.columns else [c for c, kind in df.dtypes if "map" not in kind]
        df = row_numbers(df, order, "permanent_").withColumn("permanent_", F.col("permanent_").cast("string"))
    return df.withColumn("nhdplusid", number("nhdplusid")) if "nhdplusid" in df.columns else df
