"""Shapefiles and dBASE tables: readers by ranges of records or by whole tiles, and a writer for points.

Where Python reaches the files (plain and `file:` paths), a tile is read by many tasks: each seeks to its own records,
whose places the .shx index gives. From any other store, and without an index, a tile is one row of bytes that Spark
reads; the format bounds it by two gigabytes. Both give the same rows.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from freshet.functions.geometry import PARTS
from freshet.operators.numbering import row_numbers
from freshet.scratch import cut, scope

#: The text that names WGS 84 degrees in a .prj file (fixed value).
WGS84_WKT = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'
Bbox = tuple[float, float, float, float]
#: Name, type and width of a dBASE field.
Field = tuple[str, str, int]

_HEADER_BYTES = 32 * 260  # a dBASE header has up to 255 fields of 32 bytes
#: Bytes of a tile that one task reads, and records that it turns into one batch.
PIECE, BATCH = 16 << 20, 4096


def dbf_fields(head: bytes) -> list[Field]:
    """Name, type and width of each field."""
    out, at = [], 32
    while head[at] != 0x0D:
        name, kind, width = head[at : at + 11].split(b"\0")[0].decode("ascii"), chr(head[at + 11]), head[at + 16]
        out.append((name, kind, width))
        at += 32
    return out


def _value(raw: bytes, kind: str):
    text = raw.decode("utf-8", "replace").strip(" \0")
    if kind in "NF":
        try:
            return float(text)
        except ValueError:
            return None
    if kind == "L":
        return None if text in ("", "?") else text in "YyTt"
    return text or None


def dbf_records(data: bytes, fields: list[Field], size: int, wanted: list[str]) -> Iterator[tuple | None]:
    """The values of the `wanted` fields of each record in `data`, records of `size` bytes; None for one marked as deleted."""
    starts = np.cumsum([1, *(width for _, _, width in fields)]).tolist()
    held = {name: (kind, start, start + width) for (name, kind, width), start in zip(fields, starts)}
    for at in range(0, len(data) - size + 1, size):
        if data[at : at + 1] == b"*":
            yield None
        else:
            yield tuple(_value(data[at + a : at + b], kind) for kind, a, b in (held[name] for name in wanted))


def outside(data: bytes, at: int, bbox: Bbox) -> bool:
    """Whether the bounds at this place of the file don't meet `bbox`."""
    west, south, east, north = struct.unpack_from("<4d", data, at)
    return west > bbox[2] or east < bbox[0] or south > bbox[3] or north < bbox[1]


def shape(data: bytes, bbox: Bbox | None = None) -> list[np.ndarray] | None:
    """The parts of a record's content, points as rows of x and y; a point is one part of one point, an empty shape, or one outside `bbox`, None."""
    kind = struct.unpack_from("<i", data)[0] if len(data) >= 4 else 0
    if kind in (1, 11, 21):
        return [np.frombuffer(data, "<f8", 2, 4).reshape(1, 2)]
    if kind not in (3, 5, 13, 15, 23, 25) or bbox and outside(data, 4, bbox):
        return None
    n_parts, n_points = struct.unpack_from("<2i", data, 36)
    starts = struct.unpack_from(f"<{n_parts}i", data, 44)
    points = np.frombuffer(data, "<f8", 2 * n_points, 44 + 4 * n_parts).reshape(-1, 2)
    return [points[a:b] for a, b in zip(starts, (*starts[1:], n_points))]


def shapes(data: bytes, bbox: Bbox | None = None) -> Iterator[list[np.ndarray] | None]:
    """The shape of each record of a whole .shp file."""
    at = 100
    while at + 8 <= len(data):
        end = at + 8 + 2 * struct.unpack_from(">I", data, at + 4)[0]
        yield shape(data[at + 8 : end], bbox)
        at = end


def parts_array(held: list[list[np.ndarray] | None]) -> pa.Array:
    """Shapes as an Arrow array of geometry.PARTS."""
    parts = [part for shape in held for part in shape or ()]
    points = np.concatenate([np.zeros((0, 2)), *parts])
    ends = lambda sizes: np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)
    xy = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(points[:, 0])), pa.array(np.ascontiguousarray(points[:, 1]))], ["x", "y"])
    inner = pa.ListArray.from_arrays(pa.array(ends([len(p) for p in parts])), xy)
    nowhere = np.array([*(shape is None for shape in held), False])
    return pa.ListArray.from_arrays(pa.array(ends([len(shape or ()) for shape in held]), mask=nowhere), inner)


def _batches(records: Iterable[tuple[int, tuple | None, list[np.ndarray] | None]], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Records of (file_row, values or None, shape) as batches, without the deleted ones."""
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        rows, values, found = zip(*held)
        columns = [*zip(*values), rows][: len(arrow)]
        arrays = [pa.array(c, type=f.type) for c, f in zip(columns, arrow)]
        return pa.RecordBatch.from_arrays([*arrays, parts_array(list(found)).cast(arrow[-1].type)] if len(arrays) < len(arrow) else arrays, schema=arrow)

    for record in records:
        if record[1] is not None:
            held.append(record)
        if len(held) == BATCH:
            yield batch()
            held.clear()
    if held:
        yield batch()


_SPARK_TYPES = {"N": "double", "F": "double", "L": "boolean"}


@dataclass
class Records(InputPartition):
    """`count` records of a tile from `first` on."""

    tile: int
    first: int
    count: int


class TileReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema = schema
        self.stems, self.wanted, self.bbox = (json.loads(options[k]) for k in ("stems", "wanted", "bbox"))
        self.shapes, self.piece = "parts" in schema.names, int(options["piece"])

    def partitions(self) -> list[Records]:
        """Stretches of records of about `piece` bytes; the index, of eight bytes a record, is all that is read of the shapes."""
        out = []
        for tile, stem in enumerate(self.stems):
            with open(f"{stem}.dbf", "rb") as file:
                count, _, size = struct.unpack("<IHH", file.read(12)[4:])
            weight = np.full(count, size, np.int64)
            if self.shapes:
                words = np.fromfile(f"{stem}.shx", ">i4", offset=100).reshape(-1, 2)[:count, 1]
                count, weight = len(words), weight[: len(words)] + 8 + 2 * words
            before = np.cumsum(weight) - weight
            firsts = np.unique(before // self.piece, return_index=True)[1].tolist() or [0]
            out += [Records(tile, a, b - a) for a, b in zip(firsts, [*firsts[1:], count])]
        return out

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        stem, first, count = self.stems[partition.tile], partition.first, partition.count
        with open(f"{stem}.dbf", "rb") as file:
            head = file.read(_HEADER_BYTES)
            start, size = struct.unpack("<HH", head[8:12])
            file.seek(start + first * size)
            values = dbf_records(file.read(count * size), dbf_fields(head), size, self.wanted)
        found = self._shapes(stem, first, count) if self.shapes else iter(lambda: None, 0)
        numbered = ((partition.tile << 40) + first + n for n in range(count))
        yield from _batches(zip(numbered, values, found), to_arrow_schema(self.schema))

    def _shapes(self, stem: str, first: int, count: int) -> Iterator[list[np.ndarray] | None]:
        places = np.fromfile(f"{stem}.shx", ">i4", 2 * count, offset=100 + 8 * first).reshape(-1, 2)
        with open(f"{stem}.shp", "rb", buffering=1 << 20) as file:
            for at, words in places.tolist():
                file.seek(2 * at + 8)
                yield shape(file.read(2 * words), self.bbox)


class Tiles(DataSource):
    """The data source behind `read`: its options and schema come from there."""

    @classmethod
    def name(cls) -> str:
        return "shapefile_records"

    def reader(self, schema: StructType) -> TileReader:
        return TileReader(schema, dict(self.options))


def _local(spark: SparkSession, path: str) -> str | None:
    """The path as Python opens it, if it lies in a file system of the machine (or one mounted on every machine)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.toUri().getPath() if at.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file" else None


def read(spark: SparkSession, paths: str | list[str], bbox: Bbox | None = None, columns: list[str] | None = None, piece: int = PIECE) -> DataFrame:
    """The attributes, `file_row` (tile and record in order) and, for .shp files, `parts` of each record.

    Tiles must agree in their fields; use tables.union_tiles on single reads otherwise. Of attributes, only `columns` are
    parsed if they are given. Lines and polygons outside `bbox` keep their row, but their points aren't read: `parts` is
    null. A task reads about `piece` bytes of records where a tile can be split.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    with_shapes = not paths[0].lower().endswith(".dbf")
    stems = [p.rsplit(".", 1)[0] for p in paths]
    tables = [f"{s}.dbf" for s in stems]
    head = spark.read.format("binaryFile").load(tables[0]).select(F.substring("content", 1, _HEADER_BYTES)).first()[0]
    fields = [f for f in dbf_fields(bytes(head)) if columns is None or f[0] in columns]
    wanted = [name for name, _, _ in fields]
    schema = ", ".join([*(f"`{name}` {_SPARK_TYPES.get(kind, 'string')}" for name, kind, _ in fields), "file_row long", *([f"parts {PARTS}"] if with_shapes else [])])
    local = [_local(spark, s) for s in stems]
    if all(s and os.path.exists(f"{s}.dbf") and (not with_shapes or os.path.exists(f"{s}.shx") and os.path.exists(f"{s}.shp")) for s in local):
        spark.dataSource.register(Tiles)
        options = {"stems": json.dumps(local), "wanted": json.dumps(wanted), "bbox": json.dumps(bbox), "piece": str(piece)}
        return spark.read.format(Tiles.name()).schema(schema).options(**options).load()
    return _whole(spark, paths, tables, stems, wanted, schema, bbox)


def _whole(spark: SparkSession, paths: list[str], tables: list[str], stems: list[str], wanted: list[str], schema: str, bbox: Bbox | None) -> DataFrame:
    """`read` with each tile as one row of bytes, from any store that Spark reaches."""
    with_shapes = tables != paths

    def content(files: list[str], name: str) -> DataFrame:
        raw = spark.read.format("binaryFile").load(files)
        return raw.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"), F.col("content").alias(name))

    tiles = content(tables, "dbf")
    if with_shapes:
        tiles = tiles.join(content(paths, "shp"), "stem")
    order = {s.rstrip("/").rsplit("/", 1)[-1]: i for i, s in enumerate(stems)}
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tile = order[batch.column("stem")[i].as_py()] << 40
                data = batch.column("dbf")[i].as_py()
                count, start, size = struct.unpack("<IHH", data[4:12])
                values = dbf_records(data[start : start + count * size], dbf_fields(data), size, wanted)
                found = shapes(batch.column("shp")[i].as_py(), bbox) if with_shapes else iter(lambda: None, 0)
                yield from _batches(((tile + n, row, held) for n, (row, held) in enumerate(zip(values, found))), arrow)

    return tiles.mapInArrow(run, schema)


#: Records that a task encodes at once; bytes that a file of the format may have.
BLOCK, LARGEST = 16_384, 2**31 - 1
_WIDTH = {"C": 64, "I": 18, "F": 24}


def _dbf_record(row: dict, kinds: dict[str, str]) -> bytes:
    out = bytearray(b" ")
    for name, kind in kinds.items():
        value, width = row[name], _WIDTH[kind]
        if kind == "F":
            text = "" if value is None or value != value else f"{value:.15g}" if abs(value) < 1e15 else f"{value:.12e}"
            out += text.rjust(width).encode()
        else:
            text = ("" if value is None else str(value)).encode()[:width]
            out += text.rjust(width) if kind == "I" else text.ljust(width)
    return bytes(out)


def _point_blocks(df: DataFrame, kinds: dict[str, str], x: str, y: str) -> DataFrame:
    """block, and the bytes of its records in each of the three files, compressed, as they go to the driver; `df` has `_record`, from 0."""

    def encode(block: pa.Table) -> pa.Table:
        block = block.sort_by("_record")
        record = block["_record"].to_numpy().astype(np.int64)
        shp = np.zeros(len(record), np.dtype([("number", ">i4"), ("words", ">i4"), ("kind", "<i4"), ("x", "<f8"), ("y", "<f8")]))
        shp["number"], shp["words"], shp["kind"], shp["x"], shp["y"] = record + 1, 10, 1, block[x].to_numpy(), block[y].to_numpy()
        shx = np.full((len(record), 2), 10, ">i4")
        shx[:, 0] = 50 + record * (shp.itemsize // 2)
        dbf = b"".join(_dbf_record(row, kinds) for row in block.to_pylist())
        return pa.table({"block": pa.array([int(record[0]) // BLOCK], pa.int64()), **{name: pa.array([zlib.compress(held)], pa.binary()) for name, held in (("shp", shp.tobytes()), ("shx", shx.tobytes()), ("dbf", dbf))}})

    return df.groupBy(F.floor(F.col("_record") / BLOCK).alias("block")).applyInArrow(encode, "block long, shp binary, shx binary, dbf binary")


def write_points(df: DataFrame, path: str, x: str = "LON", y: str = "LAT") -> None:
    """Write the rows in their order as a point shapefile in WGS84 degrees, to any store that Spark reaches.

    Tasks encode the records in compressed blocks; the driver unpacks and writes the blocks one after another, and holds those of one partition.
    A shapefile is one file: keep `df` to one month's points. A row without a place, and more rows than the format
    holds, raise ValueError before anything is written.
    """
    spark = df.sparkSession
    kinds = {name: "C" if kind == "string" else "I" if kind in ("bigint", "int", "smallint", "tinyint") else "F" for name, kind in df.dtypes}
    with scope(spark):
        placed = cut(df.withColumn("_at", F.monotonically_increasing_id()), "points")
        nowhere = F.col(x).isNull() | F.isnan(x) | F.col(y).isNull() | F.isnan(y)
        n, missing, *box = placed.agg(F.count(F.lit(1)), F.count_if(nowhere), *[F.coalesce(of(F.col(c).cast("double")), F.lit(0.0)) for of in (F.min, F.max) for c in (x, y)]).first()
        if missing:
            raise ValueError(f"{missing} points have no place")
        size = 1 + sum(_WIDTH[k] for k in kinds.values())
        if max(100 + 28 * n, 33 + 32 * len(kinds) + n * size) > LARGEST:
            raise ValueError(f"{n} points are more than a shapefile holds")
        blocks = cut(_point_blocks(row_numbers(placed, ["_at"], "_record", first=0).drop("_at"), kinds, x, y), "point-blocks")

        header = lambda body: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + body) // 2) + struct.pack("<2i8d", 1000, 1, *box, 0, 0, 0, 0)
        fields = b"".join(struct.pack("<11sc4xBB14x", name.encode("ascii")[:10], b"C" if kind == "C" else b"N", _WIDTH[kind], 15 if kind == "F" else 0) for name, kind in kinds.items())
        dbf = struct.pack("<4BIHH20x", 3, 126, 1, 1, n, 33 + 32 * len(kinds), size) + fields + b"\r"
        stem = re.sub(r"\.[^./]+$", "", path)
        for suffix, head, tail in (("shp", header(28 * n), b""), ("shx", header(8 * n), b""), ("dbf", dbf, b"\x1a")):
            bodies = (zlib.decompress(r[0]) for r in blocks.orderBy("block").select(suffix).toLocalIterator())
            write_file(spark, f"{stem}.{suffix}", chain([head], bodies, [tail]))
        write_file(spark, f"{stem}.prj", [WGS84_WKT.encode()])
        write_file(spark, f"{stem}.cpg", [b"UTF-8"])


def write_file(spark: SparkSession, path: str, pieces: Iterable[bytes]) -> None:
    """One file of the pieces, one after another, through Spark's file access."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        for piece in pieces:
            out.write(bytearray(piece))
    finally:
        out.close()
