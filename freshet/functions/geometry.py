"""Geometry as columns of type array<array<struct<x:double,y:double>>>: the parts of a line, or the rings of a polygon (SP5-SP8)."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = "array<array<struct<x:double,y:double>>>"


def segments(parts: Column) -> Column:
    """All segments of all parts as structs (x1, y1, x2, y2)."""
    per_part = F.transform(
        parts,
        lambda p: F.zip_with(
            F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))),
            F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))),
            lambda a, b: F.struct(a.x.alias("x1"), a.y.alias("y1"), b.x.alias("x2"), b.y.alias("y2")),
        ),
    )
    return F.flatten(per_part)


def _length(s: Column) -> Column:
    return F.sqrt((s.x2 - s.x1) * (s.x2 - s.x1) + (s.y2 - s.y1) * (s.y2 - s.y1))


def length(parts: Column) -> Column:
    """SP6: the sum of the segments' lengths, in the coordinates' unit."""
    return F.aggregate(segments(parts), F.lit(0.0), lambda acc, s: acc + _length(s))


def centroid(parts: Column) -> Column:
    """SP5: the mean of the segments' midpoints weighted by length, as struct(x, y); a line of no length has its points' mean."""
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("w"))
    total = F.aggregate(
        segments(parts),
        zero,
        lambda acc, s: F.struct((acc.x + _length(s) * (s.x1 + s.x2) / 2).alias("x"), (acc.y + _length(s) * (s.y1 + s.y2) / 2).alias("y"), (acc.w + _length(s)).alias("w")),
    )
    points = F.flatten(parts)
    mean = F.aggregate(points, zero, lambda acc, p: F.struct((acc.x + p.x).alias("x"), (acc.y + p.y).alias("y"), (acc.w + 1.0).alias("w")))
    return F.when(total.w > 0, F.struct((total.x / total.w).alias("x"), (total.y / total.w).alias("y"))).otherwise(F.struct((mean.x / mean.w).alias("x"), (mean.y / mean.w).alias("y")))


def transformed(parts: Column, fn) -> Column:
    """Each point through fn(x, y) -> (x, y)."""

    def point(p: Column) -> Column:
        x, y = fn(p.x, p.y)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(parts, lambda part: F.transform(part, point))


def bounds(df: DataFrame, parts: str = "parts") -> tuple[float, float, float, float] | None:
    """SP7, A13: west, south, east, north of the whole table; None when it has no point."""
    points = F.flatten(parts)
    xs, ys = F.transform(points, lambda p: p.x), F.transform(points, lambda p: p.y)
    row = df.agg(F.min(F.array_min(xs)), F.min(F.array_min(ys)), F.max(F.array_max(xs)), F.max(F.array_max(ys))).first()
    return None if row[0] is None else tuple(row)


def box(parts: Column) -> tuple[Column, Column, Column, Column]:
    """West, south, east, north of each row's points; null without one."""
    points = F.flatten(parts)
    xs, ys = F.transform(points, lambda p: p.x), F.transform(points, lambda p: p.y)
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def curve(x: Column, y: Column, within: tuple[float, float, float, float]) -> Column:
    """A point's place on a Z-order curve over the box `within`, with 2^15 steps a side: near places have near points."""

    def spread(value: Column, low: float, high: float) -> Column:
        step = F.least(F.greatest(F.floor((value - low) / ((high - low) or 1.0) * (1 << 15)), F.lit(0)), F.lit((1 << 15) - 1)).cast("long")
        # A zero bit between any two bits.
        for by, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            step = step.bitwiseOR(F.shiftleft(step, by)).bitwiseAND(F.lit(mask).cast("long"))
        return step

    west, south, east, north = within
    return spread(x, west, east).bitwiseOR(F.shiftleft(spread(y, south, north), 1))


def from_geojson(kind: Column, coordinates: Column) -> Column:
    """Parts from a GeoJSON geometry's type and the text of its coordinates; further dimensions are left out."""
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    rings = lambda c: F.transform(c, lambda r: F.transform(r, point))
    by_depth = [
        (("Point",), F.array(F.array(point(F.from_json(coordinates, "array<double>"))))),
        (("LineString", "MultiPoint"), rings(F.array(F.from_json(coordinates, "array<array<double>>")))),
        (("MultiLineString", "Polygon"), rings(F.from_json(coordinates, "array<array<array<double>>>"))),
        (("MultiPolygon",), rings(F.flatten(F.from_json(coordinates, "array<array<array<array<double>>>>")))),
    ]
    out = F.lit(None).cast(PARTS)
    for kinds, parts in by_depth:
        out = F.when(kind.isin(*kinds), parts).otherwise(out)
    return out


def wkb_parts(data: bytes | None) -> list[list[dict]] | None:
    """Parts from well-known binary, in either byte order, with or without an SRID; further dimensions are left out."""
    if not data:
        return None
    out: list[list[dict]] = []

    def read(at: int) -> int:
        order = "<" if data[at] else ">"
        (code,) = struct.unpack_from(order + "I", data, at + 1)
        kind, at = code % 1000 & 0xFF if code < 1 << 28 else code & 0xFF, at + 5
        extra = code // 1000 % 4 if code < 1 << 28 else (code >> 31 & 1) + (code >> 30 & 1)
        dims = 2 + ((extra + 1) // 2 if code < 1 << 28 else extra)
        if code & 0x20000000:
            at += 4

        def points(at: int, n: int) -> int:
            values = struct.unpack_from(f"{order}{n * dims}d", data, at)
            out.append([{"x": x, "y": y} for x, y in zip(values[::dims], values[1::dims])])
            return at + 8 * n * dims

        if kind == 1:
            return points(at, 1)
        (n,) = struct.unpack_from(order + "I", data, at)
        at += 4
        if kind == 2:
            return points(at, n)
        for _ in range(n):
            if kind == 3:
                (m,) = struct.unpack_from(order + "I", data, at)
                at = points(at + 4, m)
            else:
                at = read(at)
        return at

    read(0)
    return out


def from_wkb(df: DataFrame, column: str) -> DataFrame:
    """`df` with `parts` in place of a column of well-known binary."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    rest = [c for c in df.columns if c != column]
    schema = StructType([*(df.schema[c] for c in rest), *StructType.fromDDL(f"parts {PARTS}")])

    def run(batches):
        arrow = to_arrow_schema(schema)
        for batch in batches:
            parts = pa.array([wkb_parts(g) for g in batch.column(len(rest)).to_pylist()], arrow.field(len(rest)).type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], parts], schema=arrow)

    return df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{column}`")).mapInArrow(run, schema)
