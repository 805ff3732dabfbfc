"""Basins and the lines that touch them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions import geometry
from freshet.operators.joins import MANY
from freshet.scratch import cut

#: Names that a basin field goes by, best first (fixed values).
BASIN_FIELDS = ("basin_name", "basin", "name", "riverbasin")
PREFERRED_BASIN = "Brazos"
#: A cell with more of the lines' pieces than PIECES has quarters if it has more than EDGES edges too, or a great share of all rows of pieces. Only
#: pieces that fit a cell count: longer ones lie in many quarters, so that these would hold as many of them as the cell.
EDGES, PIECES = 64, 256
#: How often cells are quartered: pieces that lie closer than that aren't told apart.
DEPTH = 20


def basin(polygons: DataFrame, field: str, value: str) -> DataFrame:
    """the rows whose field equals the value without regard to case; KeyError and ValueError as there are none. Null never matches."""
    if field not in polygons.columns:
        raise KeyError(f"the basin table has no column {field}")
    out = polygons.where(F.lower(F.col(field).cast("string")) == value.lower())
    if out.isEmpty():
        raise ValueError(f"no basin has {field} = {value}")
    return out


def basin_field(polygons: DataFrame) -> str:
    """V4: the column that names basins: a usual name, else the first text column."""
    lower = {c.lower(): c for c in reversed(polygons.columns)}
    for name in BASIN_FIELDS:
        if name in lower:
            return lower[name]
    for name, kind in polygons.dtypes:
        if kind == "string":
            return name
    raise ValueError("the basin table has no text column")


def basin_names(polygons: DataFrame, field: str) -> DataFrame:
    """The distinct names in order."""
    return polygons.select(F.col(field).cast("string").alias("name")).dropna().distinct().orderBy("name")


def basin_options(polygons: DataFrame) -> tuple[str, list[str], str]:
    """V4: the field, its names, and the one to start with. Names fill a list to pick from, so they are few."""
    field = basin_field(polygons)
    names = [r.name for r in basin_names(polygons, field).collect()]
    if not names:
        raise ValueError("the basin table has no names")
    return field, names, PREFERRED_BASIN if PREFERRED_BASIN in names else names[0]


def _cells(df: DataFrame, size: float) -> DataFrame:
    """A row for each cell that the bounds of a segment (x1, y1, x2, y2) touch."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.least(a, b) / size), F.floor(F.greatest(a, b) / size)))
    return df.withColumn("cx", span("x1", "x2")).withColumn("cy", span("y1", "y2"))


def _side(ax: str, ay: str, bx: str, by: str, px: str, py: str) -> Column:
    c = F.col
    return (c(bx) - c(ax)) * (c(py) - c(ay)) - (c(by) - c(ay)) * (c(px) - c(ax))


def _within(ax: str, ay: str, bx: str, by: str, px: str, py: str) -> Column:
    return F.col(px).between(F.least(ax, bx), F.greatest(ax, bx)) & F.col(py).between(F.least(ay, by), F.greatest(ay, by))


def intersecting(lines: DataFrame, polygons: DataFrame, size: float | None = None) -> DataFrame:
    """The lines (parts, ...) that touch any polygon (parts: rings, even-odd), whole, as often as they are there.

    Rows are told apart by a number that they get here, not by an id of theirs: ids may be missing or occur twice.
    A line touches a polygon when one of its segments crosses or touches an edge of it, or else when its parts' first
    points lie inside. Segments and edges meet in cells, which have quarters where both crowd. For points, each cell's corner is known to lie inside or not, and
    only the edges of the point's own cell that are passed on the way from there change that. Lines outside
    the polygons' bounds drop out first. `size` is the width of the largest cells, by default a 64th of the polygons' extent.
    """
    box = geometry.bounds(polygons)
    if box is None:
        return lines.where(F.lit(False))
    west, south, east, north = box
    size = size or max(east - west, north - south, 1e-9) / 64
    xs = F.transform(F.flatten("parts"), lambda p: p.x)
    ys = F.transform(F.flatten("parts"), lambda p: p.y)
    near = (F.array_min(xs) <= east) & (F.array_max(xs) >= west) & (F.array_min(ys) <= north) & (F.array_max(ys) >= south)
    numbered = cut(lines.where(near).withColumn("_line", F.monotonically_increasing_id()), "lines")
    inside_box = numbered.select(F.col("_line").alias("comid"), "parts")

    named = polygons.withColumn("polygon", F.xxhash64(F.to_json("parts")))
    edge = named.select("polygon", F.explode(geometry.segments(F.col("parts"))).alias("e")).select("polygon", *[F.col(f"e.{a}").alias(f"e{a}") for a in ("x1", "y1", "x2", "y2")])
    edge_cells = _cells(edge.select("polygon", *[F.col(f"e{a}").alias(a) for a in ("x1", "y1", "x2", "y2")]), size).select("polygon", "cx", "cy", *[F.col(a).alias(f"e{a}") for a in ("x1", "y1", "x2", "y2")])

    pieces = inside_box.select("comid", F.explode(geometry.segments(F.col("parts"))).alias("s")).select("comid", "s.*")
    clipped = pieces.where((F.greatest("x1", "x2") >= west) & (F.least("x1", "x2") <= east) & (F.greatest("y1", "y2") >= south) & (F.least("y1", "y2") <= north))
    # Cells beyond the bounds hold no edges: a long segment is only spread over those inside.
    lo = lambda v, low: F.greatest(v, F.lit(low))
    hi = lambda v, high: F.least(v, F.lit(high))
    spread = clipped.withColumn(
        "cx", F.explode(F.sequence(F.floor(lo(F.least("x1", "x2"), west) / size), F.floor(hi(F.greatest("x1", "x2"), east) / size)))
    ).withColumn("cy", F.explode(F.sequence(F.floor(lo(F.least("y1", "y2"), south) / size), F.floor(hi(F.greatest("y1", "y2"), north) / size))))
    a, b = ("x1", "y1", "x2", "y2"), ("ex1", "ey1", "ex2", "ey2")
    starts = inside_box.select("comid", F.posexplode("parts").alias("part", "points")).select("comid", "part", F.col("points")[0]["x"].alias("px"), F.col("points")[0]["y"].alias("py"))
    starts = starts.withColumn("cx", F.floor(F.col("px") / size)).withColumn("cy", F.floor(F.col("py") / size))
    edge_cells, spread, starts, corners = quartered(edge_cells, spread, starts, _odd_cells(edge, size, west), size, spread.count())

    d1, d2 = _side(*b, "x1", "y1"), _side(*b, "x2", "y2")
    d3, d4 = _side(*a, "ex1", "ey1"), _side(*a, "ex2", "ey2")
    touches = ((d1 == 0) & _within(*b, "x1", "y1")) | ((d2 == 0) & _within(*b, "x2", "y2")) | ((d3 == 0) & _within(*a, "ex1", "ey1")) | ((d4 == 0) & _within(*a, "ex2", "ey2"))
    crosses = (F.signum(d1) * F.signum(d2) < 0) & (F.signum(d3) * F.signum(d4) < 0)
    crossing = spread.join(edge_cells, _CELL).where(touches | crosses).select("comid")
    odd = starts.join(corners, _CELL).select("comid", "part", "polygon", F.lit(1).alias("n"))
    passed = starts.join(edge_cells, _CELL).select("comid", "part", "polygon", _legs(F.lit(size) / F.pow(F.lit(2.0), "level"), F.col("px"), F.col("py")).alias("n")).where("n > 0")
    inside = odd.unionAll(passed).groupBy("comid", "part", "polygon").agg(F.sum("n").alias("n")).where("n % 2 = 1").select("comid")
    found = crossing.unionAll(inside).select(F.col("comid").alias("_line")).distinct()
    return numbered.join(found, "_line", "left_semi").drop("_line")


_CELL = ["level", "cx", "cy"]


def quartered(edges: DataFrame, pieces: DataFrame, starts: DataFrame, corners: DataFrame, size: float, total: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The four tables with `level`, rows of crowded cells (cx, cy) moved to those of the cells' quarters that they touch, and so on.

    Cells of a level are `size` / 2**level wide. `corners` has the cells whose lower left corner lies inside a polygon; a
    quarter's corner is a point of its cell, so the cell's own edges tell. `total` is the number of the pieces' rows.
    """
    tables, held = [edges, pieces, starts, corners], None
    for level in range(DEPTH + 1):
        edges, pieces, starts, corners = tables
        busy = None
        if level < DEPTH:
            counted = lambda df, n: df.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias(n))
            fits = F.greatest(F.abs(F.col("x1") - F.col("x2")), F.abs(F.col("y1") - F.col("y2"))) <= size / 2**level
            both = counted(edges, "edges").join(counted(pieces.where(fits).select("cx", "cy").unionAll(starts.select("cx", "cy")), "lines"), ["cx", "cy"])
            busy = both.where((F.col("lines") > PIECES) & ((F.col("edges") > EDGES) | (F.col("lines") * MANY > total)))
            busy = cut(busy.select("cx", "cy"), "cells-busy")
            busy = None if busy.isEmpty() else busy
        kept = [(t if busy is None else t.join(busy, ["cx", "cy"], "left_anti")).withColumn("level", F.lit(level)) for t in tables]
        held = kept if held is None else [h.unionByName(k) for h, k in zip(held, kept)]
        if busy is None:
            return tuple(held)
        width = size / 2**level
        ends = (("ex1", "ex2", "ey1", "ey2"), ("x1", "x2", "y1", "y2"), ("px", "px", "py", "py"))
        moved = [cut(_in_quarters(t.join(busy, ["cx", "cy"], "left_semi"), width / 2, *e), "cells-quartered") for t, e in zip(tables, ends)]
        quarters = busy.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).select("cx", "cy", (F.col("cx") * 2 + F.col("k") % 2).alias("qx"), (F.col("cy") * 2 + F.floor(F.col("k") / 2)).alias("qy"))
        legs = _legs(F.lit(width), F.col("qx") * F.lit(width / 2), F.col("qy") * F.lit(width / 2))
        odd = quarters.join(corners, ["cx", "cy"]).select("polygon", "qx", "qy", F.lit(1).alias("n"))
        odd = odd.unionAll(quarters.join(edges, ["cx", "cy"]).select("polygon", "qx", "qy", legs.alias("n")).where("n > 0"))
        odd = odd.groupBy("polygon", "qx", "qy").agg(F.sum("n").alias("n")).where("n % 2 = 1").select("polygon", F.col("qx").alias("cx"), F.col("qy").alias("cy"))
        tables = [*moved, cut(odd, "cells-corners")]


def _in_quarters(df: DataFrame, size: float, x1: str, x2: str, y1: str, y2: str) -> DataFrame:
    """A row for each quarter, `size` wide, of its cell that the row's bounds touch."""
    quarter = lambda c, a, b: F.explode(F.sequence(F.greatest(F.floor(F.least(a, b) / size), F.col(c) * 2), F.least(F.floor(F.greatest(a, b) / size), F.col(c) * 2 + 1)))
    return df.withColumn("cx", quarter("cx", x1, x2)).withColumn("cy", quarter("cy", y1, y2))


def _legs(size: Column, px: Column, py: Column) -> Column:
    """How often an edge is passed on the way from the lower left corner of the cell (cx, cy) up, then along to the point.

    A corner that lies on an edge counts as a trifle to the right of it, and far less above: what rises there is over it.
    """
    left, low = F.col("cx") * size, F.col("cy") * size
    at, rises = _at(left, "x", "y"), (F.col("ex1") < F.col("ex2")) == (F.col("ey1") < F.col("ey2"))
    over = lambda y: (at > y) | ((at == y) & rises & (F.col("ey1") != F.col("ey2")))
    up = _passes("ex1", "ex2", left) & (over(low) != over(py))
    along = _passes("ey1", "ey2", py) & ((_at(py, "y", "x") > left) != (_at(py, "y", "x") > px))
    return up.cast("int") + along.cast("int")


def _passes(a: str, b: str, level: Column) -> Column:
    """Whether an edge's ends lie on two sides of a level; an end on the level counts as below it."""
    return (F.col(a) > level) != (F.col(b) > level)


def _at(level: Column, axis: str, other: str) -> Column:
    """Where an edge passes a level of an axis, on the other axis; null where it runs along it."""
    a1, a2, b1, b2 = (F.col(f"e{c}{i}") for c in (axis, other) for i in (1, 2))
    return F.when(level == a2, F.when(a1 != a2, b2)).otherwise(b1 + (level - a1) * (b2 - b1) / F.nullif(a2 - a1, F.lit(0.0)))


def _odd_cells(edge: DataFrame, size: float, west: float) -> DataFrame:
    """polygon, cx, cy of the cells whose lower left corner has an odd number of the polygon's edges to its right, so lies inside."""
    row = F.sequence(F.floor(F.least("ey1", "ey2") / size), F.floor(F.greatest("ey1", "ey2") / size))
    level = F.col("cy") * F.lit(size)
    passed = edge.withColumn("cy", F.explode(row)).where(_passes("ey1", "ey2", level))
    # An edge lies to the right of the corners up to `last`.
    counts = passed.groupBy("polygon", "cy", (F.ceil(_at(level, "y", "x") / size) - 1).alias("last")).agg(F.count(F.lit(1)).alias("n"))
    # In a row of cells, as many numbers as cells: from the right, how many edges follow, and where the next one to the left is.
    from_right = Window.partitionBy("polygon", "cy").orderBy(F.desc("last"))
    first = F.lit(math.floor(west / size) - 1).cast("long")
    runs = counts.select("polygon", "cy", "last", F.coalesce(F.lead("last").over(from_right), first).alias("before"), F.sum("n").over(from_right).alias("n"))
    return runs.where("n % 2 = 1 and last > before").select("polygon", "cy", F.explode(F.sequence(F.col("before") + 1, F.col("last"))).alias("cx"))
