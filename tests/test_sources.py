"""Readers, writers, scalar expressions, geometry, and a whole model run from files."""

import math
import random
import struct
import zlib
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from freshet import sinks
from freshet.__main__ import parse_args
from freshet.config import ModelConfig
from freshet.convert import convert
from freshet.functions import columns, crs, geometry
from freshet.operators import network, spatial
from freshet.plans.model import build_network, centroids, in_system, run_model
from freshet.sources import archives, flo, flowlines, shapefile, tables
from freshet.streaming import observations


def one(spark, expr):
    return spark.range(1).select(expr).first()[0]


def test_flo(spark, tmp_path):
    path = tmp_path / "a.flo"
    values = "  ".join(str(10 * m) for m in range(1, 13))
    path.write_text(f"  S1  2010  {values}\nshort 2010 1 2\nS0\t2010 {values} extra tokens\n")
    got = flo.read(spark, str(path)).collect()
    assert len(got) == 24 and (got[0].date, got[0].gage_id, got[0].acft) == (date(2010, 1, 1), "S0", 10.0)
    path.write_text("short\n")
    with pytest.raises(ValueError, match="no flow rows"):
        flo.read(spark, str(path))
    for bad in (f"S1 2010 {values.replace('120', 'x')}", f"S1 2010 x {values}", f"S1 201x {values}"):
        path.write_text(f"S0 2011 {values}\n{bad}\n")
        with pytest.raises(Exception, match="CAST_INVALID_INPUT"):  # by reading alone, whatever is used of it
            flo.read(spark, str(path))


def test_stream_reads_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = "S1 2010 " + " ".join(map(str, range(1, 13)))
    for name in ("a", "b"):
        (tmp_path / "in" / name).write_text(line + "\n")
        observations.append(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 24


def test_scalars(spark):
    unit = lambda acft, day: one(spark, columns.acft_month_to_cms(F.lit(acft), F.lit(day).cast("date")))
    assert unit(4980.0, "2010-01-01") == pytest.approx(2.293436216845878, rel=1e-15)
    assert unit(10719.0, "2010-02-01") == pytest.approx(5.465315741964286, rel=1e-15)
    assert unit(3559716.0, "2016-06-01") == pytest.approx(1693.9988586255554, rel=1e-15)
    assert [str(r.date) for r in columns.months(spark, "2010-01-15", "2010-04-01").collect()] == ["2010-02-01", "2010-03-01", "2010-04-01"]
    assert columns.months(spark, "2010-02-15", "2010-02-20").count() == 0
    assert one(spark, columns.scientific(F.lit(12345.678))) == "1.234568e+04"
    assert one(spark, columns.clipped(F.lit(1e30))) == 1e20
    assert [one(spark, columns.whole_id(F.lit(v))) for v in (0.5, 1.5, 2.4)] == [0, 2, 2]
    assert [one(spark, columns.number(F.lit(v))) for v in ("1.5", "x", "NaN")] == [1.5, None, None]
    assert columns.linspace(0.0, 1.0, 3) == [0.0, 0.5, 1.0] and columns.linspace(2.0, 9.0, 1) == [2.0] and columns.linspace(0.0001, 0.005, 30)[-1] == 0.005
    with pytest.raises(KeyError):
        columns.require(spark.range(1), "x")
    with pytest.raises(ValueError, match="case"):
        columns.lower_names(spark.range(1).select(F.col("id").alias("a"), F.col("id").alias("A")))


def test_utm(spark):
    e, n = crs.to_utm(F.lit(-97.0), F.lit(31.0), 14)
    assert one(spark, e) == pytest.approx(690950.464, abs=1e-3) and one(spark, n) == pytest.approx(3431318.844, abs=1e-3)
    lon, lat = crs.from_utm(e, n, 14)
    assert one(spark, lon) == pytest.approx(-97, abs=1e-8) and one(spark, lat) == pytest.approx(31, abs=1e-8)
    assert [crs.utm_zone(*b) for b in ((-98, -96), (-180, -180), (179, 180))] == [14, 1, 60]


#: Published worked examples of the projections (Clarke 1866): degrees and metres.
CLARKE = 'SPHEROID["Clarke_1866",6378206.4,294.978698213898]'
EXAMPLES = [
    (f'PROJCS["a",GEOGCS["g",DATUM["d",{CLARKE}]],PROJECTION["Albers"],PARAMETER["Central_Meridian",-96.0],PARAMETER["Standard_Parallel_1",29.5],PARAMETER["Standard_Parallel_2",45.5],PARAMETER["Latitude_Of_Origin",23.0],UNIT["Meter",1.0]]', (-75.0, 35.0), (1885472.7, 1535925.0)),
    (f'PROJCS["l",GEOGCS["g",DATUM["d",{CLARKE}]],PROJECTION["Lambert_Conformal_Conic"],PARAMETER["Central_Meridian",-96.0],PARAMETER["Standard_Parallel_1",33.0],PARAMETER["Standard_Parallel_2",45.0],PARAMETER["Latitude_Of_Origin",23.0],UNIT["Meter",1.0]]', (-75.0, 35.0), (1894410.9, 1564649.5)),
    (f'PROJCS["t",GEOGCS["g",DATUM["d",{CLARKE}]],PROJECTION["Transverse_Mercator"],PARAMETER["Central_Meridian",-75.0],PARAMETER["Scale_Factor",0.9996],PARAMETER["Latitude_Of_Origin",0.0],UNIT["Meter",1.0]]', (-73.5, 40.5), (127106.5, 4484124.4)),
]


@pytest.mark.parametrize(("text", "degrees", "metres"), EXAMPLES)
def test_projections(spark, text, degrees, metres):
    system = crs.from_wkt(text)
    x, y = crs.from_degrees(system)(F.lit(degrees[0]), F.lit(degrees[1]))
    row = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert (row.x, row.y) == pytest.approx(metres, abs=0.1)
    for shift in ('PARAMETER["False_Easting",1500.0],PARAMETER["False_Northing",-700.0],', ""):
        moved = crs.from_wkt(text.replace("PARAMETER", shift + "PARAMETER", 1).replace('"Meter",1.0', '"Foot_US",0.3048006096012192'))
        points = spark.createDataFrame([(degrees[0] + i / 3, degrees[1] - i / 5) for i in range(-9, 9)], "lon double, lat double")
        x, y = crs.from_degrees(moved)(F.col("lon"), F.col("lat"))
        lon, lat = crs.to_degrees(moved)(F.col("x"), F.col("y"))
        for r in points.withColumns({"x": x, "y": y}).select("*", lon.alias("lon2"), lat.alias("lat2")).collect():
            assert abs(r.lon2 - r.lon) < 1e-8 and abs(r.lat2 - r.lat) < 1e-8
    first = points.withColumns({"x": x, "y": y}).where(f"lon = {degrees[0]}").first()
    assert (first.x * 0.3048006096012192, first.y * 0.3048006096012192) == pytest.approx(metres, abs=0.1)


def test_systems(spark, tmp_path):
    assert crs.from_wkt(shapefile.WGS84_WKT).geographic
    with pytest.raises(ValueError, match="unknown projection"):
        crs.from_wkt(EXAMPLES[0][0].replace('"Albers"', '"Robinson"'))
    with pytest.raises(ValueError, match="ellipsoid"):
        crs.from_wkt("LOCAL")
    web = crs.from_wkt('PROJCS["w",GEOGCS["g",DATUM["d",SPHEROID["WGS_1984",6378137.0,298.257223563]]],PROJECTION["Mercator_Auxiliary_Sphere"],PARAMETER["Central_Meridian",0.0],UNIT["Meter",1.0]]')
    x, y = crs.from_degrees(web)(F.lit(-97.0), F.lit(31.0))
    lon, lat = crs.between(web, crs.from_wkt(shapefile.WGS84_WKT))(x, y)
    row = spark.range(1).select(x.alias("x"), y.alias("y"), lon.alias("lon"), lat.alias("lat")).first()
    assert tuple(row) == pytest.approx((-10797990.6, 3632749.1, -97.0, 31.0), abs=0.1)
    (tmp_path / "a.prj").write_text(EXAMPLES[0][0])
    assert tables.crs_of(spark, str(tmp_path / "a.shp")).kind == "albers" and tables.crs_of(spark, str(tmp_path / "b.shp")) is None
    for name, text in (("NHDFlowline_1", EXAMPLES[0][0]), ("NHDFlowline_2", EXAMPLES[1][0])):
        (tmp_path / f"{name}.prj").write_text(text)
        (tmp_path / f"{name}.shp").write_bytes(b"")
    with pytest.raises(ValueError, match="2 coordinate systems"):
        flowlines.crs_of(spark, str(tmp_path))


def test_a_projected_network_is_in_degrees(spark):
    system = crs.from_wkt(EXAMPLES[0][0])
    degrees = spark.createDataFrame([(f"P{i}", float(i), float(i), float(i + 1), float(9 - i), [[{"x": -97.0 + i, "y": 31.0}, {"x": -96.9 + i, "y": 31.0}]]) for i in range(1, 5)], f"permanent_ string, nhdplusid double, fromnode double, tonode double, hydroseq double, parts {geometry.PARTS}")
    flow = degrees.withColumn("parts", geometry.transformed(F.col("parts"), crs.from_degrees(system)))
    square = spark.createDataFrame([([[{"x": x, "y": y} for x, y in ((-98.0, 30.0), (-94.5, 30.0), (-94.5, 32.0), (-98.0, 32.0), (-98.0, 30.0))]],)], f"parts {geometry.PARTS}")
    net = build_network(spark, flow, in_system(square, crs.Crs(), system), system=system)
    plain = build_network(spark, degrees, square)
    assert net.zone == plain.zone is not None
    at = lambda n: {r.comid: (r.lon, r.lat) for r in centroids(n).collect()}
    got, want = at(net), at(plain)
    assert set(got) == set(want) == {1, 2} and all(got[c] == pytest.approx(want[c], abs=1e-7) for c in got)


def test_unknown_flows_are_empty_in_the_csv(spark, tmp_path):
    flows = spark.createDataFrame([(date(2010, 1, 1), 7, float("nan"), 31.5, None, 0), (date(2010, 1, 1), 8, 2.5, 31.5, -97.0, 1)], "date date, comid long, flow_cms double, lat double, lon double, topo_level long")
    for _ in range(2):  # a file that is there is replaced
        sinks.write_flows(flows, str(tmp_path / "o.csv"))
    assert (tmp_path / "o.csv").read_text() == "date,COMID,flow_cms,lat,lon\n2010-01-01,7,,31.5,\n2010-01-01,8,2.5,31.5,-97.0\n"


def line(*points):
    return [[{"x": float(x), "y": float(y)} for x, y in points]]


def test_geometry(spark):
    df = spark.createDataFrame([(line((0, 0), (3, 4), (3, 10)),), (line((2, 2), (2, 2)),)], f"parts {geometry.PARTS}")
    got = df.select(geometry.length(F.col("parts")).alias("len"), geometry.centroid(F.col("parts")).alias("c")).collect()
    assert got[0].len == 11 and (got[0].c.x, got[0].c.y) == pytest.approx(((5 * 1.5 + 6 * 3) / 11, (5 * 2 + 6 * 7) / 11))
    assert (got[1].c.x, got[1].c.y) == (2, 2)
    assert geometry.bounds(df) == (0, 0, 3, 10) and geometry.bounds(df.limit(0)) is None


def test_intersects_equals_a_plain_version(spark):
    rng = random.Random(5)
    outer = [(0, 0), (50, -10), (90, 30), (60, 80), (20, 60), (-20, 40), (0, 0)]
    hole = [(20, 20), (40, 20), (40, 40), (20, 40), (20, 20)]
    square = [(100, 100), (120, 100), (120, 120), (100, 120), (100, 100)]
    rings = [[outer, hole], [square]]
    lines = [[(x := rng.uniform(-40, 130), y := rng.uniform(-40, 130)), (x + rng.uniform(-15, 15), y + rng.uniform(-15, 15))] for _ in range(300)]

    def inside(p, polygon):
        odd = False
        for ring in polygon:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
                if (y1 > p[1]) != (y2 > p[1]) and p[0] < (x2 - x1) * (p[1] - y1) / (y2 - y1) + x1:
                    odd = not odd
        return odd

    def crosses(a, b, c, d):
        side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
        return side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0

    expected = {i for i, (a, b) in enumerate(lines) if any(inside(a, p) or any(crosses(a, b, c, d) for ring in p for c, d in zip(ring, ring[1:])) for p in rings)}
    flow = spark.createDataFrame([(i, line(*x)) for i, x in enumerate(lines)], f"comid long, parts {geometry.PARTS}")
    basin = spark.createDataFrame([([line(*r)[0] for r in p],) for p in rings], f"parts {geometry.PARTS}")
    for size in (None, 7.0, 40.0, 1000.0):
        assert {r.comid for r in spatial.intersecting(flow, basin, size).collect()} == expected
    assert spatial.intersecting(flow, basin.limit(0)).count() == 0


@pytest.mark.parametrize("edges, pieces", [(2, 3)])
def test_crowded_cells_have_quarters(spark, monkeypatch, edges, pieces):
    monkeypatch.setattr(spatial, "EDGES", edges)
    monkeypatch.setattr(spatial, "PIECES", pieces)
    monkeypatch.setattr(spatial, "DEPTH", 3)
    test_intersects_equals_a_plain_version(spark)


def test_long_lines_are_not_quartered(spark, monkeypatch):
    """Many lines longer than the cells, over a basin of few edges: quarters would hold as many of them each, so there are none."""
    monkeypatch.setattr(spatial, "PIECES", 8)
    basin = spark.createDataFrame([([[{"x": x, "y": y} for x, y in ((0.0, 0.0), (64.0, 0.0), (64.0, 64.0), (0.0, 64.0), (0.0, 0.0))]],)], f"parts {geometry.PARTS}")
    ends = [((x * 1.3 - 10, y * 1.7 - 10), (x * 1.3 - 5, y * 1.7 - 3)) for x in range(60) for y in range(45)]
    lines = spark.createDataFrame([(i, line(*e)) for i, e in enumerate(ends)], f"comid long, parts {geometry.PARTS}")
    plain, held = spatial.quartered, {}
    monkeypatch.setattr(spatial, "quartered", lambda *args: held.setdefault("cells", plain(*args)))
    got = {r.comid for r in spatial.intersecting(lines, basin).collect()}
    assert held["cells"][1].agg(F.max("level")).first()[0] == 0

    def meets(a, b):  # the stretches of the line within both sides' bounds share one
        spans = [sorted(((0 - p) / (q - p), (64 - p) / (q - p))) for p, q in zip(a, b)]
        return max(0, *(low for low, _ in spans)) <= min(1, *(high for _, high in spans))

    assert got == {i for i, e in enumerate(ends) if meets(*e)}


def test_lines_in_one_corner_of_a_basin(spark, monkeypatch):
    """A round basin of 20,000 edges, and lines that crowd at one place of it: no cell holds many of both."""
    monkeypatch.setattr(spatial, "PIECES", 64)
    n, held = 20_000, {}
    ring = [{"x": 100 * math.cos(2 * math.pi * i / n), "y": 100 * math.sin(2 * math.pi * i / n)} for i in range(n)]
    basin = spark.createDataFrame([([[*ring, ring[0]]],)], f"parts {geometry.PARTS}")
    rng = random.Random(3)
    places = [(70.7 + rng.gauss(0, 0.5), 70.7 + rng.gauss(0, 0.5), rng.uniform(-0.05, 0.05)) for _ in range(4000)] + [(-90.0, 0.0, 1.0), (99.9, 0.0, 1.0), (101.0, 0.0, 1.0)]
    lines = spark.createDataFrame([(i, line((x, y), (x + d, y + d))) for i, (x, y, d) in enumerate(places)], f"comid long, parts {geometry.PARTS}")
    plain = spatial.quartered

    def watched(*args):
        held["cells"] = plain(*args)
        return held["cells"]

    monkeypatch.setattr(spatial, "quartered", watched)
    got = {r.comid for r in spatial.intersecting(lines, basin).collect()}
    apothem = 100 * math.cos(math.pi / n)
    ends = lambda x, y, d: [math.hypot(x, y), math.hypot(x + d, y + d)]
    sure = {i: min(ends(*p)) < apothem for i, p in enumerate(places) if not any(apothem <= r <= 100 for r in ends(*p))}
    assert len(sure) > 3990 and {i for i in got if i in sure} == {i for i, inside in sure.items() if inside}
    edges, pieces = held["cells"][:2]
    of = lambda df, c: df.groupBy("level", "cx", "cy").agg(F.count(F.lit(1)).alias(c))
    most = of(edges, "e").join(of(pieces, "p"), ["level", "cx", "cy"]).agg(F.max(F.col("e") * F.col("p")), F.max("level")).first()
    assert most[0] <= 64 * 4000 and most[1] >= 2
    assert of(edges, "e").join(of(pieces, "p"), ["level", "cx", "cy"]).where("p > 64 and e > 64").count() == 0


def test_lines_go_by_their_row(spark):
    """Repeated and missing ids, and whole rows that are there twice; a COMID that occurs twice inside the basin is an error."""
    line = lambda x: [[{"x": x, "y": 1.0}, {"x": x + 0.5, "y": 1.0}]]
    rows = [("A", line(1.0)), ("A", line(1.0)), ("B", line(2.0)), ("C", line(50.0)), (None, line(1.5)), (None, line(60.0)), ("A", line(70.0))]
    flow = spark.createDataFrame([(p, float(i), float(i), float(i + 1), float(9 - i), x) for i, (p, x) in enumerate(rows)], f"permanent_ string, nhdplusid double, fromnode double, tonode double, hydroseq double, parts {geometry.PARTS}")
    basin = spark.createDataFrame([([[{"x": x, "y": y} for x, y in ((0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (0.0, 3.0), (0.0, 0.0))]],)], f"parts {geometry.PARTS}")
    inside = spatial.intersecting(flow, basin)
    assert inside.columns == flow.columns and sorted(r.nhdplusid for r in inside.collect()) == [0.0, 1.0, 2.0, 4.0]
    assert sorted(r.comid for r in build_network(spark, flow, basin).segments.collect()) == [0, 1, 2, 4]
    with pytest.raises(ValueError, match="COMID 0 occurs 2 times"):
        build_network(spark, flow.withColumn("nhdplusid", F.when(F.col("nhdplusid") > 1, F.col("nhdplusid")).otherwise(0.0)), basin)


def test_basins(spark):
    df = spark.createDataFrame([(1, "BRAZOS"), (2, "Trinity"), (3, None)], "id long, Basin string")
    assert [r.id for r in spatial.basin(df, "Basin", "brazos").collect()] == [1]
    assert spatial.basin_options(df) == ("Basin", ["BRAZOS", "Trinity"], "BRAZOS")
    assert spatial.basin_field(df.withColumnRenamed("Basin", "label")) == "label"
    with pytest.raises(KeyError):
        spatial.basin(df, "basin_name", "x")
    with pytest.raises(ValueError, match="no basin"):
        spatial.basin(df, "Basin", "nan")
    with pytest.raises(ValueError, match="text column"):
        spatial.basin_field(df.select("id"))


def test_point_shapefile_round_trip(spark, tmp_path):
    flows = spark.createDataFrame([(date(2010, 1, 1), 7, 12345.678, 31.5, -97.25), (date(2010, 2, 1), 7, 1.0, 31.5, -97.25)], "date date, comid long, flow_cms double, lat double, lon double")
    sinks.write_points(flows, str(tmp_path / "deep" / "points.shp"), "2010-01-01")
    row, = shapefile.read(spark, str(tmp_path / "deep" / "points.shp")).collect()
    assert (row.DATE, row.COMID, row.FLOW_TXT) == ("2010-01-01", 7.0, "1.234568e+04") and row.FLOW_CMS == pytest.approx(12345.678)
    assert (row.parts[0][0].x, row.parts[0][0].y) == (-97.25, 31.5)
    assert (tmp_path / "deep" / "points.prj").read_text().startswith("GEOGCS")
    assert tables.read_any(spark, str(tmp_path / "deep" / "points.dbf")).count() == 1
    with pytest.raises(ValueError, match="no flows"):
        sinks.write_points(flows, str(tmp_path / "x.shp"), "2011-01-01")
    with pytest.raises(ValueError, match="1 points have no place"):
        sinks.write_points(flows.withColumn("lat", F.lit(None).cast("double")), str(tmp_path / "x.shp"), "2010-01-01")
    assert not list(tmp_path.glob("x.*"))


def test_points_are_written_in_blocks(spark, tmp_path, monkeypatch):
    """The files' bytes are those of one plain writer, wherever blocks and partitions end; a second run replaces the first."""
    monkeypatch.setattr(shapefile, "BLOCK", 7)
    rows = [(f"név {i}" if i % 5 else None, i * 10**12, None if i % 4 == 0 else -1.5 / (i + 1), -97.0 + i / 8, 31.0 - i / 16) for i in range(40)]
    schema = "NAME string, COMID long, FLOW double, LON double, LAT double"
    for n in (0, 1, 40):
        df = spark.createDataFrame(rows[:n], schema).repartition(1).repartitionByRange(3, "LON").sortWithinPartitions("LON")
        shapefile.write_points(df, str(tmp_path / "p.shp"))
        number = lambda v: (f"{v:.15g}" if v is not None else "").rjust(24).encode()
        text = lambda v: (v or "").encode()[:64].ljust(64)
        dbf = b"".join(b" " + text(a) + str(b).rjust(18).encode() + number(c) + number(d) + number(e) for a, b, c, d, e in rows[:n])
        shp = b"".join(struct.pack(">2i", i + 1, 10) + struct.pack("<i2d", 1, r[3], r[4]) for i, r in enumerate(rows[:n]))
        shx = b"".join(struct.pack(">2i", 50 + 14 * i, 10) for i in range(n))
        xs, ys = [r[3] for r in rows[:n]] or [0.0], [r[4] for r in rows[:n]] or [0.0]
        for suffix, body in (("shp", shp), ("shx", shx)):
            head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, 1, min(xs), min(ys), max(xs), max(ys), 0, 0, 0, 0)
            assert (tmp_path / f"p.{suffix}").read_bytes() == head + body
        assert (tmp_path / "p.dbf").read_bytes()[33 + 32 * 5 :] == dbf + b"\x1a"
        assert shapefile.read(spark, str(tmp_path / "p.shp")).count() == n
    monkeypatch.setattr(shapefile, "LARGEST", 1000)
    with pytest.raises(ValueError, match="more than a shapefile holds"):
        shapefile.write_points(df, str(tmp_path / "q.shp"))


def polyline(path, shapes, names, bounds=False):
    """A line shapefile with one text field."""
    shp, dbf = bytearray(), bytearray(struct.pack("<4BIHH20x", 3, 126, 1, 1, len(shapes), 65, 11))
    dbf += struct.pack("<11sc4xBB14x", b"NAME", b"C", 10, 0) + b"\r"
    for i, (points, name) in enumerate(zip(shapes, names)):
        xs, ys = zip(*points)
        box = (min(xs), min(ys), max(xs), max(ys)) if bounds else (0, 0, 0, 0)
        body = struct.pack("<i4d2ii", 3, *box, 1, len(points), 0) + b"".join(struct.pack("<2d", *p) for p in points)
        shp += struct.pack(">2i", i + 1, len(body) // 2) + body
        dbf += b" " + name.encode().ljust(10)
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(shp)) // 2) + struct.pack("<2i8d", 1000, 3, *[0.0] * 8)
    path.with_suffix(".shp").write_bytes(head + shp)
    path.with_suffix(".dbf").write_bytes(dbf)


def indexed(path, shapes, deleted=()):
    """A line shapefile with an index; shapes are lists of parts or None, and the records lie in the file from last to first."""
    fields = b"".join(struct.pack("<11sc4xBB14x", name, kind, width, 0) for name, kind, width in ((b"NAME", b"C", 10), (b"SIZE", b"N", 8), (b"OPEN", b"L", 1)))
    dbf = bytearray(struct.pack("<4BIHH20x", 3, 126, 1, 1, len(shapes), 32 * 4 + 1, 20) + fields + b"\r")
    bodies = []
    for i, parts in enumerate(shapes):
        points = [p for part in parts or () for p in part]
        starts = [sum(map(len, parts[:k])) for k in range(len(parts))] if parts else []
        box = (min(x for x, _ in points), min(y for _, y in points), max(x for x, _ in points), max(y for _, y in points)) if points else ()
        body = struct.pack("<i4d2i", 3, *box, len(starts), len(points)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points) if parts else struct.pack("<i", 0)
        bodies.append(struct.pack(">2i", i + 1, len(body) // 2) + body)
        dbf += (b"*" if i in deleted else b" ") + f"n{i}".encode().ljust(10) + (b"x" if i % 5 == 0 else str(i).encode()).rjust(8) + b"T?F"[i % 3 : i % 3 + 1]
    shp, places = b"", {}
    for i in reversed(range(len(bodies))):
        places[i] = 50 + len(shp) // 2
        shp += bodies[i]
    shx = b"".join(struct.pack(">2i", places[i], (len(bodies[i]) - 8) // 2) for i in range(len(bodies)))
    for suffix, data in ((".shp", shp), (".shx", shx)):
        path.with_suffix(suffix).write_bytes(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(data)) // 2) + struct.pack("<2i8d", 1000, 3, *[0.0] * 8) + data)
    path.with_suffix(".dbf").write_bytes(dbf)


def test_a_tile_is_read_by_many_tasks(spark, tmp_path):
    """Records of several parts, empty and deleted ones, by index; every size of piece gives the same rows."""
    shapes = [None if i % 11 == 3 else [[(i + k / 8, k) for k in range(2 + i % 4)] for _ in range(1 + i % 3)] for i in range(200)]
    indexed(tmp_path / "a", shapes, deleted={0, 7, 199})
    expected = [(f"n{i}", None if i % 5 == 0 else float(i), (True, None, False)[i % 3], i, s and [[tuple(map(float, p)) for p in part] for part in s]) for i, s in enumerate(shapes) if i not in {0, 7, 199}]
    path, rows = str(tmp_path / "a.shp"), None
    for piece, tasks in ((1, 200), (5000, None), (1 << 20, 1)):
        df = shapefile.read(spark, f"file://{path}", piece=piece)
        n = df.rdd.getNumPartitions()
        assert n == tasks if tasks else 2 < n < 20
        rows = [(r.NAME, r.SIZE, r.OPEN, r.file_row, r.parts and [[(p.x, p.y) for p in part] for part in r.parts]) for r in df.orderBy("file_row").collect()]
        assert rows == expected
    some = shapefile.read(spark, path, (10, 0, 20, 9), columns=["SIZE"], piece=3000)
    assert some.columns == ["SIZE", "file_row", "parts"]
    inside = {i for i, s in enumerate(shapes) if s and i <= 20 and max(x for part in s for x, _ in part) >= 10}
    assert {r.file_row for r in some.collect() if r.parts} == inside - {0, 7, 199} and some.count() == 197
    table = shapefile.read(spark, str(tmp_path / "a.dbf"), columns=["NAME"], piece=500)
    assert table.rdd.getNumPartitions() > 5 and sorted((r.file_row, r.NAME) for r in table.collect()) == [(e[3], e[0]) for e in expected]
    indexed(tmp_path / "none", [])
    assert shapefile.read(spark, str(tmp_path / "none.shp")).count() == 0


def test_whole_tiles_give_the_same_rows(spark, tmp_path):
    """Without an index a tile is one row of bytes; so it is on stores that only Spark reaches."""
    for name in ("a", "b"):
        polyline(tmp_path / name, [[(i, 0), (i, 1 + j)] for j in range(3) for i in range(5)], [f"{name}{i}" for i in range(15)], bounds=True)
    paths = [str(tmp_path / f"{name}.shp") for name in ("b", "a")]
    whole = shapefile.read(spark, paths, (0, 0, 2, 2)).orderBy("file_row").collect()
    assert [r.NAME for r in whole] == [f"{name}{i}" for name in ("b", "a") for i in range(15)]
    for name in ("a", "b"):
        data, places, at = (tmp_path / f"{name}.shp").read_bytes(), [], 100
        while at < len(data):
            words = struct.unpack(">I", data[at + 4 : at + 8])[0]
            places.append(struct.pack(">2i", at // 2, words))
            at += 8 + 2 * words
        (tmp_path / f"{name}.shx").write_bytes(data[:100] + b"".join(places))
    split = shapefile.read(spark, paths, (0, 0, 2, 2), piece=200)
    assert split.rdd.getNumPartitions() > 6 and split.orderBy("file_row").collect() == whole


def test_shapes_outside_the_bounds_are_not_read(spark, tmp_path):
    polyline(tmp_path / "a", [[(0, 0), (0, 1)], [(50, 2), (50, 3)]], ["in", "out"], bounds=True)
    rows = shapefile.read(spark, str(tmp_path / "a.shp"), (-1, -1, 1, 1)).orderBy("file_row").collect()
    assert [(r.NAME, r.parts is None) for r in rows] == [("in", False), ("out", True)]
    boxes = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 1.0), ("b", 5.0, 5.0, 6.0, 6.0)], "Permanent_ string, xmin double, ymin double, xmax double, ymax double")
    boxes.write.parquet(str(tmp_path / "b.parquet"))
    pruned = flowlines.read(spark, str(tmp_path / "b.parquet"), None, (0.5, 0.5, 2.0, 2.0))
    assert [r.permanent_ for r in pruned.collect()] == ["a"]
    assert "PushedFilters: [IsNotNull" in pruned._jdf.queryExecution().toString() and tables.read_any(spark, str(tmp_path / "b.parquet")).count() == 2
    boxes.drop("Permanent_").write.parquet(str(tmp_path / "c.parquet"))
    assert tables.read_any(spark, str(tmp_path / "c.parquet"), (0.5, 0.5, 2.0, 2.0)).count() == 2  # their place is their id


def test_flowlines_laid_out_by_place(spark, tmp_path):
    """A box reads a small share of the rows; ids, their order and rows without a shape stay."""
    rows = [(1000 - i, None if i == 5 else [[{"x": -100 + (i * 37 % 100) / 10, "y": 30 + (i * 61 % 99) / 10}, {"x": -99.95 + (i * 37 % 100) / 10, "y": 30.05 + (i * 61 % 99) / 10}]]) for i in range(4000)]
    source, target = str(tmp_path / "source.parquet"), str(tmp_path / "by_place.parquet")
    ordered = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, name int, parts {geometry.PARTS}").repartition(1).sortWithinPartitions("i").drop("i")
    ordered.write.parquet(source)
    before = {r.permanent_: r.name for r in flowlines.read(spark, source).collect()}
    for _ in range(2):
        whole = convert(spark, source, target)
        assert {r.permanent_: r.name for r in whole.collect()} == before and sorted(r.file_row for r in whole.collect()) == list(range(4000))
        assert {int(r.permanent_) - 1 for r in whole.where("parts is null").collect()} == {5} == {r.file_row for r in whole.where("xmin is null").collect()}
    sinks.write_flowlines(whole.drop(*tables.BOUNDS).repartition(4), target + "2", page_rows=50)
    box = (-97.0, 33.0, -96.5, 33.5)
    part = flowlines.read(spark, target + "2", bbox=box)
    held = {r.file_row for r in part.collect()}
    meets = lambda a, b: b["x"] >= box[0] and a["x"] <= box[2] and b["y"] >= box[1] and a["y"] <= box[3]
    assert held == {i for i, (_, parts) in enumerate(rows) if parts and meets(*parts[0])} and held
    part._jdf.queryExecution().executedPlan().executeCollect()
    scan = part._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numOutputRows").value() < 4000 / 4
    with pytest.raises(ValueError, match="must not be the source"):
        convert(spark, target, target + "/")
    x, y = F.lit(5.0), F.lit(3.0)
    assert one(spark, geometry.curve(x, y, (0.0, 0.0, 32768.0, 32768.0))) == 0b011011 and one(spark, geometry.curve(x, y, (5.0, 3.0, 5.0, 3.0))) == 0


def test_geojson_lines(spark, tmp_path):
    (tmp_path / "layer.geojsonl").write_text(
        """{"type":"Feature","properties":{"NHDPlusID":1.5,"Permanent_Identifier":"a"},"geometry":{"type":"LineString","coordinates":[[1,2,9],[3,4,9]]}}
{"type":"Feature","properties":{"NHDPlusID":2},"geometry":{"type":"MultiLineString","coordinates":[[[1,2],[3,4]],[[5,6],[7,8]]]}}

{"type":"Feature","properties":{},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]}}
{"type":"Feature","properties":{"Permanent_Identifier":"p"},"geometry":{"type":"Point","coordinates":[8,9]}}
{"type":"Feature","properties":{"Permanent_Identifier":"n"},"geometry":null}
"""
    )
    rows = flowlines.read(spark, str(tmp_path / "layer.geojsonl")).collect()
    shapes = [r.parts and [[(p.x, p.y) for p in part] for part in r.parts] for r in rows]
    assert shapes == [[[(1, 2), (3, 4)]], [[(1, 2), (3, 4)], [(5, 6), (7, 8)]], [[(0, 0), (1, 0), (1, 1), (0, 0)], [(5, 5), (6, 5), (6, 6), (5, 5)]], [[(8, 9)]], None]
    assert [(r.nhdplusid, r.permanent_) for r in rows[:2]] == [(1.5, "a"), (2.0, None)]
    (tmp_path / "bad.geojsonl").write_text('{"a": 1}\n')
    with pytest.raises(ValueError, match="features"):
        tables.read_any(spark, str(tmp_path / "bad.geojsonl"))


def wkb(kind, points, order="<", dims=2, head=None):
    mark = b"\x01" if order == "<" else b"\x00"
    flat = [v for p in points for v in p]
    return mark + (head or struct.pack(order + "I", kind)) + struct.pack(order + "I", len(points)) + struct.pack(f"{order}{len(flat)}d", *flat)


def test_well_known_binary(spark, tmp_path):
    plain = [[{"x": 1.0, "y": 2.0}, {"x": 3.0, "y": 4.0}]]
    two, three = [(1, 2), (3, 4)], [(1, 2, 9), (3, 4, 9)]
    assert geometry.wkb_parts(wkb(2, two)) == geometry.wkb_parts(wkb(2, two, ">")) == plain
    assert geometry.wkb_parts(wkb(1002, three)) == geometry.wkb_parts(wkb(2, three, head=struct.pack("<I", 0x80000002))) == plain
    assert geometry.wkb_parts(wkb(3002, [(1, 2, 8, 9), (3, 4, 8, 9)])) == plain
    assert geometry.wkb_parts(wkb(2, two, head=struct.pack("<II", 0x20000002, 4326))) == plain
    many = b"\x01" + struct.pack("<II", 5, 2) + wkb(2, two) + wkb(2, two, ">")
    assert geometry.wkb_parts(many) == plain * 2
    ring = b"\x01" + struct.pack("<II", 3, 1) + struct.pack("<I", 2) + struct.pack("<4d", 1, 2, 3, 4)
    assert geometry.wkb_parts(ring) == plain and geometry.wkb_parts(b"\x01" + struct.pack("<I2d", 1, 1, 2)) == [[{"x": 1.0, "y": 2.0}]]
    assert geometry.wkb_parts(None) is None
    spark.createDataFrame([(1, wkb(2, two)), (2, None)], "NHDPlusID int, geometry binary").write.parquet(str(tmp_path / "g.parquet"))
    rows = flowlines.read(spark, str(tmp_path / "g.parquet")).orderBy("nhdplusid").collect()
    assert [r.parts and [[tuple(p) for p in part] for part in r.parts] for r in rows] == [[[(1.0, 2.0), (3.0, 4.0)]], None]


def test_flowline_dispatch(spark, tmp_path):
    for i in (2, 1):
        polyline(tmp_path / f"NHDFlowline_{i}", [[(i, 0), (i, 1)], [(i, 2), (i, 3)]], [f"n{i}a", f"n{i}b"])
    got = flowlines.read(spark, str(tmp_path)).orderBy("file_row").collect()
    assert [(r.name, r.permanent_) for r in got] == [("n1a", "1"), ("n1b", "2"), ("n2a", "3"), ("n2b", "4")]
    assert flowlines.read(spark, str(tmp_path / "NHDFlowline_1.shp")).count() == 2
    # By a path with a scheme, as on a shared store; a folder of Parquet files needs no suffix.
    assert flowlines.read(spark, f"file://{tmp_path}").orderBy("file_row").collect() == got
    spark.createDataFrame(got[:3]).drop("file_row", "parts").write.parquet(str(tmp_path / "plain"))
    for path in (str(tmp_path / "plain"), f"file://{tmp_path}/plain"):
        assert flowlines.read(spark, path).count() == 3
    (tmp_path / "deep" / "er" / "b.gdb").mkdir(parents=True)
    assert flowlines._stores(spark, f"file://{tmp_path}/deep") == [f"file:{tmp_path}/deep/er/b.gdb"] and flowlines._stores(spark, str(tmp_path / "deep")) == [str(tmp_path / "deep" / "er" / "b.gdb")]
    (tmp_path / "deep" / "er" / "b.gdb").rmdir()
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        flowlines.read(spark, str(tmp_path / "empty"))
    asked = []

    def reader(session, path, layer, bbox):
        asked.append(layer)
        if layer != "NHDFlowline":
            raise OSError(layer)
        return session.createDataFrame([("p", 1.0)], "Permanent_Identifier string, NHDPlusID double")

    (tmp_path / "a.gdb").mkdir()
    assert flowlines.read(spark, str(tmp_path / "a.gdb"), "mine", None, reader).columns == ["permanent_identifier", "nhdplusid", "permanent_"]
    assert asked == ["mine", "NetworkNHDFlowline", "NHDFlowline"]
    with pytest.raises(OSError):
        flowlines.read_layer(spark, "x", None, None, lambda *a: (_ for _ in ()).throw(OSError("no")))
    with pytest.raises(ValueError, match="no routing table"):
        flowlines.embedded_vaa(spark, str(tmp_path), reader)


def test_tables(spark, tmp_path):
    (tmp_path / "cp.csv").write_text("UP_CP,Next_DS_CP,ChLosFac,LAT,LONG\n007,B,0.5,31,-97\nB,,0.1,30,-96\n")
    rows = tables.control_points(spark, str(tmp_path / "cp.csv")).collect()
    assert [(r.UP_CP, r.Next_DS_CP, r.file_row) for r in rows] == [("007", "B", 0), ("B", None, 1)]
    (tmp_path / "x.csv").write_text("gage_id,COMID\n01,5\n01,5.0\n02,6\n")
    assert sorted(tuple(r) for r in tables.crosswalk(spark, str(tmp_path / "x.csv")).collect()) == [("01", 5), ("02", 6)]
    for call in (tables.control_points, tables.crosswalk):
        (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
        with pytest.raises(KeyError):
            call(spark, str(tmp_path / "bad.csv"))
    with pytest.raises(ValueError):
        tables.union_tiles([])
    assert tables.vpu_sample(spark.createDataFrame([("b",), ("a",), (None,)], "vpuid string")) == ["a", "b"]


@pytest.mark.parametrize("kind", ["parquet", "csv", "geojsonl"])
def test_rows_without_ids_are_numbered_in_the_order_of_the_files(spark, tmp_path, kind):
    """Rows against their values' order, in several files and splits; COMIDs follow too."""
    path = tmp_path / f"flow.{kind}"
    rows = [(f"{1000 - i}", float(-i), float(i), float(i + 1), 5.0) for i in range(600)]
    table = spark.createDataFrame(rows, "name string, fromnode double, tonode double, hydroseq double, areasqkm double")
    ordered = table.repartitionByRange(3, F.col("fromnode").desc()).sortWithinPartitions(F.col("fromnode").desc())
    if kind == "geojsonl":
        ordered.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*table.columns).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(F.lit(1.0), F.lit(2.0)).alias("coordinates")).alias("geometry"))).alias("value")).write.text(str(path))
    else:
        getattr(ordered.write.option("header", True), kind)(str(path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = flowlines.read(spark, f"file://{path}")
        assert {int(r.permanent_): r.name for r in got.collect()} == {i + 1: r[0] for i, r in enumerate(rows)}
        assert {r.comid: r.name for r in network.routed(got).collect()} == {i + 1: r[0] for i, r in enumerate(rows)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_control_points_keep_the_order_of_a_file_in_splits(spark, tmp_path):
    path = tmp_path / "cp.csv"
    path.write_text("LONG,UP_CP,Next_DS_CP,ChLosFac,LAT\n" + "".join(f"1,{997 * i % 500:04d},x,0.5,2\n" for i in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = tables.control_points(spark, str(path)).orderBy("file_row").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.file_row, r.UP_CP) for r in rows] == [(i, f"{997 * i % 500:04d}") for i in range(500)]


def test_archives(tmp_path):
    assert archives.prepare(str(tmp_path)) == str(tmp_path)
    name = "NHDPLUS_H_1201_HU4_GDB.zip"
    (tmp_path / name).write_bytes(b"not a zip")
    with pytest.raises(ValueError, match=name):
        archives.prepare(str(tmp_path))
    with zipfile.ZipFile(tmp_path / "NHDPLUS_H_1202_HU4_GDB.zip", "w") as z:
        z.writestr("x.gdb/data", "1")
    assert list((tmp_path / "_extracted_gdb").rglob("x.gdb")) == [] and archives.prepare(str(tmp_path)).endswith("_extracted_gdb")
    assert len(list((tmp_path / "_extracted_gdb").rglob("x.gdb"))) == 1


#: The command line's options and their defaults, as they must be (fixed values).
OPTIONS = {
    "--flowline-source": "Shape", "--flowline-layer": None, "--vaa-file": "Shape/NHDFlowlineVAA.dbf", "--basin-shp": "river_basin/TWDB_MRBs_2014.shp", "--basin-name-field": "basin_name",
    "--basin-name-value": "Brazos", "--cp-meta-file": None, "--flo-file": None, "--gage-crosswalk-file": None, "--output-file": "modeled_monthly_comid_flows.csv", "--output-shapefile": None,
    "--shapefile-date": None, "--start-date": "2010-01-01", "--end-date": "2024-12-01", "--runoff-coeff-m-per-month": 0.0008, "--calibrate": False, "--calibration-months": 24,
}


@pytest.mark.parametrize(("flag", "default"), OPTIONS.items())
def test_command_line(flag, default):
    name = flag[2:].replace("-", "_")
    assert getattr(parse_args([]), name) == default
    given = [flag] if default is False else [flag, "7"]
    assert getattr(parse_args(given), name) == (True if default is False else type(default)(7) if isinstance(default, (int, float)) else "7")
    assert len(OPTIONS) == 17 == len(ModelConfig.of().__dict__)


def test_configuration():
    cfg = parse_args(["--calibrate", "--runoff-coeff-m-per-month", "0.001", "--vaa-file", ""])
    assert cfg.calibrate and cfg.runoff_coeff_m_per_month == 0.001 and cfg.vaa_file == "" and cfg.basin_name_value == "Brazos"
    assert parse_args([]) == ModelConfig.of()
    assert ModelConfig.for_years(2010, 2011).end_date == "2011-12-01"
    whole = {"cp_meta_file": "c", "flo_file": "f"}
    assert ModelConfig.of(**whole).validated().end_date == "2024-12-01"
    for bad in ({"flo_file": ""}, {"end_date": "2001-01-01"}, {"runoff_coeff_m_per_month": 0.0}, {"shapefile_date": "2031-01-01"}):
        with pytest.raises(ValueError):
            ModelConfig.of(**(whole | bad)).validated()
    with pytest.raises(ValueError):
        ModelConfig.for_years(2011, 2010)


def test_model_run(spark, tmp_path):
    """Four segments in a Y inside a basin, one outside; a gage, a loss, both outputs."""
    rows = [("a", 1.0, 1.0, 3.0, 9.0, 1.0, line((-97.0, 31.0), (-97.0, 31.1))), ("b", 2.0, 2.0, 3.0, 8.0, 2.0, line((-96.9, 31.0), (-96.9, 31.1))), ("c", 3.0, 3.0, 4.0, 7.0, 4.0, line((-97.0, 30.9), (-96.95, 31.0))), ("d", 4.0, 4.0, 5.0, 6.0, 8.0, line((-97.0, 30.8), (-97.0, 30.9))), ("z", 9.0, 5.0, 6.0, 5.0, 100.0, line((-80.0, 30.8), (-80.0, 30.9)))]
    spark.createDataFrame(rows, f"Permanent_ string, NHDPlusID double, FromNode double, ToNode double, HydroSeq double, AreaSqKm double, parts {geometry.PARTS}").write.parquet(str(tmp_path / "flow.parquet"))
    spark.createDataFrame([("Brazos", line((-98, 30), (-96, 30), (-96, 32), (-98, 32), (-98, 30)))], f"basin_name string, parts {geometry.PARTS}").write.parquet(str(tmp_path / "basin.parquet"))
    (tmp_path / "cp.csv").write_text("UP_CP,Next_DS_CP,ChLosFac,LAT,LONG\nA,D,0.25,31.05,-97.001\nD,,0,30.85,-97.001\n")
    (tmp_path / "x.csv").write_text("gage_id,COMID\nG,3\n")
    (tmp_path / "obs.flo").write_text("G 2010 100 " + " ".join(["0"] * 11) + "\n")
    cfg = ModelConfig.of(flowline_source=str(tmp_path / "flow.parquet"), basin_shp=str(tmp_path / "basin.parquet"), cp_meta_file=str(tmp_path / "cp.csv"), flo_file=str(tmp_path / "obs.flo"), output_file=str(tmp_path / "out.csv"), output_shapefile=str(tmp_path / "p.shp"), start_date="2010-01-01", end_date="2010-02-01", gage_crosswalk_file=str(tmp_path / "x.csv"))
    seen = []
    got = run_model(cfg, spark, lambda percent, stage: seen.append(percent))
    flow = {(str(r.date), r.comid): r.flow_cms for r in got.collect()}
    unit = {1: 1.0, 2: 2.0, 3: 7 * 0.75 / 15, 4: 0.75}
    local = lambda c, days: 0.0008 * unit[c] * 1e6 / (days * 86400)
    target = 100 * 1233.48184 / (31 * 86400)
    assert flow["2010-01-01", 3] == pytest.approx(target) and flow["2010-01-01", 1] == pytest.approx(local(1, 31))
    assert flow["2010-01-01", 4] == pytest.approx(local(4, 31) * target / local(3, 31))
    assert flow["2010-02-01", 3] == pytest.approx(0) and flow["2010-02-01", 2] == pytest.approx(local(2, 28)) and len(flow) == 8
    assert seen == sorted(seen) and seen[0] == 1 and seen[-1] == 100
    assert (tmp_path / "out.csv").is_file() and not (tmp_path / "out.csv-parts").exists()
    assert (tmp_path / "out.csv").read_text().splitlines()[0] == "date,COMID,flow_cms,lat,lon"
    written = spark.read.csv(str(tmp_path / "out.csv"), header=True).collect()
    assert [(r.date, r.COMID) for r in written[:4]] == [("2010-01-01", c) for c in ("1", "2", "3", "4")]
    assert float(written[0].lat) == pytest.approx(31.05, abs=1e-3) and float(written[0].lon) == pytest.approx(-97, abs=1e-3)
    assert shapefile.read(spark, str(tmp_path / "p.shp")).count() == 4
    whole = ModelConfig.of(**{**cfg.__dict__, "output_shapefile": None, "gage_crosswalk_file": None, "output_file": str(tmp_path / "out.parquet")})
    assert run_model(whole, spark).count() == 8 and spark.read.parquet(str(tmp_path / "out.parquet")).count() == 8
    with pytest.raises(ValueError, match="calibration"):
        run_model(ModelConfig.of(**{**whole.__dict__, "calibrate": True}), spark)
    calibrated = run_model(ModelConfig.of(**{**cfg.__dict__, "output_shapefile": None, "calibrate": True}), spark)
    assert calibrated.count() == 8


def test_point_blocks_reach_the_driver_compressed(spark):
    df = spark.range(5000).select(F.col("id").alias("_record"), F.col("id").alias("COMID"), (F.col("id") / 128 - 102).alias("LON"), (F.col("id") * 7919 % 2003 / 256 + 26).alias("LAT"))
    row = shapefile._point_blocks(df, {"COMID": "I", "LON": "F", "LAT": "F"}, "LON", "LAT").first()
    sent, whole = (sum(len(f(row[name])) for name in ("shp", "shx", "dbf")) for f in (bytes, zlib.decompress))
    assert whole == 5000 * (28 + 8 + 1 + 18 + 24 + 24) and 3 * sent < whole
