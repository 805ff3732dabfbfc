"""Queries over the driver's tables, one or more for each operator, with the SQL that checks them.

The tables hold no rivers; `inputs` derives some, and files of them. Values that add up in any order differ in their last
digits between engines: compare doubles with a tolerance.
"""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet import sinks
from freshet.config import ModelConfig
from freshet.functions import columns, crs, geometry
from freshet.operators import control_points, folds, gages, network, runoff, spatial
from freshet.plans import inputs
from freshet.plans.model import enforced, in_system, run_model
from freshet.scratch import cut, new_folder, scope, tidy_shuffles
from freshet.sources import flo, flowlines, shapefile, tables

COEFFICIENT = 0.0008
#: Nearly all months of shipping: one at each end is left off. Calibration takes the first of them.
START, END = "1995-02-01", "2001-10-01"
CALIBRATION_MONTHS = 24
#: The whole model runs over a year.
MODEL_END = "1996-01-01"


def _net(spark: SparkSession, sf_dir: str, apart: bool = False) -> tuple[DataFrame, DataFrame]:
    segments = cut(inputs.segments(spark, sf_dir, apart), "segments")
    return segments, cut(network.edges(segments), "edges")


def _routed(segments: DataFrame, closure: network.Powers) -> DataFrame:
    return network.accumulate(runoff.local_area(segments).withColumnRenamed("area_km2", "q"), closure)


def _closed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, network.Powers]:
    """Segments, links and closure; ids are those of `inputs.segments` kept apart, and results go through `inputs.named`."""
    segments, links = _net(spark, sf_dir, apart=True)
    return segments, links, network.powers(links, segments.count())


def _unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scope(spark) as held, tidy_shuffles(spark):
        segments, _, closure = _closed(spark, sf_dir)
        unit = _routed(segments, closure)
        held.keep(unit)
    return inputs.named(unit)


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gages.compile_observations(inputs.observations(spark, sf_dir), START, END, inputs.crosswalk(spark, sf_dir))


def flo_parse(spark, sf_dir):
    return flo.parse(inputs.flo_lines(spark, sf_dir))


def flo_to_cms(spark, sf_dir):
    return inputs.observations(spark, sf_dir).select("date", "gage_id", columns.acft_month_to_cms("acft", "date").alias("flow_cms"))


def obs_compile(spark, sf_dir):
    return _observations(spark, sf_dir)


def months(spark, sf_dir):
    """The month starts between the first and the last day of shipping, neither of which need be one."""
    first, last = inputs.table(spark, sf_dir, "lineitem").agg(F.date_add(F.min("l_shipdate").cast("date"), 3), F.max("l_shipdate").cast("date")).first()
    return columns.months(spark, str(first), str(last)).select("date", columns.days_in_month("date").cast("long").alias("days"))


def net_edges(spark, sf_dir):
    return network.edges(inputs.segments(spark, sf_dir))


def net_degrees(spark, sf_dir):
    segments, links = _net(spark, sf_dir)
    return network.degrees(segments, links)


def net_summary(spark, sf_dir):
    segments, links = _net(spark, sf_dir)
    return network.summary(segments, links)


def net_topo_level(spark, sf_dir):
    with scope(spark) as held, tidy_shuffles(spark):
        segments, _, closure = _closed(spark, sf_dir)
        levels = network.levels(segments, closure)
        held.keep(levels)
    return inputs.named(levels)


#: Only braids have half numbers in hydroseq.
_BRAID = "coalesce(hydroseq % 1 = 0.5D, false)"


def vaa_join_routed(spark, sf_dir):
    """Flowlines without nodes, routed by a table that misses some and has no node for others. A braid's comid may be a tree segment's too; its number isn't."""
    segments = inputs.segments(spark, sf_dir)
    own = F.col("comid") + F.when(F.expr(_BRAID), -0.25).otherwise(0.25)
    flow = segments.select(own.alias("nhdplusid"), F.concat(F.lit("P"), "comid").alias("permanent_"), "areasqkm")
    vaa = segments.where("comid % 13 <> 0").select(own.cast("string").alias("nhdplusid"), "fromnode", F.expr("if(comid % 11 = 0, null, tonode)").alias("tonode"), "hydroseq")
    return network.numbered(flow, vaa).select("comid", "permanent_", "fromnode", "tonode", "hydroseq")


def vaa_join_permanent(spark, sf_dir):
    """Routed by text ids, of which braids have their own; some flowlines have no number, and others have none at all in common with the table."""
    segments = inputs.segments(spark, sf_dir)
    own = F.concat(F.when(F.expr(_BRAID), "B").otherwise("P"), "comid")
    flow = segments.select(F.expr("if(comid % 17 = 0, null, comid + 0.25)").alias("nhdplusid"), F.when(F.col("comid") % 19 != 0, own).alias("permanent_"))
    vaa = segments.select(own.alias("permanent_"), "fromnode", "tonode", F.col("hydroseq").cast("string").alias("hydroseq"))
    return network.numbered(flow, vaa).select("comid", F.translate("permanent_", "B", "P").alias("permanent_"), "fromnode", "tonode", "hydroseq")


def routed_numbers(spark, sf_dir):
    """Flowlines without numbers are numbered in the order of their file, those without nodes left out."""
    segments = inputs.segments(spark, sf_dir)
    flow = segments.select(F.concat(F.lit("P"), "comid").alias("permanent_"), (-F.col("comid")).alias("file_row"), F.expr("if(comid % 23 = 0, null, fromnode)").alias("fromnode"), "tonode", "hydroseq")
    return network.routed(flow).select("comid", "permanent_")


def model_run(spark, sf_dir):
    """A whole run from files to the CSV file: basin, routing table by text ids, control points, losses, gages, places."""
    folder = new_folder(spark, "model")
    options = inputs.model_files(spark, sf_dir, folder)
    with scope(spark), tidy_shuffles(spark):
        run_model(ModelConfig.of(**options, basin_name_value="lattice", start_date=START, end_date=MODEL_END, runoff_coeff_m_per_month=COEFFICIENT), spark)
    out = spark.read.csv(options["output_file"], schema="date date, comid long, flow_cms double, lat double, lon double", header=True)
    return inputs.named(out).select("date", "comid", "flow_cms", F.round("lat", 3).alias("lat"), F.round("lon", 3).alias("lon"))


def local_area(spark, sf_dir):
    """Each of the columns that areas may come from, by turns without the better ones."""
    segments = inputs.segments(spark, sf_dir)
    base = segments.select("comid", F.expr("if(comid % 5 = 0, null, areasqkm)").alias("areasqkm"), F.expr("if(comid % 7 = 0, 'bad', cast(areasqkm * 3 as string))").alias("totdasqkm"), F.expr("if(comid % 3 = 0, null, areasqkm + 1)").alias("lengthkm"))
    line = F.array(F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), F.struct((F.col("areasqkm") * 3000).alias("x"), (F.col("areasqkm") * 4000).alias("y"))))
    cases = [base, base.withColumn("areasqkm", F.lit(None).cast("double")), base.select("comid", "lengthkm"), segments.select("comid", line.alias("parts"))]
    out = [runoff.local_area(c).withColumn("tier", F.lit(i)) for i, c in enumerate(cases)]
    return out[0].unionAll(out[1]).unionAll(out[2]).unionAll(out[3])


def route_unit(spark, sf_dir):
    return _unit(spark, sf_dir)


def flow_monthly(spark, sf_dir):
    """Flagship: the flow of every segment in every month."""
    return runoff.monthly(_unit(spark, sf_dir), columns.months(spark, START, END), COEFFICIENT)


def flow_one_month_points(spark, sf_dir):
    """The last month as the point file has it, places from a lattice."""
    dates = columns.months(spark, START, END)
    flows = runoff.monthly(_unit(spark, sf_dir), dates.agg(F.max("date").alias("date")), COEFFICIENT)
    # Some flows are beyond the numbers that a point file may hold.
    flows = flows.withColumn("flow_cms", F.expr("flow_cms * case when comid % 11 = 0 then 1e22D when comid % 13 = 0 then -1e22D else 1D end"))
    placed = flows.withColumn("lat", (F.col("comid") % 90).cast("double")).withColumn("lon", (F.col("comid") % 180).cast("double"))
    return sinks.points_of(placed, END).withColumn("WKT", columns.point_text(F.col("LON").cast("int"), F.col("LAT").cast("int")))


def reach_descendants(spark, sf_dir):
    with scope(spark) as held, tidy_shuffles(spark):
        segments, _, closure = _closed(spark, sf_dir)
        sources = inputs.crosswalk(spark, sf_dir).select(F.col("COMID").alias("comid")).join(segments.select("comid"), "comid", "left_semi")
        reached = network.reach(sources, closure)
        held.keep(reached)
    return inputs.named(reached)


def gage_enforce(spark, sf_dir):
    """Observed months, enforced in the order of gages, at every segment that a gage changes and every other one."""
    segments, _, closure = _closed(spark, sf_dir)
    observations = cut(_observations(spark, sf_dir), "observations")
    gaged = observations.select("comid").distinct().join(segments.select("comid"), "comid", "left_semi")
    reached = cut(network.reach(gaged, closure), "reach")
    return inputs.named(enforced(_routed(segments, closure), columns.months(spark, START, END), COEFFICIENT, observations, reached))


def _snapped(spark, sf_dir):
    return control_points.snap(inputs.control_points(spark, sf_dir), inputs.sites(spark, sf_dir))


def cp_snap(spark, sf_dir):
    return _snapped(spark, sf_dir).select("UP_CP", "Next_DS_CP", "ChLosFac", F.col("file_row").cast("long").alias("file_row"), "UP_COMID", "DS_COMID", "snap_dist")


def _paths(spark, sf_dir):
    """Steps and the rows of their paths; segments and closure for what follows."""
    segments, links, closure = _closed(spark, sf_dir)
    steps = cut(control_points.pairs(_snapped(spark, sf_dir), segments), "steps")
    return steps, cut(control_points.paths(steps, links, closure), "path-rows"), segments, closure


def cp_paths(spark, sf_dir):
    with scope(spark) as held, tidy_shuffles(spark):
        rows = _paths(spark, sf_dir)[1]
        held.keep(rows)
    return inputs.named(rows).select(F.col("step").cast("long").alias("step"), F.col("pos").cast("long").alias("pos"), "comid")


def loss_apply(spark, sf_dir):
    """Losses of all of the flow are among them, so some steps find no flow at their lower end."""
    with scope(spark) as held, tidy_shuffles(spark):
        steps, rows, segments, closure = _paths(spark, sf_dir)
        steps = steps.join(rows.select("step").distinct(), "step", "left_semi")
        lost = cut(folds.apply_losses(steps, control_points.members(rows), _routed(segments, closure)), "lost")
        held.keep(lost)
    return inputs.named(lost).select("comid", "q")


def _calibration(spark, sf_dir):
    """By the first months of a longer run; some gages lie outside the network."""
    early = gages.first_dates(_observations(spark, sf_dir), columns.months(spark, START, END), CALIBRATION_MONTHS)
    return gages.calibration_table(early, _unit(spark, sf_dir))


def calibrate_rmse(spark, sf_dir):
    return _calibration(spark, sf_dir).select(F.col("i").cast("long").alias("i"), "coeff", "rmse")


def calibrate_best(spark, sf_dir):
    return gages.best_coefficient(_calibration(spark, sf_dir)).select("coeff", "rmse")


def _known(c: str) -> Column:
    return F.when(~F.isnan(c), F.col(c)).alias(c)


def calibrate_unknown(spark, sf_dir):
    """One unknown flow leaves no coefficient with an error, and no best one."""
    early = gages.first_dates(_observations(spark, sf_dir), columns.months(spark, START, END), CALIBRATION_MONTHS)
    early = early.withColumn("flow_cms", F.when((F.col("comid") != 2) | (F.month("date") != 3), F.col("flow_cms")))
    with tidy_shuffles(spark):
        table = cut(gages.calibration_table(early, _unit(spark, sf_dir)), "unknown")
    return table.select(F.col("i").cast("long").alias("i"), _known("rmse"), F.lit(not gages.best_coefficient(table).isEmpty()).alias("has_best"))


def route_unknown(spark, sf_dir):
    """Lengths stand for areas; an unknown one makes all flow below it unknown."""
    segments, _, closure = _closed(spark, sf_dir)
    lengths = segments.select("comid", F.expr(f"if(comid % {inputs.APART} % 50 = 0, null, areasqkm)").alias("lengthkm"))
    return inputs.named(_routed(lengths, closure)).select("comid", _known("q"))


def flo_bad_numbers(spark, sf_dir):
    """Flow files with one bad token: whether reading them fails, whatever is asked of them later."""
    good = inputs.flo_lines(spark, sf_dir)
    cases = {"as it is": good, "a value": good.unionAll(spark.sql("select 'G0 1950 x 1 1 1 1 1 1 1 1 1 1 1'")), "a year": good.unionAll(spark.sql("select 'G0 199x 1 1 1 1 1 1 1 1 1 1 1 1'")), "short lines only": good.where(F.size(F.split(F.trim("value"), r"\s+")) < 14)}
    out = []
    for name, lines in cases.items():
        path = f"{new_folder(spark, 'flo')}/file.flo"
        lines.write.text(path)
        try:
            out.append((name, "", flo.read(spark, path).count()))
        except (ValueError, PySparkException) as error:
            out.append((name, "no rows" if isinstance(error, ValueError) else "not a number", 0))
    return spark.createDataFrame(out, "file string, error string, rows long")


def net_cycles(spark, sf_dir):
    """Whether the network passes the check for cycles, as it is and with one edge that leads back."""
    out = []
    with scope(spark), tidy_shuffles(spark):
        segments, links = _net(spark, sf_dir, apart=True)
        for name, pairs in (("as it is", links), ("a long way back", links.unionByName(spark.sql("select 1L as up, 64L as ds"))), ("a segment that leads to itself", links.unionByName(spark.sql("select 5L as up, 5L as ds")))):
            try:
                network.check_acyclic(segments, pairs)
                out.append((name, False))
            except ValueError:
                out.append((name, True))
    return spark.createDataFrame(out, "network string, cycle boolean")


def basin_name_filter(spark, sf_dir):
    return spatial.basin(inputs.table(spark, sf_dir, "region"), "r_name", "europe").select(F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name")


def basin_options(spark, sf_dir):
    return spatial.basin_names(inputs.table(spark, sf_dir, "nation"), "n_name")


def union_tiles(spark, sf_dir):
    segments = inputs.segments(spark, sf_dir)
    tiles = [segments.where("comid < 1000000").select("comid", "areasqkm"), segments.where("comid >= 1000000").select("comid", F.col("areasqkm").alias("lengthkm"))]
    return tables.union_tiles(tiles)


def vpu_sample(spark, sf_dir):
    return tables.vpu_codes(inputs.table(spark, sf_dir, "part").select(F.expr("if(p_partkey % 7 = 0 or p_brand < 'Brand#2', null, p_brand)").alias("vpuid")), names=12)


#: Two rectangles; the lattice of `sites` has no point on their edges.
RECTANGLES = ((10_000.5, 20_000.5, 60_000.5, 70_000.5), (80_000.5, 5_000.5, 120_000.5, 30_000.5))


#: Bytes of a tile that a task of `tiles_by_record` reads.
PIECE = 1 << 16


def _rectangles(spark):
    ring = lambda w, s, e, n: [[{"x": x, "y": y} for x, y in ((w, s), (e, s), (e, n), (w, n), (w, s))]]
    return spark.createDataFrame([(ring(*r),) for r in RECTANGLES], f"parts {geometry.PARTS}")


def _lines(spark, sf_dir):
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y, i = F.col("x"), F.col("y"), F.col("comid")
    return inputs.sites(spark, sf_dir).select("comid", F.array(F.array(p(x, y), p(x + 3000 + i % 17, y + 5000 - i % 13))).alias("parts"))


def spatial_intersects(spark, sf_dir):
    return spatial.intersecting(_lines(spark, sf_dir), _rectangles(spark)).select("comid")


def basin_lines(spark, sf_dir):
    """Lines without an id, with one that others have too, and rows that are there twice: each stays or goes by its own place."""
    lines = _lines(spark, sf_dir).withColumn("permanent_", F.expr("case when comid % 7 = 0 then null when comid % 5 = 0 then 'P' else concat('P', comid) end"))
    twice = lines.unionAll(lines.where("comid % 3 = 0"))
    return spatial.intersecting(twice.drop("comid").withColumn("x", F.col("parts")[0][0]["x"]), _rectangles(spark)).select("permanent_", "x")


#: A square on its corner around the origin: half its width, and the length of an edge along an axis. The cells' corners lie on its edges.
HALF, EDGE = 65_536, 16


def basin_crowded(spark, sf_dir):
    """A basin of many edges; three of four lines crowd at one place of them."""
    k = lambda sx, sy, turn: F.transform(F.sequence(F.lit(0), F.lit(HALF // EDGE - 1)), lambda i: F.struct((sx * (F.lit(HALF) - i * EDGE if turn else i * EDGE)).cast("double").alias("x"), (sy * (i * EDGE if turn else F.lit(HALF) - i * EDGE)).cast("double").alias("y")))
    ring = F.concat(k(1, 1, True), k(-1, 1, False), k(-1, -1, True), k(1, -1, False))
    basin = spark.range(1).select(ring.alias("ring")).select(F.array(F.concat("ring", F.slice("ring", 1, 1))).alias("parts"))
    at = inputs.sites(spark, sf_dir).selectExpr("comid", "if(comid % 4 = 0, x * 1.5D - 98304, 32264 + x / 128) + 0.25D as x", "if(comid % 4 = 0, y - 64064, 31767 + y / 64) + 0.125D as y", "(comid % 17 - 8) * if(comid % 4 = 0, 64.0D, 1.0D) as dx", "(comid % 13 - 6) * if(comid % 4 = 0, 64.0D, 1.0D) as dy")
    ends = F.array(F.struct("x", "y"), F.struct((F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y")))
    return spatial.intersecting(at.select("comid", F.array(ends).alias("parts")), basin).select("comid")


def line_measures(spark, sf_dir):
    """Length and centroid of lines with two legs."""
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y = F.col("x"), F.col("y")
    lines = inputs.sites(spark, sf_dir).select("comid", F.array(F.array(p(x, y), p(x + 300, y + 400), p(x + 300 + (F.col("comid") % 5 + 1) * 120, y + 400 + (F.col("comid") % 5 + 1) * 50))).alias("parts"))
    c = geometry.centroid(F.col("parts"))
    return lines.select("comid", geometry.length(F.col("parts")).alias("length"), c.alias("c")).select("comid", F.format_string("%.6f", "length").alias("length"), F.format_string("%.4f", "c.x").alias("cx"), F.format_string("%.4f", "c.y").alias("cy"))


def utm_forward(spark, sf_dir):
    """Every lattice point as degrees, projected to zone 14 and back."""
    at = inputs.sites(spark, sf_dir).select("comid", (F.lit(-102.0) + F.col("x") / 16384.0).alias("lon"), (F.lit(26.0) + F.col("y") / 16384.0).alias("lat"))
    x, y = crs.to_utm(F.col("lon"), F.col("lat"), 14)
    placed = at.withColumn("e", x).withColumn("n", y)
    lon, lat = crs.from_utm(F.col("e"), F.col("n"), 14)
    return placed.select("comid", F.format_string("%.3f", "e").alias("easting"), F.format_string("%.3f", "n").alias("northing"), (F.abs(lon - F.col("lon")) < 1e-8).alias("lon_back"), (F.abs(lat - F.col("lat")) < 1e-8).alias("lat_back"))


#: An equal-area system of the whole country, as a .prj file has it, and a basin in degrees between the lattice's points.
ALBERS = """PROJCS["NAD_1983_Albers",GEOGCS["GCS_North_American_1983",DATUM["D_North_American_1983",SPHEROID["GRS_1980",6378137.0,298.257222101]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]],
PROJECTION["Albers"],PARAMETER["False_Easting",0.0],PARAMETER["False_Northing",0.0],PARAMETER["Central_Meridian",-96.0],PARAMETER["Standard_Parallel_1",29.5],PARAMETER["Standard_Parallel_2",45.5],PARAMETER["Latitude_Of_Origin",23.0],UNIT["Meter",1.0]]"""
DEGREES = (-100.00390625, 27.501953125, -97.00390625, 31.001953125)


def _lattice_degrees(spark, sf_dir):
    return inputs.sites(spark, sf_dir).select("comid", (F.lit(-102.0) + F.col("x") / 16384.0).alias("lon"), (F.lit(26.0) + F.col("y") / 16384.0).alias("lat"))


def albers_forward(spark, sf_dir):
    """Every lattice point in an equal-area system and back."""
    system = crs.from_wkt(ALBERS)
    x, y = crs.from_degrees(system)(F.col("lon"), F.col("lat"))
    placed = _lattice_degrees(spark, sf_dir).withColumn("x", x).withColumn("y", y)
    lon, lat = crs.to_degrees(system)(F.col("x"), F.col("y"))
    return placed.select("comid", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), (F.abs(lon - F.col("lon")) < 1e-8).alias("lon_back"), (F.abs(lat - F.col("lat")) < 1e-8).alias("lat_back"))


def basin_in_albers(spark, sf_dir):
    """Lines in metres of one system, the basin in degrees: it is brought to the lines' system."""
    system = crs.from_wkt(ALBERS)
    point = lambda lon, lat: F.struct(lon.alias("x"), lat.alias("y"))
    degrees = F.array(F.array(point(F.col("lon"), F.col("lat")), point(F.col("lon") + 0.0001, F.col("lat"))))
    lines = _lattice_degrees(spark, sf_dir).select("comid", geometry.transformed(degrees, crs.from_degrees(system)).alias("parts"))
    west, south, east, north = DEGREES
    # Sides of many corners: a straight side in degrees is a curve in metres.
    corners = [(west, south), (east, south), (east, north), (west, north), (west, south)]
    ring = [{"x": a + (c - a) * k / 64, "y": b + (d - b) * k / 64} for (a, b), (c, d) in zip(corners, corners[1:]) for k in range(64)]
    basin = spark.createDataFrame([([[*ring, ring[0]]],)], f"parts {geometry.PARTS}")
    return spatial.intersecting(lines, in_system(basin, crs.Crs(), system)).select("comid")


def tiles_by_record(spark, sf_dir):
    """The lattice in three point tiles; each is read by several tasks, and its ids are its order. The tiles' tables give the other column."""
    folder = new_folder(spark, "tiles")
    lattice = _lattice_degrees(spark, sf_dir).withColumnsRenamed({"lon": "LON", "lat": "LAT"})
    for k in range(3):
        tile = lattice.where(F.col("comid") % 3 == k).select(F.col("comid").alias("COMID"), (F.col("comid") * 7 % 101).cast("double").alias("AREA"), "LON", "LAT")
        shapefile.write_points(tile.repartitionByRange("COMID").sortWithinPartitions("COMID"), f"{folder}/{k}.shp")
    paths = [f"{folder}/{k}.shp" for k in (2, 0, 1)]
    places = flowlines.normalised(shapefile.read(spark, paths, columns=["COMID"], piece=PIECE))
    areas = shapefile.read(spark, [p.replace(".shp", ".dbf") for p in paths], columns=["AREA"], piece=PIECE)
    at = F.col("parts")[0][0]
    return places.join(areas, "file_row").select("permanent_", F.col("comid").cast("long").alias("comid"), F.col("AREA").alias("area"), at.x.alias("lon"), at.y.alias("lat"))


def tile_folder(spark, sf_dir):
    """A folder of tiles, taken in the order of their names; the second lacks a column, and other files are passed over."""
    folder = new_folder(spark, "tile-folder")
    lattice = _lattice_degrees(spark, sf_dir).select((F.col("comid") + 0.25).alias("NHDPlusID"), (F.col("comid") % 50).cast("double").alias("AreaSqKm"), F.col("lon").alias("LON"), F.col("lat").alias("LAT"), "comid")
    shared = lattice.where("comid % 4 < 3").repartitionByRange("comid").sortWithinPartitions("comid")
    for name, tile in (("NHDFlowline_2", shared.where("comid % 4 = 1").drop("AreaSqKm")), ("NHDFlowline_10", shared.where("comid % 4 <> 1")), ("Other_1", shared)):
        shapefile.write_points(tile.drop("comid"), f"{folder}/{name}.shp")
    at = F.col("parts")[0][0]
    return flowlines.read(spark, folder).select("permanent_", columns.whole_id("nhdplusid").alias("comid"), "areasqkm", at.x.alias("lon"), at.y.alias("lat"))


def flowlines_by_place(spark, sf_dir):
    """Lines laid out by place, of which a box is read; their numbers in the source stay."""
    folder = new_folder(spark, "place")
    lines = _lines(spark, sf_dir).select(F.concat(F.lit("P"), "comid").alias("permanent_"), (-F.col("comid")).alias("file_row"), "parts")
    sinks.write_flowlines(lines, f"{folder}/lines.parquet")
    return flowlines.read(spark, f"{folder}/lines.parquet", bbox=RECTANGLES[0]).select("permanent_", "file_row", *tables.BOUNDS)


QUERIES = {
    f.__name__: f
    for f in (
        flow_monthly,
        flo_parse,
        flo_to_cms,
        obs_compile,
        months,
        net_edges,
        net_degrees,
        net_summary,
        net_topo_level,
        net_cycles,
        vaa_join_routed,
        vaa_join_permanent,
        routed_numbers,
        local_area,
        route_unit,
        route_unknown,
        model_run,
        flow_one_month_points,
        reach_descendants,
        gage_enforce,
        cp_snap,
        cp_paths,
        loss_apply,
        calibrate_rmse,
        calibrate_best,
        calibrate_unknown,
        flo_bad_numbers,
        basin_name_filter,
        basin_options,
        union_tiles,
        vpu_sample,
        spatial_intersects,
        basin_lines,
        basin_crowded,
        line_measures,
        utm_forward,
        albers_forward,
        basin_in_albers,
        tiles_by_record,
        tile_folder,
        flowlines_by_place,
    )
}

# ---- SQL ----

_SEGS = """segs AS (
  SELECT i AS comid, CAST(i AS DOUBLE) AS fromnode, CAST(i // 2 AS DOUBLE) AS tonode,
         CASE WHEN i > 100 AND i % 97 = 0 THEN NULL ELSE CAST(i AS DOUBLE) END AS hydroseq, CAST(p_size AS DOUBLE) AS areasqkm
  FROM (SELECT p_partkey + 1 AS i, p_size FROM part)
  UNION ALL
  SELECT 1000000 + s_suppkey, CAST(x AS DOUBLE), CAST(x // 4 AS DOUBLE), CAST(x AS DOUBLE) - CAST(0.5 AS DOUBLE), CAST(1 AS DOUBLE)
  FROM (SELECT s_suppkey, s_suppkey + 8 AS x FROM supplier)
  UNION ALL
  SELECT 2000000 + k, CAST(m AS DOUBLE), CAST(2 * m AS DOUBLE), CAST(m AS DOUBLE), CAST(0 AS DOUBLE)
  FROM (SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_nationkey AS BIGINT) + 1 AS m FROM nation)
), links AS (
  SELECT DISTINCT a.comid AS up, b.comid AS ds FROM segs a JOIN segs b ON a.tonode = b.fromnode
  WHERE a.hydroseq IS NULL OR b.hydroseq IS NULL OR a.hydroseq > b.hydroseq
)"""
_UNIT = f"""{_SEGS}, walks(src, node, hops) AS (
  SELECT comid, comid, CAST(0 AS BIGINT) FROM segs
  UNION ALL
  SELECT w.src, l.ds, w.hops + 1 FROM walks w JOIN links l ON w.node = l.up
), unit AS (
  SELECT w.node AS comid, CAST(SUM(s.areasqkm) AS DOUBLE) AS q FROM walks w JOIN segs s ON w.src = s.comid GROUP BY w.node
)"""
_DAYS = "CAST(day(last_day(date)) AS DOUBLE) * CAST(86400 AS DOUBLE)"
_MONTHS = f"(SELECT CAST(d AS DATE) AS date FROM generate_series(TIMESTAMP '{START}', TIMESTAMP '{END}', INTERVAL 1 MONTH) t(d))"
_OBS = """(SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, 'G' || l_suppkey AS gage_id,
  SUM(CASE WHEN month(l_shipdate) % 5 = 0 AND l_suppkey % 3 = 0 THEN 0 ELSE l_quantity END) AS acft FROM lineitem GROUP BY ALL)"""
_CMS = f"acft * CAST(1233.48184 AS DOUBLE) / ({_DAYS})"
_FLOW = f"CAST({COEFFICIENT} AS DOUBLE) * q * CAST(1e6 AS DOUBLE) / ({_DAYS})"
_GAGED = "(CASE WHEN s_suppkey % 10 = 7 THEN 9000000 ELSE 1 END + s_suppkey)"
_COMPILED = f"(SELECT date, gage_id, {_GAGED} AS comid, {_CMS} AS flow_cms FROM {_OBS} JOIN supplier ON gage_id = 'G' || s_suppkey WHERE date BETWEEN DATE '{START}' AND DATE '{END}')"
_EARLY = f"date < DATE '{START}' + INTERVAL {CALIBRATION_MONTHS} MONTH"
_SITES = "(SELECT p_partkey + 1 AS comid, CAST((p_partkey * 7919) % 1009 AS DOUBLE) * 128 AS x, CAST((p_partkey * 104729) % 2003 AS DOUBLE) * 64 AS y FROM part)"
_POINTS = """(SELECT 'CP' || i AS UP_CP, 'CP' || (i // 8) AS Next_DS_CP, CAST(i % 17 AS DOUBLE) / 16 AS ChLosFac, i AS file_row,
  CAST(((i - 1) * 7919) % 1009 AS DOUBLE) * 128 + 3 AS x, CAST(((i - 1) * 104729) % 2003 AS DOUBLE) * 64 - 5 AS y FROM (SELECT s_suppkey + 1 AS i FROM supplier))"""
_SNAPPED = f"""near AS (
  SELECT p.UP_CP, p.Next_DS_CP, p.ChLosFac, p.file_row, MIN(ROW((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y), s.comid)) AS best
  FROM {_POINTS} p CROSS JOIN {_SITES} s GROUP BY ALL
), placed AS (SELECT UP_CP, Next_DS_CP, ChLosFac, file_row, best[2] AS UP_COMID, sqrt(best[1]) AS snap_dist FROM near),
snapped AS (SELECT a.*, b.UP_COMID AS DS_COMID FROM placed a LEFT JOIN placed b ON a.Next_DS_CP = b.UP_CP)"""
_PATHS = """steps AS (
  SELECT file_row AS step, UP_COMID AS up, DS_COMID AS ds, ChLosFac AS loss FROM snapped
  WHERE UP_COMID IN (SELECT comid FROM segs) AND DS_COMID IN (SELECT comid FROM segs)
), hop AS (SELECT src, node, MIN(hops) AS hops FROM walks WHERE src IN (SELECT up FROM steps) GROUP BY ALL),
parent AS (
  SELECT c.src, c.node, MIN(l.up) AS par FROM hop c JOIN links l ON l.ds = c.node JOIN hop p ON p.src = c.src AND p.node = l.up AND p.hops = c.hops - 1 GROUP BY ALL
), chain(step, src, node, pos) AS (
  SELECT s.step, s.up, s.ds, h.hops FROM steps s JOIN hop h ON h.src = s.up AND h.node = s.ds WHERE s.up <> s.ds
  UNION ALL
  SELECT c.step, c.src, p.par, c.pos - 1 FROM chain c JOIN parent p ON p.src = c.src AND p.node = c.node
)"""
_LOST = """held AS (SELECT s.*, row_number() OVER (ORDER BY step) AS k FROM steps s WHERE step IN (SELECT step FROM chain)),
mem AS (SELECT h.k, c.node FROM chain c JOIN held h USING (step) WHERE c.pos > 0),
folded(k, comid, q) AS (
  SELECT CAST(0 AS BIGINT), comid, q FROM unit WHERE comid IN (SELECT node FROM mem) OR comid IN (SELECT up FROM held)
  UNION ALL
  SELECT s.k + 1, s.comid, CASE WHEN m.node IS NULL OR d.q <= 0 THEN s.q ELSE s.q * (u.q * (1 - h.loss) / d.q) END
  FROM folded s JOIN held h ON h.k = s.k + 1 JOIN folded u ON u.k = s.k AND u.comid = h.up JOIN folded d ON d.k = s.k AND d.comid = h.ds
  LEFT JOIN mem m ON m.k = h.k AND m.node = s.comid
), left_over AS (SELECT comid, arg_max(q, k) AS q FROM folded GROUP BY comid),
lost AS MATERIALIZED (SELECT comid, COALESCE(l.q, u.q) AS q FROM unit u LEFT JOIN left_over l USING (comid))"""
_ENFORCED = f"""obs AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY gage_id, comid) AS k FROM {_COMPILED} WHERE comid IN (SELECT comid FROM unit)),
reach AS (SELECT DISTINCT src, node FROM walks WHERE src IN (SELECT comid FROM obs)),
state(date, k, comid, q) AS (
  SELECT date, CAST(0 AS BIGINT), comid, q FROM flow WHERE comid IN (SELECT node FROM reach)
  UNION ALL
  SELECT s.date, s.k + 1, s.comid, CASE WHEN r.node IS NULL OR g.q <= 0 THEN s.q ELSE s.q * (o.flow_cms / g.q) END
  FROM state s JOIN obs o ON o.date = s.date AND o.k = s.k + 1 JOIN state g ON g.date = s.date AND g.k = s.k AND g.comid = o.comid
  LEFT JOIN reach r ON r.src = o.comid AND r.node = s.comid
), last AS (SELECT date, comid, arg_max(q, k) AS q FROM state GROUP BY ALL)"""
_INSIDE = "segs AS (SELECT * FROM every_seg WHERE comid < 2000000)"
_LATTICE = f"""(SELECT comid, -102 + x / 16384 + 0.0052 AS lon, 26.0003 + y / 16384 AS lat FROM {_SITES}
  UNION ALL SELECT 1000000 + s_suppkey, -102 + (CAST(s_suppkey % 997 AS DOUBLE) * 128 + 64) / 16384 + 0.0052, 26.0003 + (CAST(s_suppkey % 1999 AS DOUBLE) * 64 + 32) / 16384 FROM supplier)"""
_AT_HOME = """snapped AS (SELECT s_suppkey + 1 AS file_row, s_suppkey + 1 AS UP_COMID, CASE WHEN s_suppkey >= 7 THEN (s_suppkey + 1) // 8 END AS DS_COMID, CAST((s_suppkey + 1) % 17 AS DOUBLE) / 16 AS ChLosFac FROM supplier)"""
_GRID = "(SELECT i, CAST(0.0001 AS DOUBLE) + CAST(i AS DOUBLE) * ((CAST(0.005 AS DOUBLE) - CAST(0.0001 AS DOUBLE)) / 29) AS coeff FROM range(30) t(i))"
_ERRORS = f"""pairs AS (SELECT q * CAST(1e6 AS DOUBLE) / CAST(2592000 AS DOUBLE) AS u, flow_cms AS o FROM {_COMPILED} c JOIN unit USING (comid) WHERE {_EARLY}),
errors AS (SELECT i, coeff, sqrt(AVG((coeff * u - o) * (coeff * u - o))) AS rmse FROM pairs CROSS JOIN {_GRID} GROUP BY i, coeff)"""


def _touch(w: float, s: float, e: float, n: float) -> str:
    """A line from (x, y) by (dx, dy) meets a rectangle where the parts inside its four sides share a stretch."""
    low = f"greatest(0, least(({w} - x) / dx, ({e} - x) / dx), least(({s} - y) / dy, ({n} - y) / dy))"
    high = f"least(1, greatest(({w} - x) / dx, ({e} - x) / dx), greatest(({s} - y) / dy, ({n} - y) / dy))"
    return f"{low} <= {high}"


def _utm_sql() -> str:
    k = 2 * crs._N**0.5 / (1 + crs._N)
    d = lambda v: f"CAST({v!r} AS DOUBLE)"
    east = " + ".join(f"{d(a)} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(crs._ALPHA, 1))
    north = " + ".join(f"{d(a)} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(crs._ALPHA, 1))
    return f"""WITH pos AS (SELECT comid, radians(CAST(-102 AS DOUBLE) + x / 16384 - CAST(-99 AS DOUBLE)) AS turn, radians(CAST(26 AS DOUBLE) + y / 16384) AS phi FROM {_SITES}),
t AS (SELECT comid, turn, sinh(atanh(sin(phi)) - {d(k)} * atanh({d(k)} * sin(phi))) AS t FROM pos),
r AS (SELECT comid, atan2(t, cos(turn)) AS xi, atanh(sin(turn) / sqrt(1 + t * t)) AS eta FROM t)
SELECT comid, printf('%.3f', {d(500000.0)} + {d(crs._SCALE)} * (eta + {east})) AS easting, printf('%.3f', {d(crs._SCALE)} * (xi + {north})) AS northing, true AS lon_back, true AS lat_back FROM r"""


_Q = "(1 - e ** 2) * ({0} / (1 - e ** 2 * {0} ** 2) - 1 / (2 * e) * ln((1 - e * {0}) / (1 + e * {0})))"

ORACLES = {
    "flow_monthly": f"WITH RECURSIVE {_UNIT} SELECT date, comid, {_FLOW} AS flow_cms FROM unit CROSS JOIN {_MONTHS}",
    "flo_parse": f"""WITH obs AS (SELECT * FROM {_OBS}), years AS (SELECT DISTINCT gage_id, year(date) AS y FROM obs)
SELECT make_date(y, m, 1) AS date, gage_id, COALESCE(acft, 0) AS acft FROM (SELECT gage_id, y, CAST(m AS BIGINT) AS m FROM years CROSS JOIN range(1, 13) t(m)) g
LEFT JOIN obs o USING (gage_id) WHERE FALSE
UNION ALL
SELECT make_date(g.y, g.m, 1), g.gage_id, COALESCE(o.acft, 0) FROM (SELECT gage_id, y, CAST(m AS BIGINT) AS m FROM years CROSS JOIN range(1, 13) t(m)) g
LEFT JOIN obs o ON o.gage_id = g.gage_id AND o.date = make_date(g.y, g.m, 1)""",
    "flo_to_cms": f"SELECT date, gage_id, {_CMS} AS flow_cms FROM {_OBS}",
    "obs_compile": f"SELECT * FROM {_COMPILED}",
    "months": """WITH b AS (SELECT CAST(MIN(l_shipdate) AS DATE) + 3 AS a, CAST(MAX(l_shipdate) AS DATE) AS z FROM lineitem)
SELECT CAST(d AS DATE) AS date, CAST(day(last_day(CAST(d AS DATE))) AS BIGINT) AS days FROM b, generate_series(CAST(date_trunc('month', a) AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 1 MONTH) t(d) WHERE d >= a""",
    "net_edges": f"WITH {_SEGS} SELECT * FROM links",
    "net_degrees": f"""WITH {_SEGS} SELECT comid, CAST((SELECT COUNT(*) FROM links WHERE ds = comid) AS BIGINT) AS in_degree,
CAST((SELECT COUNT(*) FROM links WHERE up = comid) AS BIGINT) AS out_degree FROM segs""",
    "net_summary": f"""WITH {_SEGS} SELECT (SELECT COUNT(*) FROM segs) AS nodes, (SELECT COUNT(*) FROM links) AS edges,
(SELECT COUNT(*) FROM segs WHERE comid NOT IN (SELECT ds FROM links)) AS sources, (SELECT COUNT(*) FROM segs WHERE comid NOT IN (SELECT up FROM links)) AS sinks""",
    "net_topo_level": f"WITH RECURSIVE {_UNIT} SELECT node AS comid, MAX(hops) AS topo_level FROM walks GROUP BY node",
    "vaa_join_routed": f"WITH {_SEGS} SELECT comid, 'P' || comid AS permanent_, fromnode, tonode, hydroseq FROM segs WHERE comid % 13 <> 0 AND comid % 11 <> 0",
    "local_area": f"""WITH {_SEGS} SELECT comid, CASE WHEN comid % 5 = 0 THEN 0 ELSE areasqkm END AS area_km2, 0 AS tier FROM segs
UNION ALL SELECT comid, CASE WHEN comid % 7 = 0 THEN 0 ELSE areasqkm * 3 END, 1 FROM segs
UNION ALL SELECT comid, CASE WHEN comid % 3 = 0 THEN NULL ELSE (areasqkm + 1) * 2 END, 2 FROM segs
UNION ALL SELECT comid, areasqkm * 5 * 2, 3 FROM segs""",
    "route_unit": f"WITH RECURSIVE {_UNIT} SELECT * FROM unit",
    "flow_one_month_points": f"""WITH RECURSIVE {_UNIT}, f AS (
  SELECT date, comid, {_FLOW} * CASE WHEN comid % 11 = 0 THEN CAST(1e22 AS DOUBLE) WHEN comid % 13 = 0 THEN CAST(-1e22 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS flow FROM unit CROSS JOIN (SELECT DATE '{END}' AS date))
SELECT strftime(date, '%Y-%m-%d') AS DATE, comid AS COMID, least(greatest(flow, -1e20), 1e20) AS FLOW_CMS, printf('%.6e', flow) AS FLOW_TXT,
CAST(comid % 90 AS DOUBLE) AS LAT, CAST(comid % 180 AS DOUBLE) AS LON, 'POINT (' || (comid % 180) || ' ' || (comid % 90) || ')' AS WKT FROM f""",
    "reach_descendants": f"WITH RECURSIVE {_UNIT} SELECT src, node AS comid, MIN(hops) AS hops FROM walks WHERE src IN (SELECT {_GAGED} FROM supplier) GROUP BY ALL",
    "gage_enforce": f"""WITH RECURSIVE {_UNIT}, flow AS (SELECT date, comid, {_FLOW} AS q FROM unit CROSS JOIN {_MONTHS}), {_ENFORCED}
SELECT f.date, f.comid, COALESCE(l.q, f.q) AS flow_cms FROM flow f LEFT JOIN last l USING (date, comid)""",
    "cp_snap": f"WITH {_SNAPPED} SELECT UP_CP, Next_DS_CP, ChLosFac, file_row, UP_COMID, DS_COMID, snap_dist FROM snapped",
    "cp_paths": f"WITH RECURSIVE {_UNIT}, {_SNAPPED}, {_PATHS} SELECT step, pos, node AS comid FROM chain",
    "loss_apply": f"WITH RECURSIVE {_UNIT}, {_SNAPPED}, {_PATHS}, {_LOST} SELECT comid, q FROM lost",
    "calibrate_rmse": f"WITH RECURSIVE {_UNIT}, {_ERRORS} SELECT i, coeff, rmse FROM errors",
    "calibrate_best": f"WITH RECURSIVE {_UNIT}, {_ERRORS} SELECT coeff, rmse FROM errors ORDER BY errors.rmse, i LIMIT 1",
    "calibrate_unknown": "SELECT i, CAST(NULL AS DOUBLE) AS rmse, false AS has_best FROM range(30) t(i)",
    "route_unknown": f"""WITH RECURSIVE {_UNIT}, unknown AS (SELECT DISTINCT node AS comid FROM walks WHERE src % 50 = 0)
SELECT comid, CASE WHEN comid IN (SELECT comid FROM unknown) THEN NULL ELSE 2 * q END AS q FROM unit""",
    "flo_bad_numbers": """SELECT 'as it is' AS file, '' AS error, COUNT(*) * 12 AS rows FROM (SELECT DISTINCT l_suppkey, year(l_shipdate) FROM lineitem)
UNION ALL VALUES ('a value', 'not a number', 0), ('a year', 'not a number', 0), ('short lines only', 'no rows', 0)""",
    "net_cycles": "SELECT * FROM (VALUES ('as it is', false), ('a long way back', true), ('a segment that leads to itself', true)) t(network, cycle)",
    "vaa_join_permanent": f"WITH {_SEGS} SELECT comid, 'P' || comid AS permanent_, fromnode, tonode, hydroseq FROM segs WHERE comid % 17 <> 0 AND comid % 19 <> 0",
    "routed_numbers": f"WITH {_SEGS} SELECT row_number() OVER (ORDER BY comid DESC) AS comid, 'P' || comid AS permanent_ FROM segs WHERE comid % 23 <> 0",
    "model_run": f"""WITH RECURSIVE {_UNIT.replace("segs AS", "every_seg AS", 1).replace("), links AS", "), " + _INSIDE + ", links AS", 1)}, {_AT_HOME}, {_PATHS}, {_LOST},
flow AS (SELECT date, comid, {_FLOW} AS q FROM (SELECT comid, q, CAST(unnest(generate_series(TIMESTAMP '{START}', TIMESTAMP '{MODEL_END}', INTERVAL 1 MONTH)) AS DATE) AS date FROM lost)), {_ENFORCED}
SELECT f.date, f.comid, COALESCE(l.q, f.q) AS flow_cms, round(p.lat, 3) AS lat, round(p.lon, 3) AS lon
FROM flow f JOIN {_LATTICE} p USING (comid) LEFT JOIN last l USING (date, comid)""",
    "basin_name_filter": "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region WHERE lower(r_name) = 'europe'",
    "basin_options": "SELECT DISTINCT n_name AS name FROM nation",
    "union_tiles": f"WITH {_SEGS} SELECT comid, CASE WHEN comid < 1000000 THEN areasqkm END AS areasqkm, CASE WHEN comid >= 1000000 THEN areasqkm END AS lengthkm FROM segs",
    "vpu_sample": "SELECT DISTINCT p_brand AS vpuid FROM part WHERE p_partkey % 7 <> 0 AND p_brand >= 'Brand#2' ORDER BY 1 LIMIT 12",
    "spatial_intersects": f"""WITH l AS (SELECT comid, x, y, CAST(3000 + comid % 17 AS DOUBLE) AS dx, CAST(5000 - comid % 13 AS DOUBLE) AS dy FROM {_SITES})
SELECT comid FROM l WHERE {" OR ".join(_touch(*r) for r in RECTANGLES)}""",
    "basin_lines": f"""WITH l AS (SELECT comid, x, y, CAST(3000 + comid % 17 AS DOUBLE) AS dx, CAST(5000 - comid % 13 AS DOUBLE) AS dy FROM {_SITES}),
t AS (SELECT * FROM l UNION ALL SELECT * FROM l WHERE comid % 3 = 0)
SELECT CASE WHEN comid % 7 = 0 THEN NULL WHEN comid % 5 = 0 THEN 'P' ELSE 'P' || comid END AS permanent_, x FROM t WHERE {" OR ".join(_touch(*r) for r in RECTANGLES)}""",
    "basin_crowded": f"""WITH w AS (SELECT *, comid % 4 = 0 AS far FROM {_SITES}),
l AS (SELECT comid, CASE WHEN far THEN x * 1.5 - 98304 ELSE 32264 + x / 128 END + CAST(0.25 AS DOUBLE) AS x, CASE WHEN far THEN y - 64064 ELSE 31767 + y / 64 END + CAST(0.125 AS DOUBLE) AS y,
  CAST((comid % 17 - 8) * (CASE WHEN far THEN 64 ELSE 1 END) AS DOUBLE) AS dx, CAST((comid % 13 - 6) * (CASE WHEN far THEN 64 ELSE 1 END) AS DOUBLE) AS dy FROM w)
SELECT comid FROM l WHERE least(abs(x) + abs(y), abs(x + dx) + abs(y + dy), CASE WHEN x * (x + dx) < 0 THEN abs(y - x * dy / dx) ELSE 1e300 END,
  CASE WHEN y * (y + dy) < 0 THEN abs(x - y * dx / dy) ELSE 1e300 END) <= {HALF}""",
    "line_measures": f"""WITH l AS (SELECT comid, x, y, CAST(comid % 5 + 1 AS DOUBLE) AS k FROM {_SITES})
SELECT comid, printf('%.6f', 500 + 130 * k) AS length, printf('%.4f', (500 * (x + 150) + 130 * k * (x + 300 + 60 * k)) / (500 + 130 * k)) AS cx,
printf('%.4f', (500 * (y + 200) + 130 * k * (y + 400 + 25 * k)) / (500 + 130 * k)) AS cy FROM l""",
    "utm_forward": _utm_sql(),
    "albers_forward": f"""WITH c AS (SELECT sqrt(f * (2 - f)) AS e, radians(CAST(29.5 AS DOUBLE)) AS p1, radians(CAST(45.5 AS DOUBLE)) AS p2, radians(CAST(23 AS DOUBLE)) AS p0 FROM (SELECT 1 / CAST(298.257222101 AS DOUBLE) AS f)),
k AS (SELECT e, {_Q.format("sin(p1)")} AS q1, {_Q.format("sin(p2)")} AS q2, {_Q.format("sin(p0)")} AS q0, cos(p1) ** 2 / (1 - e ** 2 * sin(p1) ** 2) AS m1, cos(p2) ** 2 / (1 - e ** 2 * sin(p2) ** 2) AS m2 FROM c),
n AS (SELECT *, (m1 - m2) / (q2 - q1) AS n, m1 + (m1 - m2) / (q2 - q1) * q1 AS c FROM k),
p AS (SELECT comid, n, radians(CAST(-102 AS DOUBLE) + x / 16384 + 96) * n AS turn, CAST(6378137 AS DOUBLE) * sqrt(c - n * q0) / n AS rho0,
  CAST(6378137 AS DOUBLE) * sqrt(c - n * {_Q.format("sin(radians(CAST(26 AS DOUBLE) + y / 16384))")}) / n AS rho FROM {_SITES} CROSS JOIN n)
SELECT comid, round(rho * sin(turn), 3) AS x, round(rho0 - rho * cos(turn), 3) AS y, true AS lon_back, true AS lat_back FROM p""",
    "basin_in_albers": f"""SELECT comid FROM {_SITES} WHERE CAST(-102 AS DOUBLE) + x / 16384 BETWEEN {DEGREES[0]} AND {DEGREES[2]} AND CAST(26 AS DOUBLE) + y / 16384 BETWEEN {DEGREES[1]} AND {DEGREES[3]}""",
    "tiles_by_record": f"""SELECT CAST(row_number() OVER (ORDER BY (comid + 1) % 3, comid) AS VARCHAR) AS permanent_, comid, CAST(comid * 7 % 101 AS DOUBLE) AS area,
CAST(-102 AS DOUBLE) + x / 16384 AS lon, CAST(26 AS DOUBLE) + y / 16384 AS lat FROM {_SITES}""",
    "tile_folder": f"""SELECT CAST(row_number() OVER (ORDER BY comid % 4 = 1, comid) AS VARCHAR) AS permanent_, comid, CASE WHEN comid % 4 <> 1 THEN CAST(comid % 50 AS DOUBLE) END AS areasqkm,
CAST(-102 AS DOUBLE) + x / 16384 AS lon, CAST(26 AS DOUBLE) + y / 16384 AS lat FROM {_SITES} WHERE comid % 4 < 3""",
    "flowlines_by_place": f"""WITH l AS (SELECT comid, row_number() OVER (ORDER BY comid DESC) - 1 AS file_row, x AS xmin, y AS ymin, x + 3000 + comid % 17 AS xmax, y + 5000 - comid % 13 AS ymax FROM {_SITES})
SELECT 'P' || comid AS permanent_, file_row, xmin, ymin, xmax, ymax FROM l
WHERE xmin <= {RECTANGLES[0][2]} AND xmax >= {RECTANGLES[0][0]} AND ymin <= {RECTANGLES[0][3]} AND ymax >= {RECTANGLES[0][1]}""",
}
