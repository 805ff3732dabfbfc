"""The whole model run: from files to monthly flows of every segment."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet import sinks
from freshet.config import ModelConfig
from freshet.functions import crs, geometry
from freshet.functions.columns import months
from freshet.operators import control_points, folds, gages, network, runoff, spatial
from freshet.progress import ticking
from freshet.scratch import cut, scope
from freshet.sources import archives, flo, flowlines, tables

log = logging.getLogger("freshet")


@dataclass
class Network:
    """Segments (comid, hydroseq, areas, parts, ...), edges (up, ds), their closure, which is computed once, and the UTM zone."""

    segments: DataFrame
    links: DataFrame
    closure: network.Powers
    zone: int | None


def is_geographic(box: tuple[float, float, float, float]) -> bool:
    """Whether coordinates look like degrees; flow tables of other units are taken as metres."""
    return -180 <= box[0] and box[2] <= 180 and -90 <= box[1] and box[3] <= 90


def in_system(polygons: DataFrame, source: crs.Crs | None, target: crs.Crs | None) -> DataFrame:
    """SP3: the polygons' corners in the target's coordinates; as they are where a system isn't known."""
    if source is None or target is None or source == target or source.geographic and target.geographic:
        return polygons
    return polygons.withColumn("parts", geometry.transformed(F.col("parts"), crs.between(source, target)))


def build_network(spark: SparkSession, flow: DataFrame, basin: DataFrame, vaa: DataFrame | None = None, system: crs.Crs | None = None) -> Network:
    """Flowlines that touch the basin, routed, as a checked acyclic network.

    Both are in coordinates of `system`; lines of a projected one are in degrees from here on.
    """
    inside = cut(spatial.intersecting(flow, basin), "inside")
    if inside.isEmpty():
        raise ValueError(f"no flowline touches the basin; regions in the source: {', '.join(tables.vpu_sample(flow)) or 'unknown'}")
    if system and not system.geographic:
        inside = inside.withColumn("parts", geometry.transformed(F.col("parts"), crs.to_degrees(system)))
    segments = network.routed(inside, vaa)
    links = cut(network.edges(segments), "edges")
    nodes = network.validate(segments, links, log.info)["nodes"]
    box = geometry.bounds(segments)
    return Network(segments, links, network.powers(links, nodes), crs.utm_zone(box[0], box[2]) if is_geographic(box) else None)


def centroids(net: Network) -> DataFrame:
    """comid, x, y in metres, and lon, lat (null where the coordinates aren't degrees)."""
    c = geometry.centroid(runoff.projected(F.col("parts"), net.zone))
    at = net.segments.select("comid", c.alias("c")).select("comid", "c.x", "c.y")
    if net.zone is None:
        return at.withColumns({"lon": F.lit(None).cast("double"), "lat": F.lit(None).cast("double")})
    lon, lat = crs.from_utm(F.col("x"), F.col("y"), net.zone)
    return at.withColumn("lon", lon).withColumn("lat", lat)


def routed_area(net: Network) -> DataFrame:
    """comid and q: the area that drains to each segment, over every path."""
    return network.accumulate(runoff.local_area(net.segments, net.zone).withColumnRenamed("area_km2", "q"), net.closure)


def flows(
    net: Network,
    unit: DataFrame,
    dates: DataFrame,
    coefficient: float,
    steps: DataFrame | None = None,
    members: DataFrame | None = None,
    observations: DataFrame | None = None,
) -> DataFrame:
    """date, comid, flow_cms after routing, losses and gages. `unit` is the routed area.

    Routing and losses are linear in the local flow (of positive coefficients), so they run once, on areas.
    """
    if steps is not None:
        unit = cut(folds.apply_losses(steps, members, unit), "lost")
    if observations is None:
        return runoff.monthly(unit, dates, coefficient)
    gaged = observations.select("comid").distinct().join(net.segments.select("comid"), "comid", "left_semi")
    return enforced(unit, dates, coefficient, observations, cut(network.reach(gaged, net.closure), "gage-reach"))


def enforced(unit: DataFrame, dates: DataFrame, coefficient: float, observations: DataFrame, reached: DataFrame) -> DataFrame:
    """date, comid, flow_cms of every month with its gages enforced. Segments below a gage go with all their months in one row; months multiply the others only."""
    slots = folds.gage_slots(observations, reached)
    own = cut(folds.segment_slots(slots, reached), "segment-slots")
    at_gages = runoff.monthly(unit.join(slots.select("comid").distinct(), "comid", "left_semi"), dates, coefficient)
    below = runoff.by_segment(unit.join(own, "comid"), dates, coefficient, "slots")
    beside = runoff.monthly(unit.join(own, "comid", "left_anti"), dates, coefficient)
    return beside.unionByName(folds.enforced_below(slots, reached, below, at_gages))


def run_model(cfg: ModelConfig, spark: SparkSession, progress_cb: Callable[[int, str], None] | None = None) -> DataFrame:
    """V2: run the model, write what the configuration asks for, and return date, comid, flow_cms, lat, lon, topo_level.

    All tables that the run wrote in between are deleted at its end; the result is one of its own.
    """

    def progress(percent: int, stage: str) -> None:
        log.info("%s (%s %%)", stage, percent)
        if progress_cb:
            progress_cb(max(0, min(100, percent)), stage)

    cfg.validated()
    with scope(spark) as held:
        progress(1, "reading the basin and flowlines")
        basin = spatial.basin(tables.read_any(spark, cfg.basin_shp), cfg.basin_name_field, cfg.basin_name_value)
        source = archives.prepare(cfg.flowline_source)
        system = flowlines.crs_of(spark, source)
        basin = in_system(basin, tables.crs_of(spark, cfg.basin_shp), system)
        flow = flowlines.read(spark, source, cfg.flowline_layer, geometry.bounds(basin))
        vaa = None
        if not {"fromnode", "tonode"} <= set(flow.columns):
            vaa = tables.vaa(spark, cfg.vaa_file) if cfg.vaa_file else flowlines.embedded_vaa(spark, source)
        net = build_network(spark, flow, basin, vaa, system)
        levels = network.levels(net.segments, net.closure)
        progress(20, "network built")
        at = cut(centroids(net), "centroids")
        points = tables.control_points(spark, cfg.cp_meta_file)
        x, y = crs.to_utm(F.col("LONG"), F.col("LAT"), net.zone) if net.zone else (F.col("LONG"), F.col("LAT"))
        snapped = control_points.snap(control_points.xy(points, x, y), at.select("comid", "x", "y"))
        steps = cut(control_points.pairs(snapped, net.segments), "steps")
        path_rows = control_points.paths(steps, net.links, net.closure)
        steps = steps.join(path_rows.select("step").distinct(), "step", "left_semi")
        progress(25, "control points placed")
        observed = flo.read(spark, cfg.flo_file)  # read even if no gage is placed: a broken file is an error
        placed = tables.crosswalk(spark, cfg.gage_crosswalk_file) if cfg.gage_crosswalk_file else None
        if placed is None:
            log.info("no gage crosswalk: gages are not enforced, and calibration has nothing to go by")
        observations = cut(gages.compile_observations(observed, cfg.start_date, cfg.end_date, placed), "observations")
        progress(35, "observations read")
        dates = months(spark, cfg.start_date, cfg.end_date)
        unit = routed_area(net)
        coefficient = cfg.runoff_coeff_m_per_month
        if cfg.calibrate:
            coefficient = gages.calibrate(observations, unit, dates, cfg.calibration_months)
            log.info("calibrated coefficient: %.6f m a month", coefficient)
        progress(42, "flows")
        with ticking(spark, lambda percent: progress(percent, "flows"), 42, 92):
            out = flows(net, unit, dates, coefficient, steps, control_points.members(path_rows), None if placed is None else observations)
            result = cut(out.join(at.select("comid", "lat", "lon"), "comid").join(levels, "comid").select("date", "comid", "flow_cms", "lat", "lon", "topo_level"), "flows")
        held.keep(result)
    progress(92, "writing")
    sinks.write_flows(result, cfg.output_file)
    if cfg.output_shapefile:
        progress(96, "writing the shapefile")
        sinks.write_points(result, cfg.output_shapefile, cfg.shapefile_date or str(dates.agg(F.max("date")).first()[0]))
    progress(100, "done")
    return result
