"""Local area and runoff (AR1, H3, H4, J10)."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions import crs, geometry
from freshet.functions.columns import local_runoff, month_seconds, number

log = logging.getLogger("freshet")


def local_area(segments: DataFrame, zone: int | None = None) -> DataFrame:
    """comid and area_km2, from the first column that has any value: areasqkm, totdasqkm (nulls are 0 in both), twice
    lengthkm (nulls stay), else twice the length in kilometres of `parts` in the UTM zone.

    The choice is for the table, not the row. totdasqkm holds whole drainage areas, so sums of it count areas again.
    """
    present = [c for c in ("areasqkm", "totdasqkm") if c in segments.columns]
    counts = segments.agg(F.lit(0).alias("_"), *[F.count(number(c)).alias(c) for c in present]).first()
    for c in present:
        if counts[c]:
            if c == "totdasqkm":  # T4
                log.warning("areas come from totdasqkm, which holds whole drainage areas: routed flows count areas again")
            return segments.select("comid", F.coalesce(number(c), F.lit(0.0)).alias("area_km2"))
    if "lengthkm" in segments.columns:
        return segments.select("comid", (number("lengthkm") * 2.0).alias("area_km2"))
    if "parts" not in segments.columns:
        raise KeyError("segments have none of areasqkm, totdasqkm, lengthkm and parts")
    return segments.select("comid", (geometry.length(projected(F.col("parts"), zone)) / 1000.0 * 2.0).alias("area_km2"))


def projected(parts: Column, zone: int | None) -> Column:
    """Degrees to the UTM zone; without a zone the coordinates are metres already."""
    return parts if zone is None else geometry.transformed(parts, lambda x, y: crs.to_utm(x, y, zone))


def monthly(unit_flow: DataFrame, dates: DataFrame, coefficient: float, *keep: str) -> DataFrame:
    """Date, comid and flow_cms from `q`, the routed area in square kilometres, and the columns `keep`.

    Routing is linear, so it runs once and each month only scales it. Months are few; segments are never shuffled.
    """
    flow = local_runoff(F.lit(coefficient), F.col("q"), month_seconds("date"))
    return unit_flow.crossJoin(F.broadcast(dates)).select("date", "comid", flow.alias("flow_cms"), *keep)


def by_segment(unit_flow: DataFrame, dates: DataFrame, coefficient: float, *keep: str) -> DataFrame:
    """As `monthly`, with a segment's months in one row: comid, flows (an array of date and flow_cms) and the columns `keep`."""
    every = dates.agg(F.collect_list("date").alias("dates"))  # months of a run
    flow = lambda d: local_runoff(F.lit(coefficient), F.col("q"), month_seconds(d))
    return unit_flow.crossJoin(F.broadcast(every)).select("comid", F.transform("dates", lambda d: F.struct(d.alias("date"), flow(d).alias("flow_cms"))).alias("flows"), *keep)
