"""Gage observations and calibration (H2, J4, F9, F11-F13, CA1, CA2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.functions.columns import acft_month_to_cms, linspace

#: The coefficients that calibration tries (fixed values): first, last, how many.
COEFFICIENTS = (0.0001, 0.0050, 30)
CALIBRATION_SECONDS = 30 * 86400.0


def compile_observations(flo: DataFrame, start: str, end: str, crosswalk: DataFrame | None) -> DataFrame:
    """H2: date, gage_id, comid, flow_cms of the gages that the crosswalk places; without one, no rows."""
    held = flo.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).withColumn("flow_cms", acft_month_to_cms("acft", "date"))
    if crosswalk is None:
        return held.select("date", "gage_id", F.lit(None).cast("long").alias("comid"), "flow_cms").where(F.lit(False))
    placed = crosswalk.select("gage_id", F.col("COMID").cast("long").alias("comid"))
    return held.join(placed, "gage_id").select("date", "gage_id", "comid", "flow_cms")


def first_dates(observations: DataFrame, dates: DataFrame, n: int) -> DataFrame:
    """Observations of the first `n` of `dates` (few by nature)."""
    return observations.join(F.broadcast(dates.orderBy("date").limit(n)), "date", "left_semi")


def calibration_table(observations: DataFrame, unit_flow: DataFrame) -> DataFrame:
    """CA1, A9: i, coeff, rmse for every coefficient; no rows when no observation lies in the network.

    Routing is linear: a coefficient's error at an observation is c u - o with u the routed area over a thirty-day
    month. One aggregate has a sum of squares for every coefficient. Unknown flows, null or NaN, make the errors NaN;
    observations outside the network don't count.
    """
    nan = F.lit(float("nan"))
    u = F.coalesce(F.col("q"), nan) * 1.0e6 / F.lit(CALIBRATION_SECONDS)
    rows = observations.join(unit_flow, "comid").select(u.alias("u"), F.coalesce("flow_cms", nan).alias("o"))
    tried = linspace(*COEFFICIENTS)
    error = lambda c: F.lit(c) * F.col("u") - F.col("o")
    means = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(error(c) * error(c)).alias(f"e{i}") for i, c in enumerate(tried)])
    each = F.array(*[F.struct(F.lit(c).alias("coeff"), F.sqrt(f"e{i}").alias("rmse")) for i, c in enumerate(tried)])
    return means.where("n > 0").select(F.posexplode(each).alias("i", "t")).select("i", "t.coeff", "t.rmse")


def best_coefficient(table: DataFrame) -> DataFrame:
    """A10: coeff and rmse of the least error; the first wins a tie, NaN never wins."""
    held = table.where(~F.isnan("rmse") & F.col("rmse").isNotNull())
    return held.agg(F.min_by("coeff", F.struct("rmse", "i")).alias("coeff"), F.min("rmse").alias("rmse")).where("coeff is not null")


def calibrate(observations: DataFrame, unit_flow: DataFrame, dates: DataFrame, months: int) -> float:
    """The coefficient; ValueError when there is no observation to calibrate by."""
    if observations.isEmpty():
        raise ValueError("calibration needs gage observations")
    early = first_dates(observations, dates, months)
    if early.isEmpty():
        raise ValueError("no gage observations in the calibration months")
    table = calibration_table(early, unit_flow)
    best = best_coefficient(table).first()
    if best is None:
        raise ValueError("no gage observation lies in the network" if table.isEmpty() else "calibration by unknown flows: no coefficient has an error")
    return best["coeff"]
