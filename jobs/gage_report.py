"""Job: modelled against observed flow at every gage and month, and how well each gage is met.

Modellers judge a run by its gages before they trust its flows elsewhere. The job compiles the observations, routes
the runoff to the gages, and writes two tables under `out`:

* `months`, by year and month: date, gage_id, comid, observed_cms, modeled_cms and a verdict (met, high, low, dry: nothing
  observed, or unmodeled: no flow in the model);
* `gages`, by verdict share of each gage over all months known so far: n_months, n_met, bias, rmse and nse (the
  Nash-Sutcliffe efficiency, null where the observations don't vary), in folders by `grade` (good, fair, poor).

A run replaces the months of its own period and no others, then takes `gages` anew from all months there, so that it
can be repeated, or go over a past period again, with the same result.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions.columns import local_runoff, month_seconds
from freshet.operators import gages, network, runoff
from freshet.plans import inputs
from freshet.scratch import cut, scope, tidy_shuffles
from jobs.common import counted, main

log = logging.getLogger("jobs.gage_report")


@dataclass
class Config:
    tables: str
    out: str
    start: str
    end: str
    coefficient: float = 0.0008
    low: float = 0.5
    high: float = 2.0
    good: float = 0.5


def compared(observations: DataFrame, unit_flow: DataFrame, config: Config) -> DataFrame:
    """The rows of `months`; gages outside the network have none."""
    modeled = local_runoff(F.lit(config.coefficient), F.col("q"), month_seconds("date"))
    rows = observations.join(unit_flow, "comid").select("date", "gage_id", "comid", F.col("flow_cms").alias("observed_cms"), modeled.alias("modeled_cms"))
    ratio = F.col("modeled_cms") / F.nullif("observed_cms", F.lit(0.0))
    verdict = F.when(F.col("observed_cms") <= 0, "dry").when(F.col("modeled_cms") <= 0, "unmodeled").when(ratio > config.high, "high").when(ratio < config.low, "low").otherwise("met")
    return rows.withColumn("verdict", verdict).withColumn("year", F.year("date")).withColumn("month", F.month("date"))


def graded(months: DataFrame, config: Config) -> DataFrame:
    """The rows of `gages`. A gage's months, one each, are summed in their order, so that every run gives the same digits."""
    held = months.groupBy("gage_id", "comid").agg(
        F.count(F.lit(1)).alias("n_months"),
        F.count_if(F.col("verdict") == "met").alias("n_met"),
        F.array_sort(F.collect_list(F.struct("date", F.col("observed_cms").alias("o"), F.col("modeled_cms").alias("m")))).alias("rows"),
    )
    mean = lambda value: F.aggregate("rows", F.lit(0.0), lambda total, r: total + value(r)) / F.col("n_months")
    error = lambda r: r.m - r.o
    about = lambda r: (r.o - F.col("level")) * (r.o - F.col("level"))
    sums = held.withColumn("level", mean(lambda r: r.o)).select("*", mean(error).alias("bias"), F.sqrt(mean(lambda r: error(r) * error(r))).alias("rmse"), mean(about).alias("spread"))
    nse = F.when(F.col("spread") > 0, 1.0 - F.col("rmse") * F.col("rmse") / F.col("spread"))
    share = F.col("n_met") / F.col("n_months")
    grade = F.when(share >= config.good, "good").when(share * 2 >= config.good, "fair").otherwise("poor")
    return sums.select("gage_id", "comid", "n_months", "n_met", "bias", "rmse", nse.alias("nse"), grade.alias("grade"))


def run(spark: SparkSession, config: Config) -> None:
    with scope(spark), tidy_shuffles(spark):
        segments = cut(inputs.segments(spark, config.tables, apart=True), "report-segments")
        links = cut(network.edges(segments), "report-edges")
        closure = network.powers(links, segments.count())
        unit = inputs.named(network.accumulate(runoff.local_area(segments).withColumnRenamed("area_km2", "q"), closure))
        observed = gages.compile_observations(inputs.observations(spark, config.tables), config.start, config.end, inputs.crosswalk(spark, config.tables))
        observed, read = counted(observed, "report read")
        months, wrote = counted(compared(observed, unit, config), "report months")
        months.repartition("year", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month").parquet(f"{config.out}/months")
        log.info("read %s observations of %s to %s from %s", read.get["rows"], config.start, config.end, config.tables)
        log.info("wrote %s rows to %s/months", wrote.get["rows"], config.out)
        held, seen = counted(graded(spark.read.parquet(f"{config.out}/months"), config), "report gages")
        held.write.mode("overwrite").partitionBy("grade").parquet(f"{config.out}/gages")
        log.info("wrote %s rows to %s/gages", seen.get["rows"], config.out)


def result(spark: SparkSession, out: str) -> DataFrame:
    """Both tables as they stand: every month with its gage's figures."""
    months = spark.read.parquet(f"{out}/months").drop("year", "month")
    return months.join(spark.read.parquet(f"{out}/gages"), ["gage_id", "comid"])


if __name__ == "__main__":
    main(run, Config, "Modelled against observed flow at gages")
