"""Command line (V3): python -m freshet --flowline-source ... ; the control-point and flow files have no defaults."""

from __future__ import annotations

import argparse
import logging

from freshet.config import DEFAULTS, ModelConfig

_NUMBERS = {"runoff_coeff_m_per_month": float, "calibration_months": int}


def parse_args(argv: list[str] | None = None) -> ModelConfig:
    parser = argparse.ArgumentParser(prog="freshet", description="Monthly streamflow of every segment of a river network.")
    for name, default in DEFAULTS.items():
        flag = "--" + name.replace("_", "-")
        if isinstance(default, bool):
            parser.add_argument(flag, dest=name, action="store_true")
        else:
            parser.add_argument(flag, dest=name, type=_NUMBERS.get(name, str), default=default)
    return ModelConfig.of(**vars(parser.parse_args(argv)))


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from freshet.plans.model import run_model

    logging.basicConfig(level=logging.INFO, format="%(message)s")
    cfg = parse_args(argv).validated()
    spark = SparkSession.builder.appName("freshet").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    run_model(cfg, spark)


if __name__ == "__main__":
    main()
