"""What the jobs' command lines share: options from a config file, overridden by flags, and the session."""

from __future__ import annotations

import argparse
import logging
import tomllib
from collections.abc import Callable
from dataclasses import fields
from pathlib import Path
from typing import TypeVar

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

Config = TypeVar("Config")


def options(kind: type[Config], argv: list[str] | None, about: str) -> Config:
    """A `kind` (a dataclass) from --config FILE (TOML) and a flag for each field; flags win; unknown names are an error."""
    parser = argparse.ArgumentParser(description=about)
    parser.add_argument("--config", help="a TOML file with any of the options below")
    for f in fields(kind):
        parser.add_argument("--" + f.name.replace("_", "-"), dest=f.name, type={"float": float, "int": int}.get(f.type, str))
    given = vars(parser.parse_args(argv))
    file = given.pop("config")
    held = tomllib.loads(Path(file).read_text()) if file else {}
    unknown = set(held) - {f.name for f in fields(kind)}
    if unknown:
        parser.error(f"{file}: unknown options {sorted(unknown)}")
    try:
        return kind(**(held | {k: v for k, v in given.items() if v is not None}))
    except TypeError as error:
        parser.error(str(error).replace(f"{kind.__name__}.__init__() ", ""))


def main(run: Callable[[SparkSession, Config], object], kind: type[Config], about: str, argv: list[str] | None = None) -> None:
    """The command line: the only place that creates and stops a session."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config = options(kind, argv, about)
    spark = SparkSession.builder.appName(about).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, config)
    finally:
        spark.stop()


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """`df`, and an observation that holds `rows` once it has been written."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
