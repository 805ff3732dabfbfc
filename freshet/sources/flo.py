"""Monthly flow text files (S12): a line has station, year and twelve values, parted by white space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.scratch import cut


#: What a year (from 1600 on) and a value look like to an audit.
YEAR = r"^(1[6-9]|[2-9][0-9])[0-9]{2}$"
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def tokens(line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(line, r"[ \t\n\x0B\f\r]+", " ")), " ")


def state(t: Column) -> Column:
    """What a line's tokens make of it: blank, short (skipped), row, or bad: a row whose year or value isn't a plain number."""
    sound = t[1].rlike(YEAR) & F.forall(F.slice(t, 3, 12), lambda v: v.rlike(NUMBER))
    return F.when(F.array_join(t, "") == "", "blank").when(F.size(t) < 14, "short").when(sound, "row").otherwise("bad")


def parse(lines: DataFrame, *keep: str) -> DataFrame:
    """date, gage_id, acft from a table of text lines (`value`), after the columns `keep`.

    Lines of fewer than 14 tokens are skipped, further tokens ignored; a year or value that isn't a number fails the query.
    """
    held = lines.select(*keep, tokens(F.col("value")).alias("t")).where(F.size("t") >= 14)
    wide = held.select(*keep, F.col("t")[0].alias("gage_id"), F.col("t")[1].cast("int").alias("year"), F.posexplode(F.slice("t", 3, 12)).alias("month", "acft"))
    return wide.select(*keep, F.make_date("year", F.col("month") + 1, F.lit(1)).alias("date"), "gage_id", F.col("acft").cast("double").alias("acft"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The file's observations in order of date and gage (O1); ValueError when it has none.

    T11: every line is parsed here, whatever is used of it later: a year or value that isn't a number fails at once.
    """
    out = cut(parse(spark.read.text(path)), "flow-file")
    if out.isEmpty():
        raise ValueError(f"no flow rows in {path}")
    return out.orderBy("date", "gage_id")
