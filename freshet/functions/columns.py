"""Scalar expressions over columns: numbers, months, unit conversion, tables' shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ACRE_FOOT_M3 = 1233.48184
DAY_S = 86400.0


def lower_names(df: DataFrame) -> DataFrame:
    """Lower-case column names; names that differ only in case are an error."""
    names = [c.lower() for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"columns differ only in case: {sorted(df.columns)}")
    return df.toDF(*names)


def require(df: DataFrame, *names: str) -> DataFrame:
    """KeyError that names the missing columns."""
    missing = set(names) - set(df.columns)
    if missing:
        raise KeyError(f"missing columns: {sorted(missing)}")
    return df


def number(c: Column | str) -> Column:
    """Lenient number; bad text and NaN are null."""
    value = F.col(c).try_cast("double") if isinstance(c, str) else c.try_cast("double")
    return F.when(~F.isnan(value), value)


def whole_id(c: Column | str) -> Column:
    """Half-even rounding to a long."""
    return F.bround(number(c)).cast("long")


def days_in_month(d: Column | str) -> Column:
    return F.dayofmonth(F.last_day(d))


def month_seconds(d: Column | str) -> Column:
    return days_in_month(d) * F.lit(DAY_S)


def acft_month_to_cms(acft: Column | str, d: Column | str) -> Column:
    """H1: acre-feet a month as cubic metres a second."""
    return (F.col(acft) if isinstance(acft, str) else acft) * F.lit(ACRE_FOOT_M3) / month_seconds(d)


def local_runoff(coefficient: Column, area_km2: Column, seconds: Column) -> Column:
    """H3: metres a month over an area, as cubic metres a second."""
    return coefficient * area_km2 * F.lit(1.0e6) / seconds


def months(spark: SparkSession, start: str, end: str) -> DataFrame:
    """The month starts from start to end; a start within a month moves to the next one."""
    first = f"if(day(date'{start}') = 1, date'{start}', add_months(trunc(date'{start}', 'MM'), 1))"
    return spark.sql(f"select explode(if({first} > date'{end}', array(), sequence({first}, date'{end}', interval 1 month))) as date")


def clipped(c: Column | str, low: float = -1e20, high: float = 1e20) -> Column:
    """P12; NaN stays NaN."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(c), c).otherwise(F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def scientific(c: Column | str) -> Column:
    """Text like 1.234568e+04."""
    return F.format_string("%.6e", c)


def point_text(x: Column, y: Column) -> Column:
    """A point as well-known text."""
    return F.concat(F.lit("POINT ("), x.cast("string"), F.lit(" "), y.cast("string"), F.lit(")"))


def lookup(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, name: str) -> DataFrame:
    """Add `value` of the table's row for `key` as `name`; null where there is none."""
    side = table.select(F.col(table_key).alias("_key"), F.col(value).alias(name))
    return df.join(side, df[key] == side["_key"], "left").drop("_key")


def linspace(first: float, last: float, n: int) -> list[float]:
    """X9, CA2: n evenly spaced numbers; the last is exact."""
    step = (last - first) / max(n - 1, 1)
    return [first + i * step for i in range(n - 1)] + [last if n > 1 else first] * (n > 0)
