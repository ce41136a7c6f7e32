"""Reshaping of financial sheets: quarters, years, latest rows, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.schema import THAI_LABELS, TIME_LABEL, YEAR

#: Sheets are ordered by time, never by place.
TIME = ("fiscal", "quarter")


def quarters(sheets: DataFrame) -> DataFrame:
    return sheets.where(F.col("quarter") != YEAR)


def years(sheets: DataFrame) -> DataFrame:
    return sheets.where(F.col("quarter") == YEAR)


def quarterly(sheets: DataFrame, thai: bool = False) -> DataFrame:
    """Quarters with their time (2020Q1) and first day; a quarter out of 1 to 4 is an error."""
    df = quarters(sheets)
    start = F.make_date("fiscal", (F.col("quarter") - 1) * 3 + 1, F.lit(1))
    df = df.withColumn("time", F.concat(F.col("fiscal").cast("string"), F.lit("Q"), F.col("quarter").cast("string"))).withColumn("period_start", start)
    df = df.drop("fiscal", "quarter")
    return relabelled(df) if thai else df


def yearly(sheets: DataFrame, thai: bool = False) -> DataFrame:
    df = years(sheets).drop("quarter").withColumn("period_start", F.make_date("fiscal", F.lit(1), F.lit(1)))
    return relabelled(df) if thai else df


def relabelled(df: DataFrame) -> DataFrame:
    """Thai labels for the columns that have one."""
    return df.withColumnsRenamed({k: v for k, v in (THAI_LABELS | TIME_LABEL).items() if k in df.columns and k != "security_id"})


def by_time(key: str = "security_id") -> Window:
    return Window.partitionBy(key).orderBy(*TIME)


def latest(df: DataFrame, key: str = "security_id", columns: tuple[str, ...] | None = None) -> DataFrame:
    """The row of the latest time of each key: an aggregate, so that it combines before the shuffle."""
    names = columns or tuple(c for c in df.columns if c != key)
    return df.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(*TIME)).alias("r")).select(key, "r.*")


def tail(df: DataFrame, n: int, key: str = "security_id") -> DataFrame:
    """The latest n rows of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in TIME])
    return df.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= n).drop("_place")


def first_of(catalog: DataFrame, k: int, by: str = "sector") -> DataFrame:
    """The first k securities of each sector, in the order of the source."""
    w = Window.partitionBy(by).orderBy("ord")
    return catalog.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= k).drop("_place")


def rolling(function, column: str, n: int, key: str = "security_id") -> Column:
    """A function over the last n rows, null where fewer than n values are there."""
    w = by_time(key).rowsBetween(-(n - 1), 0)
    return F.when(F.count(column).over(w) == n, function(column).over(w))


def lagged(column: str, n: int, key: str = "security_id") -> Column:
    """The value n quarters ago, null unless just that quarter is there."""
    w = by_time(key)
    now = F.col("fiscal") * 4 + F.col("quarter")
    return F.when(F.lag(now, n).over(w) == now - n, F.lag(column, n).over(w))
