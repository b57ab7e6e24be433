"""Transforms of complete monthly series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVEL, LOG_CHANGE, PERCENT_CHANGE = "level", "year_over_year_log_change", "year_over_year_percent_change"


def transformed(grid: DataFrame, transform: str | Column, key: str = "series_id", lag: int = 12) -> DataFrame:
    """Adds `transformed`: the level, or the change on the value `lag` months before (a complete grid is needed).

    A value that isn't positive has no logarithm, a zero base no percentage: both are null.
    """
    before = F.lag("value", lag).over(Window.partitionBy(key).orderBy("month"))
    kind = F.lit(transform) if isinstance(transform, str) else transform
    rows = grid.withColumn("before", before)
    log = F.when((F.col("value") > 0) & (F.col("before") > 0), F.ln("value") - F.ln("before"))
    percent = 100 * (F.col("value") / F.nullif(F.col("before"), F.lit(0.0)) - 1)
    unknown = F.raise_error(F.concat(F.lit("unknown transform: "), kind)).cast("double")
    value = F.when(kind == LEVEL, F.col("value").cast("double")).when(kind == LOG_CHANGE, log).when(kind == PERCENT_CHANGE, percent).otherwise(unknown)
    return rows.withColumn("transformed", value).drop("before")


def difference(df: DataFrame, minuend: str, subtrahend: str) -> DataFrame:
    """The months both series have, and the first less the second."""
    a = df.where(F.col("series_id") == minuend).select("month", F.col("value").alias("a"))
    b = df.where(F.col("series_id") == subtrahend).select("month", F.col("value").alias("b"))
    return a.join(b, "month").select(F.lit(f"{minuend}-{subtrahend}").alias("series_id"), "month", (F.col("a") - F.col("b")).alias("value"))


def expanding_scores(df: DataFrame, column: str = "value", key: str | list[str] = "series_id", least: int = 36) -> DataFrame:
    """Adds `z`: the value standardised by all up to its month; null before `least` values or without spread."""
    w = Window.partitionBy(key).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    n, mean, spread = F.count(column).over(w), F.avg(column).over(w), F.stddev_samp(column).over(w)
    return df.withColumn("z", F.when((n >= least) & (spread > 0), (F.col(column) - mean) / spread))


def observation_matrix(df: DataFrame, kinds: dict[str, str], least: int = 36, lag: int = 12) -> DataFrame:
    """(month, one column for each series): transformed, standardised, months where all are known.

    `df` holds complete grids; one pivot aligns them.
    """
    kind = reduce(lambda c, s: c.when(F.col("series_id") == s[0], s[1]), kinds.items(), F.when(F.lit(False), ""))
    z = expanding_scores(transformed(df.where(F.col("series_id").isin(*kinds)), kind, lag=lag), "transformed", least=least)
    return z.groupBy("month").pivot("series_id", list(kinds)).agg(F.first("z")).na.drop()


def as_percent(change: Column) -> Column:
    """A log change as percent a year."""
    return 100 * (F.exp(change) - 1)
