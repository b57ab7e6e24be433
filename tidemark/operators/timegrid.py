"""Months: complete grids, gaps, bridges, islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def month_index(month: str | Column) -> Column:
    return F.year(month) * 12 + F.month(month)


def first_of_month_rows(df: DataFrame, key: str = "series_id", date: str = "observation_date", order: str = "position") -> DataFrame:
    """Dates cut to their month; of several rows of a month the last stays."""
    return df.groupBy(key, F.trunc(date, "MM").alias("month")).agg(F.max_by("value", F.struct(order, date)).alias("value"))


def complete_grid(df: DataFrame, key: str = "series_id") -> DataFrame:
    """Every month from each series' first to its last; missing months have a null value."""
    span = df.groupBy(key).agg(F.min("month").alias("a"), F.max("month").alias("b"))
    months = span.select(key, F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    return months.join(df, [key, "month"], "left")


def gap_runs(grid: DataFrame, key: str = "series_id") -> DataFrame:
    """(key, first_month, last_month, months) of each run of missing months."""
    return islands(grid.where(F.col("value").isNull()), key)


def islands(df: DataFrame, key: str = "series_id") -> DataFrame:
    """Runs of consecutive months."""
    n = F.row_number().over(Window.partitionBy(key).orderBy("month"))
    runs = df.withColumn("run", month_index("month") - n)
    return runs.groupBy(key, "run").agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.count("*").alias("months")).drop("run")


def bridged(grid: DataFrame, key: str = "series_id") -> DataFrame:
    """A single missing month between two known ones gets their mean, and is marked; longer gaps and ends stay."""
    w = Window.partitionBy(key).orderBy("month")
    before, after = F.lag("value").over(w), F.lead("value").over(w)
    filled = grid.withColumn("before", before).withColumn("after", after)
    single = F.col("value").isNull() & F.col("before").isNotNull() & F.col("after").isNotNull()
    return filled.withColumn("is_bridged", single).withColumn("value", F.when(single, (F.col("before") + F.col("after")) / 2).otherwise(F.col("value"))).drop("before", "after")


def strictly_monthly(df: DataFrame, key: str = "series_id") -> DataFrame:
    """Of each series: whether its months have neither doubles nor gaps."""
    span = F.max(month_index("month")) - F.min(month_index("month")) + 1
    n, distinct = F.count("*"), F.count_distinct("month")
    return df.groupBy(key).agg(n.alias("n"), distinct.alias("n_distinct"), span.alias("span"), ((n == distinct) & (distinct == span)).alias("is_strict"))


def latest_common_month(df: DataFrame, key: str = "series_id") -> DataFrame:
    """The last month that every series has."""
    return df.where(F.col("value").isNotNull()).groupBy(key).agg(F.max("month").alias("last")).agg(F.min("last").alias("latest_common_month"))


def refit_schedule(months: DataFrame, every: int, group: str = "schedule") -> DataFrame:
    """(group, month, is_refit): each `every`-th forecast date is a refit."""
    n = F.row_number().over(Window.partitionBy(group).orderBy("month")) - 1
    return months.withColumn("is_refit", n % every == 0)


def asserted_monthly(df: DataFrame, key: str = "series_id") -> DataFrame:
    """The rows, each of which must be of the month after the one before it of its key: what reads rows by their place may not
    meet a gap or a double."""
    before = F.lag("month").over(Window.partitionBy(key).orderBy("month"))
    why = F.concat(F.lit("months are not one after another: "), F.col("_before").cast("string"), F.lit(", "), F.col("month").cast("string"))
    ok = F.col("_before").isNull() | (F.add_months("_before", 1) == F.col("month"))
    return df.withColumn("_before", before).withColumn("month", F.when(ok, F.col("month")).otherwise(F.raise_error(why).cast("date"))).drop("_before")
