"""Parquet tables, and monthly series made of them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def month_of(ts: str | Column) -> Column:
    return F.trunc(ts, "MM").cast("date")


def month_at(spark: SparkSession, sf_dir: str, months: int) -> date:
    """The month so many after the first of the orders: what a query dates by the data's own calendar."""
    return table(spark, sf_dir, "orders").agg(F.add_months(F.trunc(F.min("o_orderdate"), "MM"), months)).first()[0]


def monthly(df: DataFrame, ts: str, value: Column, series_id: Column) -> DataFrame:
    """(series_id, month, value): one aggregate over the raw rows, the only step that sees them all.
    It is written once; everything after it reads a row for each series and month."""
    return stored(df.groupBy(series_id.alias("series_id"), month_of(ts).alias("month")).agg(value.cast("double").alias("value")), "months")


def order_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean order price by priority and month; the last month of the table is left out unless its last day is there, as it
    may be cut."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series_id"), month_of("o_orderdate").alias("month"))
    months = stored(orders.agg(F.avg("o_totalprice").cast("double").alias("value"), F.max(F.col("o_orderdate").cast("date")).alias("last")), "months")
    last = months.agg(F.max("last").alias("last")).select(F.when(F.col("last") == F.last_day("last"), F.add_months("last", 1)).otherwise(F.col("last")).alias("last"))
    cut = last.select(F.trunc("last", "MM").cast("date")).first()[0]  # of the stored months, not of the raw rows
    return months.where(F.col("month") < F.lit(cut)).select("series_id", "month", "value")


def line_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three series of the shipped lines by month: their number (growth), mean price (inflation), mean discount (rates)."""
    lines = table(spark, sf_dir, "lineitem").groupBy(month_of("l_shipdate").alias("month")).agg(
        F.count("*").cast("double").alias("growth"), F.avg("l_extendedprice").alias("inflation"), F.avg("l_discount").alias("rates")
    )
    return stored(lines, "months").unpivot("month", ["growth", "inflation", "rates"], "series_id", "value").select("series_id", "month", "value")


def panel_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(panel, series_id, month, value): the same three series for each kind of return, a panel of its own."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("panel"), month_of("l_shipdate").alias("month")).agg(
        F.count("*").cast("double").alias("growth"), F.avg("l_extendedprice").alias("inflation"), F.avg("l_discount").alias("rates")
    )
    return stored(lines, "months").unpivot(["panel", "month"], ["growth", "inflation", "rates"], "series_id", "value").select("panel", "series_id", "month", "value")
