"""Series of different frequencies together: quarters as the months that know them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quarter_of(date: str | Column) -> Column:
    return F.trunc(date, "quarter")


def falls(quarters: DataFrame, lag_days: int) -> DataFrame:
    """(series_id, quarter, fell, told, known_share) of (series_id, quarter, value): whether a quarter's value is below the one
    before (null where that is missing), when it is told, and the share of falls among all quarters up to it."""
    w = Window.partitionBy("series_id").orderBy("quarter")
    before = F.lag(F.struct("quarter", "value")).over(w)
    rows = quarters.withColumn("_b", before)
    fell = F.when(F.col("_b.quarter") == F.add_months("quarter", -3), (F.col("value") < F.col("_b.value")).cast("double"))
    rows = rows.select("series_id", "quarter", fell.alias("fell"), F.date_add(F.add_months("quarter", 3), lag_days).alias("told"))
    return rows.withColumn("known_share", F.avg("fell").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def carried(dates: DataFrame, events: DataFrame, told: str, fields: list[str]) -> DataFrame:
    """Of each (series_id, month) the fields of the event last told by then: dates and events are put into one line of time, so
    no date meets every event before it."""
    held = F.struct(*fields)
    kind = events.select(held.alias("e")).schema["e"].dataType
    line = events.select("series_id", F.col(told).alias("t"), F.lit(0).alias("kind"), held.alias("e")).unionByName(dates.select("series_id", F.col("month").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast(kind).alias("e")))
    w = Window.partitionBy("series_id").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return line.withColumn("_known", F.last("e", ignorenulls=True).over(w)).where("kind = 1").select("series_id", F.col("t").alias("month"), *(F.col(f"_known.{f}").alias(f) for f in fields))
