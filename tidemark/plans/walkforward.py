"""The walk forward through history as one set-oriented plan.

There is no loop over forecast dates: the raw rows are aggregated to months once, everything that depends
on time is a running window over each series, and what was known at a date is carried to it along one
line of time.  All dates, horizons and questions are rows of one frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import probability as pr
from ..operators import outcomes as oc
from ..operators import timegrid
from ..sources import tables

THRESHOLD = 250_000.0
HORIZONS = [1, 3, 6, 12]
LAG_DAYS = 45
STRENGTH = 10.0
KEYS = ["series_id", "composition", "horizon"]


def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, month, value, holds) on a complete grid: is the month's mean order price above the threshold?"""
    return oc.condition(timegrid.complete_grid(tables.order_prices(spark, sf_dir)), THRESHOLD)


def known_rates(grid: DataFrame, strength: float = STRENGTH) -> DataFrame:
    """(series_id, month, known_month, now, entry, stay): the chain each forecast date may use.

    Counts run up to each condition's month; a date takes those of the last month published by it.
    """
    counted = oc.states_of(grid)
    base = F.col("s") / F.col("n")
    rates = counted.select(
        "series_id",
        F.date_add("month", LAG_DAYS).alias("t"),
        F.lit(0).alias("kind"),
        F.struct(F.col("month").alias("known_month"), F.col("holds").alias("now"), pr.shrunk(F.col("entries"), F.col("n_off"), base, strength).alias("entry"), pr.shrunk(F.col("stays"), F.col("n_on"), base, strength).alias("stay")).alias("r"),
    )
    dates = grid.select("series_id", F.col("month").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast(rates.schema["r"].dataType).alias("r"))
    w = Window.partitionBy("series_id").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    line = rates.unionByName(dates).withColumn("known", F.last("r", ignorenulls=True).over(w))
    return line.where("kind = 1").where(F.col("known").isNotNull()).select("series_id", F.col("t").alias("month"), "known.*")


def forecasts(spark: SparkSession, sf_dir: str, horizons: list[int] | None = None) -> DataFrame:
    """One row per series, composition, horizon and forecast date: chain, climatology, their blend, what came, and how
    far the chain still is from its long run."""
    return forecasts_from(conditions(spark, sf_dir), horizons)


def forecasts_from(grid: DataFrame, horizons: list[int] | None = None, weight: float = 0.5, strength: float = STRENGTH) -> DataFrame:
    """The same from a grid of conditions; `weight` is the chain's in the blend."""
    found = oc.running_climatology(oc.outcomes(grid, horizons or HORIZONS), KEYS, LAG_DAYS)
    rows = found.where(F.col("climatology").isNotNull()).join(known_rates(grid, strength), ["series_id", "month"])
    gap = F.months_between("month", "known_month").cast("int")
    h, now, entry, stay = (F.col(c) for c in ("horizon", "now", "entry", "stay"))
    at = pr.chain_at(now, entry, stay, gap + h)
    within = pr.chain_within(pr.chain_at(now, entry, stay, gap), entry, stay, h)
    rows = rows.withColumn("chain", F.when(F.col("composition") == oc.AT, at).otherwise(within))
    return rows.select(
        *KEYS,
        F.col("month").alias("forecast_date"),
        pr.blend(F.col("chain"), F.col("climatology"), weight).alias("predicted"),
        F.col("climatology").alias("reference"),
        "chain",
        F.col("outcome").alias("realised"),
        "known_month",
        F.abs(at - entry / (1 - (stay - entry))).alias("distance"),
    )
