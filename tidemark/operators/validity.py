"""Validity intervals: which value of a series' month stood from when to when.

A change log says what became known when.  One windowed pass over it gives every version its interval, and a version is
read as of any number of dates at once by one join of dates with intervals, on the series.  The vintage policy says
for each series and date which source the panel is read from, so panel and policy are one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import pointintime

OPEN = "9999-12-31"


def running(deltas: DataFrame, keys: list[str], known: str, sums: list[str]) -> DataFrame:
    """(keys, known, sums): what had been added up by each time something was added."""
    upto = Window.partitionBy(*keys).orderBy(known).rowsBetween(Window.unboundedPreceding, 0)
    each = deltas.groupBy(*keys, known).agg(*(F.sum(c).alias(c) for c in sums))
    return each.select(*keys, known, *(F.sum(c).over(upto).alias(c) for c in sums))


def intervals(log: DataFrame, keys: list[str], known: str = "vintage_date", value: str = "value") -> DataFrame:
    """(keys, value, known_from, known_to) of a log with a row for each change: a version stands until the next one is
    known, the last one without an end.  A row that repeats the version before it is no change."""
    w = Window.partitionBy(*keys).orderBy(known)
    changes = log.withColumn("_before", F.lag(F.struct(value)).over(w)).where(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(F.struct(value)))
    return changes.select(*keys, value, F.col(known).alias("known_from"), F.coalesce(F.lead(known).over(w), F.lit(OPEN).cast("date")).alias("known_to"))


def standing(date: Column, lead_months: int = 0) -> Column:
    """Whether a version stands at a date; `lead_months` reads that much later, a leak for audits to find."""
    at = F.add_months(date, lead_months) if lead_months else date
    return (F.col("known_from") <= at) & (at < F.col("known_to"))


def as_of(versions: DataFrame, wanted: DataFrame, lead_months: int = 0) -> DataFrame:
    """(as_of, series_id, month, value): each series as it stood at each wanted (as_of, series_id)."""
    return versions.join(wanted, "series_id").where(standing(F.col("as_of"), lead_months)).select("as_of", "series_id", "month", "value")


def policies(versions: DataFrame, wanted: DataFrame, revised: DataFrame, usable: int) -> DataFrame:
    """(as_of, series_id, is_revised, vintage_values, policy) of each wanted pair; `revised` (series_id, is_revised) is
    what the registry says."""
    covered = as_of(versions, wanted).groupBy("as_of", "series_id").agg(F.count("value").alias("vintage_values"))
    rows = wanted.join(F.broadcast(revised), "series_id").join(covered, ["as_of", "series_id"], "left")  # a row for each series of the registry
    return pointintime.vintage_policy(rows.withColumn("vintage_values", F.coalesce("vintage_values", F.lit(0))), usable)


def panel_by_policy(versions: DataFrame, latest: DataFrame, chosen: DataFrame, lag_days: int, lead_months: int = 0) -> DataFrame:
    """(as_of, series_id, month, value, policy): of each (as_of, series_id) in `chosen` the versions that stood then, or where
    the policy says so the latest state (series_id, month, value) cut by the publication lag.

    Sources are put under one schema first, so one join serves all policies and dates.
    """
    told = versions.select("series_id", "month", "value", "known_from", "known_to").withColumn("source", F.lit("vintage"))
    final = latest.select("series_id", "month", "value", F.date_add("month", lag_days).alias("known_from"), F.lit(OPEN).cast("date").alias("known_to")).withColumn("source", F.lit("latest"))
    source = F.when(F.col("policy") == "vintage", "vintage").otherwise("latest")
    wanted = chosen.select("as_of", "series_id", "policy", source.alias("source"))
    at = F.when(F.col("source") == "vintage", F.add_months("as_of", lead_months)).otherwise(F.col("as_of")) if lead_months else F.col("as_of")
    rows = told.unionByName(final).join(wanted, ["series_id", "source"]).where((F.col("known_from") <= at) & (at < F.col("known_to")))
    return rows.select("as_of", "series_id", "month", "value", "policy")
