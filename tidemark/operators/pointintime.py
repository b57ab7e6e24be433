"""What was known when: publication lags, vintages, as-of joins, the check against looking ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

USABLE = 240


def published_by(observations: DataFrame, dates: DataFrame, lag_days: int | Column) -> DataFrame:
    """For each as_of the observations published by then: their month and the lag lie not after it."""
    lag = F.lit(lag_days) if isinstance(lag_days, int) else lag_days
    known = observations.withColumn("published", F.date_add("month", lag))
    return dates.join(known, F.col("published") <= F.col("as_of"))


def vintages(facts: DataFrame, dates: DataFrame, key: str, month: str, known: str, value: Column) -> DataFrame:
    """(as_of, series_id, month, value): each series as the facts known by as_of give it.

    Facts are first summed to (series, month, month of knowledge), so the join with the dates is over those.
    """
    parts = facts.groupBy(key, month, F.trunc(known, "MM").alias("known")).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    rows = parts.join(dates, F.col("known") < F.col("as_of")).groupBy("as_of", key, month).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return rows.select("as_of", F.col(key).alias("series_id"), F.col(month).alias("month"), (F.col("s") / F.nullif(F.col("n"), F.lit(0))).alias("value"))


def vintage_policy(coverage: DataFrame, usable: int = USABLE) -> DataFrame:
    """Adds `policy` to (series_id, as_of, is_revised, vintage_values): what the series is read from.

    A series that isn't revised is its latest state, cut by the publication lag; a revised one is its vintage
    where that has enough values, and else the latest state cut by the lag, the weaker choice.
    """
    policy = F.when(~F.col("is_revised"), "unrevised").when(F.coalesce("vintage_values", F.lit(0)) >= usable, "vintage").otherwise("publication_lag_fallback")
    return coverage.withColumn("policy", policy)


def policy_counts(policies: DataFrame, names: DataFrame) -> DataFrame:
    """Every policy's number, zero where it has none."""
    return names.join(policies.groupBy("policy").count(), "policy", "left").select("policy", F.coalesce("count", F.lit(0)).alias("n"))


def looks_ahead(panel: DataFrame) -> DataFrame:
    """(as_of, series_id, last_month) of panels that hold a month not before their date: none in a sound one."""
    return panel.groupBy("as_of", "series_id").agg(F.max("month").alias("last_month")).where(F.col("last_month") >= F.col("as_of"))


def latest_before(dates: DataFrame, events: DataFrame, group: str, date: str = "month", event: str = "refit") -> DataFrame:
    """Adds the latest event not after each date of a group.

    Both are put into one line of time and the last event is carried on: a sort for each group, no pairs.
    """
    w = Window.partitionBy(group).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    line = dates.select(group, F.col(date).alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("date").alias("e")).unionByName(events.select(group, F.col(event).alias("t"), F.lit(0).alias("kind"), F.col(event).alias("e")))
    return line.withColumn(event, F.last("e", ignorenulls=True).over(w)).where("kind = 1").select(group, F.col("t").alias(date), event)


def published_with_announcements(months: DataFrame, announcements: DataFrame, lag_days: int) -> DataFrame:
    """Adds `published`: the lag's date, or the latest announcement of a turning point up to the month if that is later.

    `announcements` (turning_point, announced) is a small dimension of fixed events, broadcast below `SMALL` rows.
    """
    told = months.join(small(announcements), F.col("turning_point") <= F.col("month"), "left").groupBy("series_id", "month").agg(F.max("announced").alias("announced"))
    return told.withColumn("published", F.greatest(F.date_add("month", lag_days), "announced"))


SMALL = 10_000


def small(dimension: DataFrame) -> DataFrame:
    """Marks a dimension for broadcast after counting it: larger ones are left to the planner."""
    return F.broadcast(dimension) if dimension.limit(SMALL + 1).count() <= SMALL else dimension


def revisions(then: DataFrame, now: DataFrame) -> DataFrame:
    """Of each series: months in both states, moved ones, median and largest size of the change."""
    both = then.select("series_id", "month", F.col("value").alias("a")).join(now.select("series_id", "month", F.col("value").alias("b")), ["series_id", "month"])
    change = F.abs(F.col("b") - F.col("a"))
    return both.groupBy("series_id").agg(F.count("*").alias("months"), F.sum((change > 1e-9).cast("long")).alias("moved"), F.percentile(change, F.lit(0.5)).alias("median_change"), F.max(change).alias("largest_change"))


def series_audit(df: DataFrame) -> DataFrame:
    return df.groupBy("series_id").agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.count("*").alias("months"), F.sum(F.col("value").isNull().cast("long")).alias("missing"))


def threshold_flips(then: DataFrame, now: DataFrame, threshold: float) -> DataFrame:
    """Of each series: months whose condition differs between the two states."""
    both = then.select("series_id", "month", F.col("value").alias("a")).join(now.select("series_id", "month", F.col("value").alias("b")), ["series_id", "month"])
    return both.groupBy("series_id").agg(F.count("*").alias("months"), F.sum(((F.col("a") > threshold) != (F.col("b") > threshold)).cast("long")).alias("flips"))


def fallback_dates(policies: DataFrame) -> DataFrame:
    """Dates at which some series was read by the weaker choice."""
    return policies.where("policy = 'publication_lag_fallback'").select("as_of").distinct()


def honest_start(policies: DataFrame) -> DataFrame:
    """(first_candidate, last_fallback, honest_start): the month after the last date that needed the weaker choice."""
    last = F.max(F.when(F.col("policy") == "publication_lag_fallback", F.col("as_of")))
    return policies.agg(F.min("as_of").alias("first_candidate"), last.alias("last_fallback"), F.coalesce(F.add_months(last, 1), F.min("as_of")).alias("honest_start"))
