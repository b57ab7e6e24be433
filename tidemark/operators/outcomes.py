"""Conditions, outcomes at and within a horizon, and what was known of their frequency."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AT, ANY = "at_horizon", "within_horizon"


def condition(df: DataFrame, threshold: float, above: bool = True) -> DataFrame:
    """Adds `holds`: 1 or 0, null where the value is missing; the threshold itself doesn't hold."""
    c = F.col("value") > threshold if above else F.col("value") < threshold
    return df.withColumn("holds", c.cast("double"))


def outcomes(grid: DataFrame, horizons: list[int], key: str = "series_id", column: str = "holds") -> DataFrame:
    """(key, month, composition, horizon, outcome) for every horizon: the condition `horizon` months on, and
    whether it holds in any of the months after this one up to then.  Null unless all of them are known.

    A few horizons come from one sort: the frames differ, the partitioning doesn't.  Many are rows of their own,
    each joined with the month it ends in: running counts say whether all months between are known.
    """
    if len(horizons) > 12:
        return _joined_outcomes(grid, horizons, key, column)
    w = Window.partitionBy(key).orderBy("month")
    parts = []
    for h in horizons:
        ahead = w.rowsBetween(1, h)
        parts += [F.struct(F.lit(AT).alias("composition"), F.lit(h).alias("horizon"), F.lead(column, h).over(w).alias("outcome"))]
        parts += [F.struct(F.lit(ANY).alias("composition"), F.lit(h).alias("horizon"), F.when(F.count(column).over(ahead) == h, F.max(column).over(ahead)).alias("outcome"))]
    rows = grid.select(key, "month", F.array(*parts).alias("all"))
    return rows.select(key, "month", F.explode("all").alias("o")).select(key, "month", "o.composition", "o.horizon", "o.outcome")


def _joined_outcomes(grid: DataFrame, horizons: list[int], key: str, column: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy("month")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = grid.select(key, "month", F.col(column).alias("holds"), F.row_number().over(w).alias("i"), F.count(column).over(upto).alias("c"), F.coalesce(F.sum(column).over(upto), F.lit(0.0)).alias("s"))
    asked = rows.select(key, "month", "i", "c", "s", F.explode(F.array(*map(F.lit, horizons))).alias("horizon")).withColumn("end", F.col("i") + F.col("horizon"))
    ends = rows.select(key, F.col("i").alias("end"), F.col("holds").alias("end_holds"), F.col("c").alias("end_c"), F.col("s").alias("end_s"))
    both = asked.join(ends, [key, "end"], "left")
    any_ = F.when(F.col("end_c") - F.col("c") == F.col("horizon"), (F.col("end_s") > F.col("s")).cast("double"))
    parts = F.array(F.struct(F.lit(AT).alias("composition"), F.col("end_holds").alias("outcome")), F.struct(F.lit(ANY).alias("composition"), any_.alias("outcome")))
    return both.select(key, "month", "horizon", F.explode(parts).alias("o")).select(key, "month", "o.composition", "horizon", "o.outcome")


def extreme_within(grid: DataFrame, horizon: int, lowest: bool = False, key: str = "series_id") -> DataFrame:
    """Adds the highest (or lowest) value of the next `horizon` months; null unless all are known."""
    ahead = Window.partitionBy(key).orderBy("month").rowsBetween(1, horizon)
    found = F.min("value").over(ahead) if lowest else F.max("value").over(ahead)
    return grid.withColumn("extreme", F.when(F.count("value").over(ahead) == horizon, found))


def base_rates(found: DataFrame, keys: list[str]) -> DataFrame:
    return found.groupBy(*keys).agg(F.count("outcome").alias("resolved"), F.sum("outcome").alias("positive"), F.avg("outcome").alias("base_rate"))


def published_on(lag_days: int) -> Column:
    """When an outcome is known: the lag after the first day of its last month."""
    return F.date_add(F.add_months("month", F.col("horizon")), lag_days)


def running_climatology(found: DataFrame, keys: list[str], lag_days: int) -> DataFrame:
    """Adds `climatology`: at each month the mean of all outcomes published by its first day.

    Outcomes (by publication) and months stand in one line of time for each key; a running sum along it
    replaces the join of every month with every outcome before it.
    """
    w = Window.partitionBy(*keys).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    told = found.where(F.col("outcome").isNotNull()).select(*keys, published_on(lag_days).alias("t"), F.lit(0).alias("kind"), F.col("outcome").alias("y"), F.lit(None).cast("double").alias("outcome"))
    asked = found.select(*keys, F.col("month").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("double").alias("y"), "outcome")
    line = told.unionByName(asked).withColumn("n", F.count("y").over(w)).withColumn("s", F.sum("y").over(w))
    return line.where("kind = 1").select(*keys, F.col("t").alias("month"), "outcome", (F.col("s") / F.nullif(F.col("n"), F.lit(0))).alias("climatology"))


def sample_climatology(found: DataFrame, keys: list[str], lag_days: int, months: int) -> DataFrame:
    """Adds `sample_climatology`: as above, of forecast months no more than `months` before, as the
    difference of two running sums: all published by now, less those of months before the sample."""
    start = F.add_months("month", -months)
    told = found.where(F.col("outcome").isNotNull())
    asked = found.select(*keys, "month", "outcome", start.alias("start"))

    def running(events: DataFrame, at: str, first: int) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
        dates = asked.select(*keys, F.col(at).alias("t"), F.lit(first).alias("kind"), F.lit(None).cast("double").alias("y"), "month")
        line = events.unionByName(dates).withColumn("n", F.count("y").over(w)).withColumn("s", F.coalesce(F.sum("y").over(w), F.lit(0.0)))
        return line.where(F.col("kind") == first).select(*keys, "month", "n", "s")

    none = F.lit(None).cast("date").alias("month")
    known = running(told.select(*keys, published_on(lag_days).alias("t"), F.lit(0).alias("kind"), F.col("outcome").alias("y"), none), "month", 1)
    before = running(told.select(*keys, F.col("month").alias("t"), F.lit(1).alias("kind"), F.col("outcome").alias("y"), none), "start", 0)
    both = known.join(before.select(*keys, "month", F.col("n").alias("n0"), F.col("s").alias("s0")), [*keys, "month"]).join(asked, [*keys, "month"])
    n = F.col("n") - F.least("n0", "n")
    return both.select(*keys, "month", "outcome", F.when(n > 0, (F.col("s") - F.when(F.col("n0") <= F.col("n"), F.col("s0")).otherwise(F.col("s"))) / n).alias("sample_climatology"))


def states_of(conditions: DataFrame, key: str = "series_id") -> DataFrame:
    """Adds the condition of the row before and the counts up to each month: of months, of months that hold,
    and of entries and stays after months that don't and do."""
    w = Window.partitionBy(key).orderBy("month")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = conditions.where(F.col("holds").isNotNull()).withColumn("before", F.lag("holds").over(w))
    off, on = F.col("before") == 0, F.col("before") == 1
    sums = {
        "n": F.lit(1.0),
        "s": F.col("holds"),
        "n_off": off.cast("double"),
        "n_on": on.cast("double"),
        "entries": F.when(off, F.col("holds")),
        "stays": F.when(on, F.col("holds")),
    }
    return reduce(lambda df, c: df.withColumn(c[0], F.coalesce(F.sum(c[1]).over(upto), F.lit(0.0))), sums.items(), rows)
