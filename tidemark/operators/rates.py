"""Rates of a condition in each hidden state, weighted by the chance of being in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import probability as pr


def conditional_rates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, state, occupancy, entry, persistence, weight) from rows with `holds`, `before` and `weights` (one
    for each state): how often it holds, holds after a month in which it didn't, and after one in which it did."""
    each = rows.select(*keys, "holds", "before", F.posexplode("weights").alias("state", "w"))
    w, y, off, on = F.col("w"), F.col("holds"), F.col("before") == 0, F.col("before") == 1

    def rate(where):
        return F.sum(F.when(where, w * y)) / F.nullif(F.sum(F.when(where, w)), F.lit(0.0))

    return each.groupBy(*keys, "state").agg((F.sum(w * y) / F.nullif(F.sum(w), F.lit(0.0))).alias("occupancy"), rate(off).alias("entry"), rate(on).alias("persistence"), F.sum(w).alias("weight"))


def exact_sum(x: Column) -> Column:
    """A sum of chances (or of anything under 10^18) that comes out alike in whatever order its rows arrive: each is
    taken to twenty places, where adding is exact."""
    return F.sum(x.cast("decimal(38,20)")).cast("double")


def shrunk_rates(rows: DataFrame, keys: list[str], strength: float = 10.0) -> DataFrame:
    """(keys, occupancy, entry, stay, counts), arrays over the states: the rates of a condition in each state, drawn
    towards those of all states.

    `rows` has `month`, `holds` and `weights` (the chance of each state, filtered: nothing later is known).  The first
    month has no month before it and counts for the occupancy alone.
    """
    return drawn_rates(state_sums(rows, keys), keys, F.lit(strength))


def state_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, state, ...): weighted counts in each state, and the rates of all states together."""
    w = Window.partitionBy(*keys).orderBy("month")
    each = rows.withColumn("before", F.lag("holds").over(w)).select(*keys, "month", "holds", "before", F.posexplode("weights").alias("state", "w"))
    y, off, on = F.col("holds"), F.col("before") == 0, F.col("before") == 1
    pool = rows.withColumn("before", F.lag("holds").over(w)).groupBy(*keys).agg(
        F.avg(y).alias("pool"), F.coalesce(F.avg(F.when(off, y)), F.lit(0.0)).alias("pool_entry"), F.coalesce(F.avg(F.when(on, y)), F.avg(y)).alias("pool_stay")
    )
    total = lambda c: F.coalesce(exact_sum(c), F.lit(0.0))
    return each.groupBy(*keys, "state").agg(
        total(F.col("w")).alias("n"), total(F.col("w") * y).alias("s"),
        total(F.when(off, F.col("w"))).alias("n_off"), total(F.when(off, F.col("w") * y)).alias("s_off"),
        total(F.when(on, F.col("w"))).alias("n_on"), total(F.when(on, F.col("w") * y)).alias("s_on"),
    ).join(pool, keys)


def drawn_rates(sums: DataFrame, keys: list[str], strength: Column) -> DataFrame:
    """The rates from counts, drawn towards the pooled ones by `strength`, which may be one of the keys."""
    one = F.struct(
        "state",
        pr.shrunk(F.col("s"), F.col("n"), F.col("pool"), strength).alias("occupancy"),
        pr.shrunk(F.col("s_off"), F.col("n_off"), F.col("pool_entry"), strength).alias("entry"),
        pr.shrunk(F.col("s_on"), F.col("n_on"), F.col("pool_stay"), strength).alias("stay"),
        F.col("n").alias("counts"),
    )
    lists = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("all"))
    return lists.select(*keys, *(F.col(f"all.{c}").alias(c) for c in ("occupancy", "entry", "stay", "counts")))
