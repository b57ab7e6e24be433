"""Comparing runs: field by field in bands, keys split three ways, look-ahead audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = 1e-9


def long_form(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    return df.select(*keys, *(F.col(f).cast("double").alias(f) for f in fields)).unpivot(keys, fields, "field", "value")


def banded(before: DataFrame, after: DataFrame, keys: list[str], fields: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """(keys, field, before, after, band): IDENTICAL, NUMERICAL (within the tolerance), MOVED, ADDED or REMOVED."""
    a = long_form(before, keys, fields).withColumnRenamed("value", "before").withColumn("in_a", F.lit(True))
    b = long_form(after, keys, fields).withColumnRenamed("value", "after").withColumn("in_b", F.lit(True))
    x, y = F.col("before"), F.col("after")
    band = (
        F.when(F.col("in_a").isNull(), "ADDED")
        .when(F.col("in_b").isNull(), "REMOVED")
        .when(x.eqNullSafe(y), "IDENTICAL")
        .when(F.abs(x - y) <= tolerance, "NUMERICAL")
        .otherwise("MOVED")
    )
    return a.join(b, [*keys, "field"], "full_outer").withColumn("band", band).drop("in_a", "in_b")


def key_split(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(side, n): keys in both, only in the first, only in the second."""
    a, b = a.select(*keys).distinct().withColumn("in_a", F.lit(True)), b.select(*keys).distinct().withColumn("in_b", F.lit(True))
    side = F.when(F.col("in_b").isNull(), "only_first").when(F.col("in_a").isNull(), "only_second").otherwise("both")
    return a.join(b, keys, "full_outer").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


def differing(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """The keys whose fields aren't exactly equal, or that one side lacks."""
    left, right = a.select(*keys, F.struct(*fields).alias("a")), b.select(*keys, F.struct(*fields).alias("b"))
    return left.join(right, keys, "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))


def perturbed(df: DataFrame, unpublished: Column, value: str = "value") -> DataFrame:
    """Changes every value that isn't published: a run cut off there must not notice."""
    return df.withColumn(value, F.when(unpublished, F.col(value) * 1.7 + 11).otherwise(F.col(value)))


def checks(*expectations: tuple[str, DataFrame]) -> DataFrame:
    """(requirement, passed, offending) for frames that should be empty."""
    parts = [df.agg(F.count("*").alias("offending")).select(F.lit(name).alias("requirement"), (F.col("offending") == 0).alias("passed"), "offending") for name, df in expectations]
    return reduce(DataFrame.unionByName, parts)


def complete_join(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(joined, first_rows, second_rows, unequal, complete): two runs must join one to one with equal fields."""
    left, right = a.select(*keys, F.struct(*fields).alias("_a")), b.select(*keys, F.struct(*fields).alias("_b"))
    both = left.join(right, keys).agg(F.count("*").alias("joined"), F.sum((~F.col("_a").eqNullSafe(F.col("_b"))).cast("long")).alias("unequal"))
    sizes = a.agg(F.count("*").alias("first_rows")).crossJoin(b.agg(F.count("*").alias("second_rows")))  # one row each
    ok = (F.col("joined") == F.col("first_rows")) & (F.col("joined") == F.col("second_rows")) & (F.coalesce("unequal", F.lit(0)) == 0)
    return both.crossJoin(sizes).select("joined", "first_rows", "second_rows", "unequal", ok.alias("complete"))


def in_order(found: DataFrame, key: str, *then: str) -> DataFrame:
    """Adds `place` of each key's differences: those of one run alone first, unquantifiable ones next, then by size."""
    size = F.abs(F.round(F.col("after") - F.col("before"), 6))
    alone = F.col("band").isin("ADDED", "REMOVED")
    w = Window.partitionBy(key).orderBy(F.desc(alone), F.desc(size.isNull()), F.desc(size), *then)
    return found.withColumn("place", F.row_number().over(w))


def sets_equal(name: str, a: DataFrame, b: DataFrame) -> DataFrame:
    """(pair, equal): whether neither set has something the other lacks."""
    only = a.join(b, a.columns, "left_anti").unionByName(b.join(a, a.columns, "left_anti"))
    return only.agg(F.count("*").alias("n")).select(F.lit(name).alias("pair"), (F.col("n") == 0).alias("equal"))
