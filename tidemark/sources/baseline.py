"""Run records: forecasts and the run's identity, both or neither, never over another."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IDENTITY = "name string, forecasts long, dates long, first_date date, last_date date, configuration_hash string, seed long"


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def capture(forecasts: DataFrame, path: str, name: str, configuration_hash: str, seed: int, force: bool = False) -> None:
    """Writes ``<path>/<name>``; refuses a name that is taken unless forced, and leaves nothing behind on failure.

    A new record is written beside an old one, which goes only when the new one is whole.
    """
    spark = forecasts.sparkSession
    store, place = _files(spark, f"{path}/{name}")
    if store.exists(place) and not force:
        raise FileExistsError(f"{path}/{name}")
    _, beside = _files(spark, new := f"{path}/.new-{uuid.uuid4().hex}")
    try:
        forecasts.write.parquet(f"{new}/forecasts")
        held = spark.read.parquet(f"{new}/forecasts")
        identity = held.agg(F.count("*").alias("forecasts"), F.count_distinct("forecast_date").alias("dates"), F.min("forecast_date").alias("first_date"), F.max("forecast_date").alias("last_date"))
        identity.select(F.lit(name).alias("name"), "*", F.lit(configuration_hash).alias("configuration_hash"), F.lit(seed).cast("long").alias("seed")).coalesce(1).write.json(f"{new}/identity")
    except Exception:
        store.delete(beside, True)
        raise
    store.delete(place, True)
    if not store.rename(beside, place):
        raise OSError(f"{new} could not be renamed to {path}/{name}")


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}/forecasts")


def listed(spark: SparkSession, path: str) -> DataFrame:
    """The identities of all runs."""
    return spark.read.schema(IDENTITY).json(f"{path}/*/identity")


def structure_differences(run: DataFrame, approved: DataFrame, name: str = "name") -> DataFrame:
    """(name, approved, found) where the structure (name, states) of a run isn't the one that was approved, or either has a part
    that the other lacks."""
    both = approved.select(name, F.col("states").alias("approved")).join(run.select(name, F.col("states").alias("found")), name, "full_outer")
    return both.where(~F.col("approved").eqNullSafe(F.col("found")))


def submission(rows: DataFrame, path: str, rule: str = "", approved: bool = True, differences: DataFrame | None = None) -> None:
    """One CSV file sorted by indicator and horizon, probabilities at four places, half to even, and beside it a
    manifest of its rows, horizons and rule.  Nothing is written that nobody has approved, or whose structure differs from
    what was.

    A submission has a row for each indicator and horizon, so one file holds it.
    """
    if not approved:
        raise PermissionError("the submission isn't approved")
    if differences is not None and (found := differences.limit(5).collect()):
        raise PermissionError("the run has another structure than the approved one: " + ", ".join(f"{r[0]} has {r.found} states for {r.approved}" for r in found))
    manifest = rows.agg(F.lit(rule).alias("rule"), F.count("*").alias("rows"), F.count_distinct("indicator").alias("indicators"), F.array_sort(F.collect_set("horizon")).alias("horizons"))
    manifest.coalesce(1).write.json(f"{path}-manifest")
    rounded = rows.select(*(F.bround(c, 4).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes))
    rounded.orderBy("indicator", "horizon").coalesce(1).write.option("header", True).csv(path)
