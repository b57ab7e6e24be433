"""Copy-on-write forks of the bitemporal store, addressed by content.

A store is objects and manifests.  An object is the rows of one block of a series (a year of vintages, or of the latest
state) under the digest of those rows; a manifest names the blocks of one state of the store and their digests.  A
fork that changes some values writes only the blocks that hold them and a manifest; all others are shared, so
a fork of a large store costs what it changes.  Objects are written before the manifest that names them, and never
changed: a write that failed leaves nothing but objects that no manifest names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import OBSERVATIONS

FIELDS = [f.name for f in OBSERVATIONS if f.name != "series_id"]
OBJECT = "digest string, rows array<struct<vintage_date: date, observation_date: date, value: double>>, shard string"
MANIFEST = "series_id string, block string, digest string, n long"


def block() -> Column:
    """The block of an observation: the year it became known, or for the latest state its own year."""
    return F.when(F.col("vintage_date").isNotNull(), F.concat(F.lit("vintages/"), F.year("vintage_date"))).otherwise(F.concat(F.lit("latest/"), F.year("observation_date")))


def sealed(observations: DataFrame) -> DataFrame:
    """(series_id, block, digest, n, rows): each block as one object; its digest doesn't depend on the order of rows."""
    rows = observations.groupBy("series_id", block().alias("block")).agg(F.sort_array(F.collect_list(F.struct(*FIELDS))).alias("rows"))
    return rows.select("series_id", "block", F.sha2(F.to_json("rows"), 256).alias("digest"), F.size("rows").cast("long").alias("n"), "rows")


def objects(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(OBJECT).parquet(f"{root}/objects")


def manifest(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifests/{name}")


def _put(found: DataFrame, root: str, held: DataFrame | None) -> None:
    """Adds the objects that `held` lacks."""
    new = found.dropDuplicates(["digest"])
    if held is not None:
        new = new.join(held.select("digest"), "digest", "left_anti")
    new.select("digest", "rows", F.substring("digest", 1, 2).alias("shard")).write.mode("append").partitionBy("shard").parquet(f"{root}/objects")


def create(observations: DataFrame, root: str, name: str = "main") -> None:
    """A new store with one state."""
    found = sealed(observations)
    _put(found, root, None)
    found.select("series_id", "block", "digest", "n").write.parquet(f"{root}/manifests/{name}")


def opened(spark: SparkSession, root: str, name: str = "main") -> DataFrame:
    """The observations of one state."""
    both = manifest(spark, root, name).withColumn("shard", F.substring("digest", 1, 2)).join(objects(spark, root), ["shard", "digest"])
    return both.select("series_id", F.explode("rows").alias("o")).select("series_id", "o.*")


def fork(spark: SparkSession, root: str, name: str, to: str, where: Column, value: Column) -> None:
    """State `to`: as `name`, but with `value` where `where` holds, both columns over the observations."""
    before, rows = manifest(spark, root, name), opened(spark, root, name).withColumn("block", block())
    touched = rows.where(where).select("series_id", "block").distinct()
    changed = sealed(rows.join(touched, ["series_id", "block"], "left_semi").withColumn("value", F.when(where, value).otherwise(F.col("value"))).drop("block"))
    _put(changed, root, objects(spark, root))
    kept = before.join(touched, ["series_id", "block"], "left_anti")
    kept.unionByName(changed.select("series_id", "block", "digest", "n")).write.parquet(f"{root}/manifests/{to}")


def shared_blocks(spark: SparkSession, root: str, a: str, b: str) -> DataFrame:
    """(series_id, blocks, shared): how much of each series two states have in common."""
    x, y = manifest(spark, root, a), manifest(spark, root, b).select("series_id", "block", F.col("digest").alias("other"))
    both = x.join(y, ["series_id", "block"], "full_outer")
    return both.groupBy("series_id").agg(F.count("*").alias("blocks"), F.sum(F.coalesce((F.col("digest") == F.col("other")).cast("long"), F.lit(0))).alias("shared"))


def unsound(spark: SparkSession, root: str) -> DataFrame:
    """Objects whose digest isn't that of their rows: none in a sound store."""
    return objects(spark, root).where(F.col("digest") != F.sha2(F.to_json("rows"), 256))
