"""Fitted models as documents: versioned JSON, read back by what the document says it is.

A document names its version and class and holds one entry for each chain.  A model of one chain is that chain, a model
of two chains is their product, which is built on reading: what is stored is what was fitted.  Documents of the first
version had no class and held a single chain's fields themselves.  Doubles are written so that reading gives the
same ones again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import algebra

VERSION, SINGLE, TWO = 2, "single_chain", "two_chains"
CHAIN = "columns: array<string>, start: array<double>, transition: array<array<double>>, means: array<array<double>>, covariances: array<array<array<double>>>"
DOCUMENT = f"version int, model_class string, chains array<struct<{CHAIN}>>, {CHAIN.replace(': array', ' array')}"
CACHED = "digest string, document string"
PARTS = ("start", "transition", "means", "covariances")


def chain(columns: list[str], start: Column, transition: Column, means: Column, covariances: Column) -> Column:
    return F.struct(F.array(*map(F.lit, columns)).alias("columns"), start.alias("start"), transition.alias("transition"), means.alias("means"), covariances.alias("covariances"))


def document(*chains: Column) -> Column:
    """The document of a model of one chain, or of the product of two."""
    if len(chains) not in (1, 2):
        raise ValueError("a model has one chain or two")
    return F.to_json(F.struct(F.lit(VERSION).alias("version"), F.lit(SINGLE if len(chains) == 1 else TWO).alias("model_class"), F.array(*chains).alias("chains")))


def write(models: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes (keys, document) as text columns."""
    models.write.mode(mode).parquet(path)


def read(spark: SparkSession, path: str, keys: str) -> DataFrame:
    """(keys, model_class, columns, start, transition, means, covariances) of the documents below a path."""
    return parsed(spark.read.schema(f"{keys}, document string").parquet(path))


def parsed(documents: DataFrame) -> DataFrame:
    """The models that documents hold; one of an unknown class or version, or that isn't a document, fails its reading."""
    d = F.col("_d")
    rows = documents.withColumn("_d", F.from_json("document", DOCUMENT))
    first = d["version"].isNull() & d["model_class"].isNull() & d["start"].isNotNull()
    old = F.struct(*(d[n].alias(n) for n in ("columns", *PARTS)))
    kind = F.when(first, F.lit(SINGLE)).otherwise(d["model_class"])
    chains = F.when(first, F.array(old)).otherwise(d["chains"])
    count = F.when(kind == SINGLE, 1).when(kind == TWO, 2)
    known = (first | (d["version"] == VERSION)) & (F.size(chains) == count)
    why = F.concat(F.lit("not a model document of a known class: version "), F.coalesce(d["version"].cast("string"), F.lit("none")), F.lit(", class "), F.coalesce(kind, F.lit("none")))
    rows = rows.withColumn("_chains", F.when(F.coalesce(known, F.lit(False)), chains).otherwise(F.raise_error(why).cast(f"array<struct<{CHAIN}>>"))).withColumn("model_class", kind)
    a, b, two = F.col("_chains")[0], F.get("_chains", F.lit(1)), F.col("model_class") == TWO
    joined = {
        "columns": F.concat(a["columns"], b["columns"]),
        "start": algebra.kron_vector(a["start"], b["start"]),
        "transition": algebra.kron_matrix(a["transition"], b["transition"]),
        "means": algebra.side_by_side(a["means"], b["means"]),
        "covariances": algebra.block_diagonal(a["covariances"], b["covariances"]),
    }
    return rows.select(*(c for c in documents.columns if c != "document"), "model_class", *(F.when(two, v).otherwise(a[n]).alias(n) for n, v in joined.items()))


def get_or_fit(panels: DataFrame, settings: str, path: str, fit: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(models, statistics) of panels (key, rows): each model's key, digest and document, from the cache below `path` or fitted
    now and kept; statistics are (lookups, hits, hit_rate).

    A model is known by a digest of its panel's rows and the settings, so the same panel is fitted once whatever its
    key, and a panel that was revised is fitted anew.  `fit` gives (digest, document) of the panels (digest, key, rows) it gets,
    one for each digest.
    """
    spark = panels.sparkSession
    named = panels.select("key", F.sha2(F.concat(F.to_json("rows"), F.lit(settings)), 256).alias("digest"), "rows")
    wanted = named.select("key", "digest")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    held = spark.read.schema(CACHED).parquet(path) if there else spark.createDataFrame([], CACHED)
    lacking = named.join(held.select("digest"), "digest", "left_anti")
    lookups, misses = wanted.count(), lacking.count()
    if misses:
        fit(lacking.dropDuplicates(["digest"])).select("digest", "document").write.mode("append").parquet(path)
    statistics = spark.createDataFrame([(lookups, lookups - misses, (lookups - misses) / lookups if lookups else None)], "lookups long, hits long, hit_rate double")
    return wanted.join(spark.read.schema(CACHED).parquet(path), "digest"), statistics
