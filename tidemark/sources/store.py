"""The bitemporal store: what each series was at each date it was known.

One Parquet table partitioned by series, (series_id, vintage_date, observation_date, value); a null
vintage_date is the latest state.  A second table, snapshots, says of each (series, vintage) where it
came from.  Reading one vintage prunes to one partition and pushes the date down to the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OBSERVATIONS = T.StructType(
    [
        T.StructField("series_id", T.StringType()),
        T.StructField("vintage_date", T.DateType()),
        T.StructField("observation_date", T.DateType()),
        T.StructField("value", T.DoubleType()),
    ]
)
#: What stands for a missing value in delivered text.
MISSING = (".", "", "NA", "NaN")


def parse_delivered(lines: DataFrame) -> DataFrame:
    """(series_id, vintage_date, observation_date, value) of delivered text columns.

    Missing marks become null; a date that is none fails with its row, as strict casts do.
    """
    value = F.trim("value")
    return lines.select(
        "series_id",
        F.col("vintage_date").cast("date").alias("vintage_date"),
        F.col("observation_date").cast("date").alias("observation_date"),
        F.when(~value.isin(*MISSING), value).cast("double").alias("value"),
    )


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Two-column CSV files named ``<series_id>.csv``."""
    raw = spark.read.schema("observation_date string, value string").option("header", True).csv(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1)
    return parse_delivered(raw.select(name.alias("series_id"), F.lit(None).cast("string").alias("vintage_date"), "observation_date", "value"))


def snapshots(observations: DataFrame) -> DataFrame:
    """Of each (series, vintage): its key, first and last observation, counts, a digest of the values."""
    item = F.struct("observation_date", "value")
    return observations.groupBy("series_id", "vintage_date").agg(
        F.min("observation_date").alias("observation_start"),
        F.max("observation_date").alias("observation_end"),
        F.count("*").alias("observation_count"),
        F.sum(F.col("value").isNull().cast("long")).alias("missing_value_count"),
        F.sha2(F.to_json(F.sort_array(F.collect_list(item))), 256).alias("payload_digest"),
    ).withColumn("cache_key", cache_key())


def cache_key():
    return F.sha2(F.to_json(F.struct("series_id", "vintage_date")), 256)


def write(observations: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes observations and their snapshots; refuses to overwrite unless told to."""
    observations.select([f.name for f in OBSERVATIONS]).repartition("series_id", "vintage_date").sortWithinPartitions("vintage_date", "observation_date").write.mode(mode).partitionBy("series_id").parquet(f"{path}/observations")
    snapshots(observations).write.mode(mode).parquet(f"{path}/snapshots")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OBSERVATIONS).parquet(f"{path}/observations")


def verified(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots whose stored digest isn't that of the stored values: none in a sound store."""
    now = snapshots(read(spark, path)).select("cache_key", F.col("payload_digest").alias("found"))
    return spark.read.parquet(f"{path}/snapshots").join(now, "cache_key", "left").where(~F.col("payload_digest").eqNullSafe(F.col("found")))


def missing(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """The (series_id, vintage_date) wanted that the snapshots lack."""
    return wanted.join(held, wanted["series_id"].eqNullSafe(held["series_id"]) & wanted["vintage_date"].eqNullSafe(held["vintage_date"]), "left_anti")


def get_or_fetch(wanted: DataFrame, path: str, fetch) -> tuple[DataFrame, DataFrame]:
    """The wanted (series_id, vintage_date) from the store, fetching and adding what it lacks, and (lookups, hits,
    hit_rate) of this pass.  `fetch` gives the observations of a frame of missing ones."""
    spark = wanted.sparkSession
    lacking = missing(wanted.select("series_id", "vintage_date").distinct(), spark.read.parquet(f"{path}/snapshots"))
    lookups, misses = wanted.select("series_id", "vintage_date").distinct().count(), lacking.count()
    if misses:
        write(fetch(lacking), path, "append")
    rate = (lookups - misses) / lookups if lookups else None
    statistics = spark.createDataFrame([(lookups, lookups - misses, rate)], "lookups long, hits long, hit_rate double")
    held = read(spark, path)
    same = held["series_id"].eqNullSafe(wanted["series_id"]) & held["vintage_date"].eqNullSafe(wanted["vintage_date"])
    return held.join(wanted, same, "left_semi"), statistics


def copy(spark: SparkSession, path: str, to: str, unpublished=None) -> None:
    """Copies a store; values that `unpublished`, a column over the observations, marks are changed on the way, and
    the snapshots made anew."""
    rows = read(spark, path)
    if unpublished is not None:
        rows = rows.withColumn("value", F.when(unpublished, F.col("value") * 1.7 + 11).otherwise(F.col("value")))
    write(rows, to)
