"""Records of results, decision rules, and numbers quoted in texts, each checked against what can be recomputed."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Committed CSV records; a line that doesn't fit the schema fails the read."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def read_rule(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A decision rule: one JSON document of thresholds.  A missing file or field is refused."""
    rule = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    row = rule.first()
    if row is None or any(row[c] is None for c in rule.columns):
        raise ValueError(f"{path}: the rule lacks a threshold")
    return rule


def rule_file(path: str, schema_version: int = 1) -> dict[str, dict[str, float]]:
    """The decision rules of a JSON document: named sections of numbers.  Another version, or a value that is no number, is
    refused."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    if not isinstance(found, dict) or found.pop("schema_version", None) != schema_version:
        raise ValueError(f"{path}: schema_version must be {schema_version}")
    for name, section in found.items():
        if not isinstance(section, dict) or not all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in section.values()):
            raise ValueError(f"{path}: {name} must hold numbers")
    return found


def checked(recorded: DataFrame, now: DataFrame, keys: list[str], tolerance: float = 1e-6) -> DataFrame:
    """(records, unknown, off): recorded values that can't be recomputed, or differ from what is."""
    both = recorded.select(*keys, F.col("value").alias("_recorded")).join(now.select(*keys, F.col("value").alias("_now")), keys, "left")
    return both.agg(F.count("*").alias("records"), F.sum(F.col("_now").isNull().cast("long")).alias("unknown"), F.sum((F.abs(F.col("_now") - F.col("_recorded")) > tolerance).cast("long")).alias("off"))


def numbers_of(texts: DataFrame, key: str, text: str, most_places: int) -> DataFrame:
    """(key, shown, places, negative, value): the decimal numbers of each text, of at most so many places."""
    found = texts.select(key, F.explode(F.regexp_extract_all(text, F.lit(r"([+-]?[0-9]+\.[0-9]+)"), 1)).alias("shown"))
    found = found.withColumn("places", F.length(F.substring_index("shown", ".", -1))).where(F.col("places") <= most_places)
    return found.withColumn("negative", F.startswith("shown", F.lit("-"))).withColumn("value", F.abs(F.col("shown").cast("double")))


def _rounded(value: str | Column, places: str | Column) -> Column:
    return F.round(F.col(value) * F.pow(F.lit(10.0), places)).cast("long")


def unsourced(numbers: DataFrame, known: DataFrame, most_places: int) -> DataFrame:
    """The numbers that round-match no known value of the same sign."""
    shown = known.where(F.col("value").isNotNull()).withColumn("places", F.explode(F.sequence(F.lit(1), F.lit(most_places))))
    shown = shown.select("places", (F.col("value") < 0).alias("negative"), F.round(F.abs("value") * F.pow(F.lit(10.0), "places")).cast("long").alias("size")).distinct()
    return numbers.withColumn("size", _rounded("value", "places")).join(shown, ["places", "negative", "size"], "left_anti")
