"""The registry: which series, derived series and questions there are.

Small dimension tables, read from YAML (or JSON, a part of YAML) files of the user's, checked against each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SERIES = "name string, series_id string, description string, role string, model_dimension string, frequency string, units string, transform string, publication_lag_days int, observation_start date, is_revised boolean"
DERIVED = "name string, description string, operation string, minuend string, subtrahend string, units string"
QUESTIONS = "name string, question string, series string, rule string, transform string, composition string, threshold double, horizons_in_years array<int>"

TRANSFORMS = ("level", "year_over_year_log_change", "year_over_year_percent_change")
RULES = ("value_at_horizon_above", "any_value_above_within_horizon", "any_value_below_within_horizon")


def read_file(path: str, schema_version: int = 1) -> dict:
    import yaml

    with open(path, encoding="utf-8") as file:
        found = yaml.safe_load(file)
    if not isinstance(found, dict) or found.get("schema_version") != schema_version:
        raise ValueError(f"{path}: schema_version must be {schema_version}")
    return found


def dimension(spark: SparkSession, entries: list[dict], schema: str) -> DataFrame:
    """A dimension table; every field but the last-named optional ones must be there, names must be unique."""
    names = [f.split()[0] for f in schema.split(", ")]
    optional = {"model_dimension", "description", "units"}
    for e in entries:
        if lacking := [n for n in names if n not in e and n not in optional]:
            raise ValueError(f"{e.get('name', '?')}: lacks {', '.join(lacking)}")
    if len({e["name"] for e in entries}) < len(entries):
        raise ValueError("a name is there twice")
    return spark.createDataFrame([tuple(e.get(n) for n in names) for e in entries], schema)


def unknown_references(questions: DataFrame, series: DataFrame, derived: DataFrame) -> DataFrame:
    """(name, refers_to): questions and derived series that name no known series."""
    known = series.select("name").union(derived.select("name")).withColumnRenamed("name", "refers_to")
    refers = questions.selectExpr("name", "series AS refers_to")
    legs = derived.selectExpr("name", "minuend AS refers_to").union(derived.selectExpr("name", "subtrahend AS refers_to"))
    plain = series.selectExpr("name AS refers_to")
    return refers.join(known, "refers_to", "left_anti").union(legs.join(plain, "refers_to", "left_anti")).select("name", "refers_to")
