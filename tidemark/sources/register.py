"""The register of forecasts: claims that are only ever added to, as JSON lines, and what became of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLAIMS = "indicator string, horizon_years int, data_as_of date, configuration_hash string, forecaster string, probability double, climatological_base_rate double, made_on date"
KEY = ("indicator", "horizon_years", "data_as_of", "configuration_hash", "forecaster")


def read(spark: SparkSession, path: str) -> DataFrame:
    """A line that isn't a claim fails the read."""
    return spark.read.schema(CLAIMS).option("mode", "FAILFAST").json(path)


def new_claims(batch: DataFrame, register: DataFrame) -> DataFrame:
    """The claims of a batch that the register lacks; the first of equal ones, by made_on and probability."""
    first = batch.groupBy(*KEY).agg(F.min(F.struct("made_on", "probability", "climatological_base_rate")).alias("c")).select(*KEY, "c.probability", "c.climatological_base_rate", "c.made_on")
    same = [first[k].eqNullSafe(register[k]) for k in KEY]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return first.join(register, on, "left_anti")


def append(claims: DataFrame, path: str) -> None:
    if not claims.isEmpty():
        claims.write.mode("append").json(path)


def resolves_on():
    """The day a claim is decided: `horizon_years` after its data, the 28th for the 29th of February."""
    return F.add_months("data_as_of", 12 * F.col("horizon_years"))


def due(register: DataFrame, today) -> DataFrame:
    return register.withColumn("resolves_on", resolves_on()).where(F.col("resolves_on") <= F.lit(today).cast("date"))


def resolved(register: DataFrame, outcomes: DataFrame, today, done: DataFrame | None = None) -> DataFrame:
    """Due claims with their outcome and both Brier terms; one whose outcome isn't known is pending, not a miss."""
    claims = due(register, today)
    if done is not None:
        claims = claims.join(done.select(*KEY), list(KEY), "left_anti")
    told = outcomes.select("indicator", F.col("month").alias("resolves_on"), "outcome")
    p, b, y = F.col("probability"), F.col("climatological_base_rate"), F.col("outcome")
    return claims.join(told, ["indicator", "resolves_on"], "left").withColumn("state", F.when(y.isNull(), "pending").otherwise("resolved")).withColumn("brier", (p - y) * (p - y)).withColumn("brier_climatology", (b - y) * (b - y))


def scorecard(resolutions: DataFrame, least: int = 10) -> DataFrame:
    """Number, Brier scores and skill by horizon and in total (a null horizon); no skill below `least` claims."""
    n = F.count("brier")
    skill = F.when((n >= least) & (F.sum("brier_climatology") > 0), 1 - F.sum("brier") / F.sum("brier_climatology"))
    return resolutions.rollup("horizon_years").agg(n.alias("n"), F.avg("brier").alias("brier"), F.avg("brier_climatology").alias("brier_climatology"), skill.alias("skill"))


def staleness(register: DataFrame, today, cadence: int = 45) -> DataFrame:
    """Days since the last round, and whether the next is overdue."""
    days = F.date_diff(F.lit(today).cast("date"), F.max("made_on"))
    return register.agg(F.max("made_on").alias("last_round"), days.alias("days"), (days > cadence).alias("overdue"))
