"""Two runs compared on the forecasts that both made: keys split three ways, skills paired on the same draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bootstrap, scoring

RATIOS = {"baseline": ("ea", "fa"), "current": ("eb", "fb")}


def resolved(run: DataFrame) -> DataFrame:
    return scoring.usable(run, "predicted", "reference", "realised")


def sides(a: DataFrame, b: DataFrame, keys: list[str], by: str) -> DataFrame:
    """(by, both, only_baseline, only_current, unequal): the resolved forecasts of two runs, and of those in both how many
    tell different outcomes."""
    left, right = (resolved(x).select(*keys, F.col("realised").alias(n)) for x, n in ((a, "ya"), (b, "yb")))
    n = lambda c: F.sum(c.cast("long"))
    both, x, y = left.join(right, keys, "full_outer"), F.col("ya"), F.col("yb")
    return both.groupBy(by).agg(
        n(x.isNotNull() & y.isNotNull()).alias("both"), n(y.isNull()).alias("only_baseline"), n(x.isNull()).alias("only_current"), n(F.coalesce(x != y, F.lit(False))).alias("unequal")
    )


def shared_cells(a: DataFrame, b: DataFrame, keys: list[str], unit: Column) -> DataFrame:
    """(horizon, forecast_date, unit, y, ea, fa, eb, fb): squared errors of both runs and of their references, where both
    have a resolved forecast."""
    error = lambda p, n: scoring.squared(p).alias(n)
    left = resolved(a).select(*keys, F.col("realised").alias("y"), error("predicted", "ea"), error("reference", "fa"))
    right = resolved(b).select(*keys, error("predicted", "eb"), error("reference", "fb"))
    return left.join(right, keys).select("horizon", "forecast_date", unit.alias("unit"), "y", "ea", "fa", "eb", "fb")


def paired(cells: DataFrame, block: Column, resamples: int, level: float = 0.9, seed: int = bootstrap.SEED) -> DataFrame:
    """(horizon, shared, baseline_units, current_units, baseline_skill, current_skill, difference, usable, lower, upper).

    Each side scores the indicators its own skill is defined for on all shared forecasts; a draw of dates serves both
    sides, and one that either can't score counts for neither.
    """
    sums = cells.groupBy("horizon", "unit").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("y", "ea", "fa", "eb", "fb")))
    varied = (F.col("n") >= 2) & (F.col("y") > 0.5) & (F.col("y") < F.col("n") - 0.5)
    share = {s: F.when(varied & (F.col(f) > 1e-12), 1 - F.col(e) / F.col(f)) for s, (e, f) in RATIOS.items()}
    points = sums.groupBy("horizon").agg(F.sum("n").alias("shared"), *(F.count(c).alias(f"{s}_units") for s, c in share.items()), *(F.avg(c).alias(f"{s}_skill") for s, c in share.items()))
    points = points.withColumn("difference", F.col("current_skill") - F.col("baseline_skill"))
    drawn = bootstrap.mean_ratios(cells, ["horizon"], "forecast_date", "unit", RATIOS, block, resamples, seed)
    ends = bootstrap.interval(drawn, ["horizon"], F.col("current") - F.col("baseline"), level, resamples)
    return points.join(ends, "horizon", "left")
