"""Scores of forecasts: (keys, forecast date, predicted, reference, realised) with null for what isn't known."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The exact edges of ten bins, as doubles.
EDGES = [i * 0.1 for i in range(1, 10)]
LOW, HIGH = 0.01, 0.99


def usable(df: DataFrame, *columns: str) -> DataFrame:
    """Rows where all of the columns are numbers."""
    ok = [F.col(c).isNotNull() & ~F.isnan(c) for c in columns]
    return df.where(reduce(lambda a, b: a & b, ok))


def bin_of(p: Column) -> Column:
    """0 to 9: how many inner edges are not above p."""
    return reduce(lambda a, b: a + b, [(p >= F.lit(e)).cast("int") for e in EDGES])


def squared(p: str | Column, y: str | Column = "realised") -> Column:
    p, y = (F.col(c) if isinstance(c, str) else c for c in (p, y))
    return (p - y) * (p - y)


def log_loss(p: Column, y: Column) -> Column:
    c = F.least(F.greatest(p, F.lit(LOW)), F.lit(HIGH))
    return -(y * F.ln(c) + (1 - y) * F.ln(1 - c))


def skill(p: str = "predicted", reference: str = "reference") -> Column:
    """An aggregate: 1 less the ratio of squared errors, over the rows that have both and an outcome; null where the
    reference has none."""
    a, b = squared(p), squared(reference)
    return 1 - F.sum(F.when(b.isNotNull(), a)) / F.nullif(F.sum(F.when(a.isNotNull(), b)), F.lit(0.0))


def area_under_curve(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, auc) by mid-ranks; null where only one class is there.

    Ranks come from the counts of each distinct forecast, so equal forecasts are one row before any window.
    """
    ties = usable(df, "predicted", "realised").groupBy(*keys, "predicted").agg(F.count("*").alias("n"), F.sum("realised").alias("pos"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("predicted").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ties.withColumn("rank", before + (F.col("n") + 1) / 2)
    pos, n = F.sum("pos"), F.sum("n")
    auc = F.when((pos > 0) & (pos < n), (F.sum(F.col("pos") * F.col("rank")) - pos * (pos + 1) / 2) / (pos * (n - pos)))
    return ranked.groupBy(*keys).agg(auc.alias("auc"))


def reliability_bins(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bin, n, mean_forecast, observed_rate, standard_error)."""
    rows = usable(df, "predicted", "realised").withColumn("bin", bin_of(F.col("predicted")))
    n, rate = F.count("*"), F.avg("realised")
    return rows.groupBy(*keys, "bin").agg(n.alias("n"), F.avg("predicted").alias("mean_forecast"), rate.alias("observed_rate"), F.sqrt(rate * (1 - rate) / n).alias("standard_error"))


def calibration_error(df: DataFrame, keys: list[str]) -> DataFrame:
    gap = F.abs(F.col("mean_forecast") - F.col("observed_rate"))
    return reliability_bins(df, keys).groupBy(*keys).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("calibration_error"))


def murphy(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, reliability, resolution, uncertainty, residual): the Brier score in three parts, and what binning leaves."""
    rows = usable(df, "predicted", "realised").withColumn("bin", bin_of(F.col("predicted")))
    bins = rows.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.sum("predicted").alias("p"), F.sum("realised").alias("y"), F.sum(squared("predicted")).alias("e"))
    total = Window.partitionBy(*keys)
    bins = bins.withColumn("all", F.sum("n").over(total)).withColumn("base", F.sum("y").over(total) / F.sum("n").over(total))
    p, y = F.col("p") / F.col("n"), F.col("y") / F.col("n")
    out = bins.groupBy(*keys).agg(
        (F.sum(F.col("n") * (p - y) * (p - y)) / F.sum("n")).alias("reliability"),
        (F.sum(F.col("n") * (y - F.col("base")) * (y - F.col("base"))) / F.sum("n")).alias("resolution"),
        (F.first("base") * (1 - F.first("base"))).alias("uncertainty"),
        (F.sum("e") / F.sum("n")).alias("brier"),
    )
    return out.withColumn("residual", F.col("brier") - (F.col("reliability") - F.col("resolution") + F.col("uncertainty")))


def reversals(df: DataFrame, keys: list[str], width: float = 2.0, inflation: DataFrame | None = None) -> DataFrame:
    """(keys, pairs, reversals): pairs of bins where the later was observed clearly less often.  At most 45 for a key.

    `inflation` (keys, inflation) says how many forecasts are worth one: a bin's error is then that of its effective
    count, one at least.
    """
    bins = reliability_bins(df, keys)
    if inflation is not None:
        worth = F.greatest(F.col("n") / F.col("inflation"), F.lit(1.0))
        bins = bins.join(inflation, keys).withColumn("standard_error", F.sqrt(F.col("observed_rate") * (1 - F.col("observed_rate")) / worth))
    a, b = bins.alias("a"), bins.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col("a.bin") < F.col("b.bin")]
    spread = width * F.sqrt(F.col("a.standard_error") * F.col("a.standard_error") + F.col("b.standard_error") * F.col("b.standard_error"))
    pairs = a.join(b, reduce(lambda x, y: x & y, same)).select(*(F.col(f"a.{k}").alias(k) for k in keys), (F.col("b.observed_rate") < F.col("a.observed_rate") - spread).cast("long").alias("r"))
    return pairs.groupBy(*keys).agg(F.count("*").alias("pairs"), F.sum("r").alias("reversals"))


def metric_table(df: DataFrame, keys: list[str]) -> DataFrame:
    """All scores of each key in one row."""
    rows = usable(df, "predicted", "realised", "reference")
    p, y = F.col("predicted"), F.col("realised")
    basic = rows.groupBy(*keys).agg(
        F.count("*").alias("resolved_forecasts"),
        F.avg("realised").alias("base_rate"),
        F.avg(squared("predicted")).alias("brier_score"),
        F.avg(squared("reference")).alias("reference_brier_score"),
        skill().alias("brier_skill"),
        F.avg(log_loss(p, y)).alias("log_loss"),
    )
    return basic.join(area_under_curve(rows, keys), keys).join(calibration_error(rows, keys), keys).join(murphy(rows, keys).select(*keys, "reliability", "resolution"), keys)


def mean_skill(df: DataFrame, group: str, over: str, least: int = 2) -> DataFrame:
    """(group, mean_skill, defined, indicators, pooled_skill): the mean over `over`, where every one has a skill."""
    n, pos, ref = F.count("*"), F.sum("realised"), F.sum(squared("reference"))
    each = usable(df, "predicted", "realised", "reference").groupBy(group, over).agg(F.when((n >= least) & (pos > 0) & (pos < n) & (ref > 0), 1 - F.sum(squared("predicted")) / ref).alias("skill"), F.sum(squared("predicted")).alias("e"), ref.alias("r"))
    k = F.count("skill")
    return each.groupBy(group).agg(F.when(k == F.count("*"), F.avg("skill")).alias("mean_skill"), k.alias("defined"), F.count("*").alias("indicators"), (1 - F.sum("e") / F.nullif(F.sum("r"), F.lit(0.0))).alias("pooled_skill"))


def design_effect(df: DataFrame, keys: list[str], unit: str, date: str, value: str) -> DataFrame:
    """(keys, units, mean_correlation, design_effect) over the dates that every unit of a key has; units without spread
    are left out.

    Correlations come from the sums of products, one row for each pair of units.
    """
    known = usable(df, value)
    units = df.groupBy(*keys).agg(F.count_distinct(unit).alias("_units"))
    complete = known.groupBy(*keys, date).agg(F.count_distinct(unit).alias("_k")).join(units, keys).where("_k = _units").select(*keys, date)
    rows = known.join(complete, [*keys, date]).select(*keys, date, unit, F.col(value).alias("v"))
    varied = rows.groupBy(*keys, unit).agg(F.stddev_pop("v").alias("sd")).where("sd > 1e-12").select(*keys, unit)
    rows = rows.join(varied, [*keys, unit])
    a, b = rows.select(*keys, date, F.col(unit).alias("u"), F.col("v").alias("x")), rows.select(*keys, date, F.col(unit).alias("w"), F.col("v").alias("y"))
    each = a.join(b, [*keys, date]).where("u < w").groupBy(*keys, "u", "w").agg(F.corr("x", "y").alias("r"))
    mean = each.groupBy(*keys).agg(F.avg("r").alias("mean_correlation"))
    out = varied.groupBy(*keys).agg(F.count("*").alias("units")).join(mean, keys, "left")
    return out.select(*keys, "units", "mean_correlation", F.greatest(F.lit(1.0), 1 + (F.col("units") - 1) * F.coalesce("mean_correlation", F.lit(0.0))).alias("design_effect"))


def chronological_blocks(df: DataFrame, keys: list[str], date: str, blocks: int = 4) -> DataFrame:
    """Adds `block` 1 to `blocks` over each key's distinct dates; earlier blocks take the remainder."""
    numbered = df.select(*keys, date).distinct().withColumn("block", F.ntile(blocks).over(Window.partitionBy(*keys).orderBy(date)))
    return df.join(numbered, [*keys, date])


def weighted_correlation(df: DataFrame, keys: list[str], a: str, b: str, weight: str, least: float) -> DataFrame:
    """(keys, months, correlation) of two columns around their weighted means; keys of less weight are left out."""
    x, y, w = F.col(a), F.col(b), F.col(weight)
    s = df.groupBy(*keys).agg(F.sum(w).alias("months"), *(F.sum(w * c).alias(n) for n, c in (("sx", x), ("sy", y), ("sxx", x * x), ("syy", y * y), ("sxy", x * y))))
    mx, my = F.col("sx") / F.col("months"), F.col("sy") / F.col("months")
    spread = F.sqrt((F.col("sxx") - mx * F.col("sx")) * (F.col("syy") - my * F.col("sy")))
    return s.where(F.col("months") >= least).select(*keys, "months", ((F.col("sxy") - mx * F.col("sy")) / F.nullif(spread, F.lit(0.0))).alias("correlation"))
