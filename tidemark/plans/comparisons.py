"""Runs against runs, and forecasters against benchmarks: the walk forward of the condition's own chain is the baseline, the
one with regimes the current run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bootstrap, diff, runs, scoring
from ..operators import outcomes as oc
from ..sources import records
from ..sources.scratch import stored
from . import regimewalk as rw
from . import walkforward as wf
from .gates import LEAST_INDEPENDENT, LEAST_SKILL, LEAST_USABLE, RESAMPLES, SAMPLE_MONTHS, SHORTEST_BLOCK, draws
from .library import K, W, grid, query, r, with_horizons

KEYS = [*wf.KEYS, "forecast_date"]
FORECAST = [*KEYS, "predicted", "reference", "realised"]


def two_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(baseline, current): forecasts of the chain blended with its reference, and of regimes blended with the chain."""
    made = wf.forecasts(spark, sf_dir), rw.given_run(spark, sf_dir)
    return tuple(stored(f.withColumn("predicted", F.round("predicted", 9)).select(*FORECAST), "run") for f in made)


_RUNS = rw.WHOLE + f""", ra AS (SELECT {K}, forecast_date, round(predicted, 9) AS predicted, reference, realised FROM fore),
rb AS (SELECT {K}, as_of AS forecast_date, round(0.5 * model + 0.5 * chain, 9) AS predicted, climatology AS reference, outcome AS realised FROM made),
va AS (SELECT * FROM ra WHERE predicted IS NOT NULL AND reference IS NOT NULL AND realised IS NOT NULL), vb AS (SELECT * FROM rb WHERE predicted IS NOT NULL AND reference IS NOT NULL AND realised IS NOT NULL),
shared AS (SELECT horizon, forecast_date, series_id || composition AS unit, a.realised AS y, pow(a.predicted - a.realised, 2) AS ea, pow(a.reference - a.realised, 2) AS fa, pow(b.predicted - b.realised, 2) AS eb, pow(b.reference - b.realised, 2) AS fb FROM va a JOIN vb b USING ({K}, forecast_date))"""


@query(_RUNS + f" SELECT horizon::INTEGER AS horizon, sum((a.realised IS NOT NULL AND b.realised IS NOT NULL)::INTEGER)::BIGINT AS both, sum((b.realised IS NULL)::INTEGER)::BIGINT AS only_baseline, sum((a.realised IS NULL)::INTEGER)::BIGINT AS only_current, sum(coalesce(a.realised <> b.realised, false)::INTEGER)::BIGINT AS unequal FROM va a FULL JOIN vb b USING ({K}, forecast_date) GROUP BY horizon")
def run_keys(spark, sf_dir):
    """Which resolved forecasts two runs share."""
    return runs.sides(*two_runs(spark, sf_dir), KEYS, "horizon")


_DIFF = "current - baseline"


@query(
    _RUNS + f""", {draws('shared', ratios=runs.RATIOS)}, pts AS (SELECT o.horizon, sum(n)::BIGINT AS shared, count(*) FILTER (is_baseline) AS baseline_units, count(*) FILTER (is_current) AS current_units, avg(1 - ea / fa) FILTER (is_baseline) AS baseline_skill, avg(1 - eb / fb) FILTER (is_current) AS current_skill FROM own o JOIN fixed f ON f.horizon = o.horizon AND f.unit = o.unit GROUP BY 1),
    ends AS (SELECT horizon, count({_DIFF}) AS usable, quantile_cont({_DIFF}, 0.05) AS lower, quantile_cont({_DIFF}, 0.95) AS upper FROM samples GROUP BY 1)
    SELECT p.horizon::INTEGER AS horizon, shared, baseline_units, current_units, {r('baseline_skill')} AS baseline_skill, {r('current_skill')} AS current_skill, {r('current_skill - baseline_skill')} AS difference, usable, CASE WHEN usable >= {LEAST_USABLE} THEN {r('lower')} END AS lower, CASE WHEN usable >= {LEAST_USABLE} THEN {r('upper')} END AS upper FROM pts p JOIN ends e ON e.horizon = p.horizon"""
)
def run_comparison(spark, sf_dir):
    """How far the current run's skill is from the baseline's, on the forecasts both made and the same draws."""
    cells = stored(runs.shared_cells(*two_runs(spark, sf_dir), KEYS, F.concat("series_id", "composition")), "cells")
    return runs.paired(cells, F.col("horizon"), RESAMPLES)


@query(_RUNS + f" SELECT count(*) AS joined, (SELECT count(*) FROM ra) AS first_rows, (SELECT count(*) FROM rb) AS second_rows, sum((a.realised IS DISTINCT FROM b.realised)::INTEGER)::BIGINT AS unequal, count(*) = (SELECT count(*) FROM ra) AND count(*) = (SELECT count(*) FROM rb) AND sum((a.realised IS DISTINCT FROM b.realised)::INTEGER) = 0 AS complete FROM ra a JOIN rb b USING ({K}, forecast_date)")
def complete_join_check(spark, sf_dir):
    """Whether two runs have the same forecasts, one to one, and the same outcomes: the runs start at different dates."""
    return diff.complete_join(*(f.select(*KEYS, "realised") for f in two_runs(spark, sf_dir)), KEYS, ["realised"])


@query(
    _RUNS + f""", sk AS (SELECT 'a' AS run, {K}, round(1 - sum(pow(predicted - realised, 2)) / nullif(sum(pow(reference - realised, 2)), 0), 8) AS value FROM va GROUP BY ALL UNION ALL SELECT 'b', {K}, round(1 - sum(pow(predicted - realised, 2)) / nullif(sum(pow(reference - realised, 2)), 0), 8) FROM vb GROUP BY ALL),
    recorded AS (SELECT * FROM sk WHERE run = 'a'), now AS (SELECT * FROM sk WHERE run = 'b')
    SELECT count(*) AS records, sum((n.value IS NULL)::INTEGER)::BIGINT AS unknown, sum((abs(n.value - r.value) > 1e-6)::INTEGER)::BIGINT AS off FROM recorded r LEFT JOIN now n USING ({K})"""
)
def record_check(spark, sf_dir):
    """Skills that the baseline recorded against those that the current run gives: all that changed are told."""
    recorded, now = (runs.resolved(f).groupBy(*wf.KEYS).agg(F.round(scoring.skill(), 8).alias("value")) for f in two_runs(spark, sf_dir))
    return records.checked(recorded, now, wf.KEYS)


# ---- skill at every horizon: two forecasters against two benchmarks

LONGEST = 120
CURVES = ("series_start", "model_sample")
_BLOCK = f"greatest(horizon, {SHORTEST_BLOCK})"
_LINES = {"blend": "skill", "chain": "chain_skill", "difference": "skill - chain_skill"}


def curve_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(benchmark, horizon, forecast_date, unit, y, e, f, g): errors of blend (e), chain (g) and benchmark (f), at every
    horizon that resolves, where the benchmark is known."""
    conditions, horizons = grid(spark, sf_dir), list(range(1, LONGEST + 1))
    f = wf.forecasts_from(conditions, horizons).withColumn("predicted", F.round("predicted", 9)).where(F.col("realised").isNotNull())
    sample = oc.sample_climatology(oc.outcomes(conditions, horizons), wf.KEYS, wf.LAG_DAYS, SAMPLE_MONTHS).select(*wf.KEYS, F.col("month").alias("forecast_date"), F.col("sample_climatology").alias("model_sample"))
    rows = f.withColumnRenamed("reference", "series_start").join(sample, KEYS, "left").unpivot([*KEYS, "predicted", "chain", "realised"], list(CURVES), "benchmark", "reference")
    unit = F.concat("series_id", "composition").alias("unit")
    cells = rows.select("benchmark", "horizon", "forecast_date", unit, F.col("realised").alias("y"), scoring.squared("predicted").alias("e"), scoring.squared("reference").alias("f"), scoring.squared("chain").alias("g"))
    return cells.where("e IS NOT NULL AND f IS NOT NULL AND g IS NOT NULL")


def curves(cells: DataFrame, resamples: int = RESAMPLES) -> DataFrame:
    """(benchmark, horizon, forecaster, mean_skill, lower, upper, usable, dates, independent, carries_skill, informative) of blend, chain and
    their difference, all on the same draws."""
    keys = ["benchmark", "horizon"]
    block: Column = F.greatest(F.col("horizon"), F.lit(SHORTEST_BLOCK))
    ratios = {"skill": ("e", "f"), "chain_skill": ("g", "f")}
    sums = cells.groupBy(*keys, "unit").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in "yefg"))
    ok = (F.col("n") >= 2) & (F.col("y") > 0.5) & (F.col("y") < F.col("n") - 0.5) & (F.col("f") > 1e-12)
    means = sums.groupBy(*keys).agg(*(F.avg(F.when(ok, 1 - F.col(a) / F.col(b))).alias(n) for n, (a, b) in ratios.items()))
    lines = lambda df, more: df.select(*more, F.explode(F.create_map(*(x for n, e in _LINES.items() for x in (F.lit(n), F.expr(e))))).alias("forecaster", "x"))
    drawn = lines(bootstrap.mean_ratios(cells, keys, "forecast_date", "unit", ratios, block, resamples), keys)
    n = F.count("x")
    ends = drawn.groupBy(*keys, "forecaster").agg(n.alias("usable"), *(F.when(n >= LEAST_USABLE, F.percentile("x", F.lit(q))).alias(a) for a, q in (("lower", 0.05), ("upper", 0.95))))
    dates = cells.groupBy(*keys).agg(F.count_distinct("forecast_date").alias("dates"))
    rows = lines(means, keys).withColumnRenamed("x", "mean_skill").where(F.col("mean_skill").isNotNull()).join(ends, [*keys, "forecaster"]).join(dates, keys)
    rows = rows.withColumn("independent", F.col("dates") / F.least(block, F.col("dates")))
    carries = F.when(F.col("forecaster") == "difference", F.col("lower") > 0).otherwise((F.col("mean_skill") > LEAST_SKILL) & (F.col("lower") > 0))
    return rows.withColumn("carries_skill", F.coalesce(carries, F.lit(False))).withColumn("informative", F.col("independent") >= LEAST_INDEPENDENT)


_CURVES = with_horizons(range(1, LONGEST + 1)) + f""", r1 AS (SELECT a.series_id, a.composition, a.horizon, a.month, avg(b.outcome) AS reference FROM found a JOIN found b ON a.series_id = b.series_id AND a.composition = b.composition AND a.horizon = b.horizon AND b.outcome IS NOT NULL
    AND (b.month + to_months(b.horizon))::DATE + {wf.LAG_DAYS} <= a.month AND b.month >= (a.month - to_months({SAMPLE_MONTHS}))::DATE GROUP BY 1, 2, 3, 4),
cells2 AS MATERIALIZED (SELECT benchmark, horizon, forecast_date, series_id || composition AS unit, realised AS y, pow(predicted - realised, 2) AS e, pow(reference - realised, 2) AS f, pow(chain - realised, 2) AS g FROM (
    SELECT 'series_start' AS benchmark, {K}, forecast_date, predicted, chain, realised, reference FROM scored UNION ALL SELECT 'model_sample', s.series_id, s.composition, s.horizon, forecast_date, predicted, chain, realised, q.reference FROM scored s JOIN r1 q ON q.series_id = s.series_id AND q.composition = s.composition AND q.horizon = s.horizon AND q.month = s.forecast_date)
    WHERE reference IS NOT NULL AND predicted IS NOT NULL AND chain IS NOT NULL),
{draws('cells2', block=_BLOCK, keys=('benchmark', 'horizon'))},
means2 AS (SELECT o.benchmark, o.horizon, avg(1 - e / f) FILTER (is_skill) AS skill, avg(1 - g / f) FILTER (is_skill) AS chain_skill FROM own o JOIN fixed x ON x.benchmark = o.benchmark AND x.horizon = o.horizon AND x.unit = o.unit GROUP BY 1, 2),
lines2 AS ({' UNION ALL '.join(f"SELECT benchmark, horizon, '{n}' AS forecaster, {e} AS x FROM means2" for n, e in _LINES.items())}),
drawn2 AS ({' UNION ALL '.join(f"SELECT benchmark, horizon, '{n}' AS forecaster, {e} AS x FROM samples" for n, e in _LINES.items())}),
ends2 AS (SELECT benchmark, horizon, forecaster, count(x) AS usable, CASE WHEN count(x) >= {LEAST_USABLE} THEN quantile_cont(x, 0.05) END AS lower, CASE WHEN count(x) >= {LEAST_USABLE} THEN quantile_cont(x, 0.95) END AS upper FROM drawn2 GROUP BY 1, 2, 3),
dates2 AS (SELECT DISTINCT benchmark, horizon, n AS dates FROM placed)
SELECT l.benchmark, l.horizon::INTEGER AS horizon, l.forecaster, {r('l.x')} AS mean_skill, {r('lower')} AS lower, {r('upper')} AS upper, usable, dates, {r(f"dates / least({_BLOCK.replace('horizon', 'l.horizon')}, dates)::DOUBLE")} AS independent,
    coalesce(CASE WHEN l.forecaster = 'difference' THEN lower > 0 ELSE l.x > {LEAST_SKILL} AND lower > 0 END, false) AS carries_skill, dates / least({_BLOCK.replace('horizon', 'l.horizon')}, dates)::DOUBLE >= {LEAST_INDEPENDENT} AS informative
FROM lines2 l JOIN ends2 e ON e.benchmark = l.benchmark AND e.horizon = l.horizon AND e.forecaster = l.forecaster JOIN dates2 d ON d.benchmark = l.benchmark AND d.horizon = l.horizon WHERE l.x IS NOT NULL"""


@query(_CURVES)
def skill_curves(spark, sf_dir):
    """Skill of blend and chain, and their difference, against both benchmarks at every horizon from 1 to 120 that resolves."""
    rows = curves(stored(curve_cells(spark, sf_dir), "cells"))
    return rows.select("benchmark", "horizon", "forecaster", "mean_skill", "lower", "upper", "usable", "dates", "independent", "carries_skill", "informative")
