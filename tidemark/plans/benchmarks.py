"""What forecasts are held against: recalibration on held-out blocks, chance alone, and benchmarks of another frequency."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import probability as pr
from ..operators import bootstrap, calibration, crossfit, mixed, scoring, transforms
from ..sources import tables
from ..sources.scratch import stored
from . import walkforward as wf
from .gates import LEAST_USABLE, RESAMPLES, draws
from .library import W, grid, query, r, scored

# ---- recalibration out of sample

_ROWS = f"""blk4 AS (SELECT horizon, forecast_date, ntile(4) OVER (PARTITION BY horizon ORDER BY forecast_date) AS block FROM (SELECT DISTINCT horizon, forecast_date FROM scored)),
bins3 AS (SELECT s.horizon, block, round(predicted * {crossfit.BINS})::INTEGER AS bin, count(*)::DOUBLE AS n, sum(realised) AS y, sum(e) AS raw FROM scored s JOIN blk4 USING (horizon, forecast_date) GROUP BY 1, 2, 3),
held AS MATERIALIZED (SELECT horizon, h.held, bin, coalesce(sum(n) FILTER (block = held), 0) AS n_out, coalesce(sum(y) FILTER (block = held), 0) AS y_out, coalesce(sum(raw) FILTER (block = held), 0) AS raw_out, coalesce(sum(n) FILTER (block <> held), 0) AS n_in, coalesce(sum(y) FILTER (block <> held), 0) AS y_in,
    ln(least(greatest(bin / {crossfit.BINS}::DOUBLE, {calibration.LOW}), {calibration.HIGH}) / (1 - least(greatest(bin / {crossfit.BINS}::DOUBLE, {calibration.LOW}), {calibration.HIGH}))) AS x FROM bins3, (VALUES (1), (2), (3), (4)) h(held) GROUP BY 1, 2, 3),
fit AS MATERIALIZED (SELECT *, row_number() OVER w AS i, sum(n_in) OVER w AS cn, sum(y_in) OVER w AS cy FROM held WHERE n_in > 0 WINDOW w AS (PARTITION BY horizon, held ORDER BY bin)),
spans3 AS (SELECT b.horizon, b.held, a.i AS a, b.i AS b, (b.cy - a.cy + a.y_in) / (b.cn - a.cn + a.n_in) AS m FROM fit a JOIN fit b ON a.horizon = b.horizon AND a.held = b.held AND a.i <= b.i),
low3 AS (SELECT horizon, held, a, b, min(m) OVER (PARTITION BY horizon, held, a ORDER BY b DESC) AS m FROM spans3),
level AS MATERIALIZED (SELECT l.horizon, l.held, f.bin, max(m) AS q FROM low3 l JOIN fit f ON f.horizon = l.horizon AND f.held = l.held AND f.i = l.b GROUP BY 1, 2, 3),
mono AS (SELECT h.horizon, h.held, h.bin, any_value(n_out) AS n, any_value(y_out) AS y, coalesce(max_by(l.q, l.bin) FILTER (l.bin <= h.bin), min_by(l.q, l.bin)) AS q FROM held h JOIN level l ON l.horizon = h.horizon AND l.held = h.held WHERE n_out > 0 GROUP BY 1, 2, 3)"""


def _ridge_sql(steps: int = 14) -> str:
    ctes, k = ["line0 AS (SELECT DISTINCT horizon, held, 0::DOUBLE AS a, 1::DOUBLE AS b FROM fit)"], crossfit.RIDGE
    for i in range(steps):
        sums = f"SELECT f.horizon, f.held, any_value(a) AS a, any_value(b) AS b, sum(n_in * q * (1 - q)) + {k} AS h, sum(n_in * q * (1 - q) * x) AS i, sum(n_in * q * (1 - q) * x * x) + {k} AS j, sum(y_in - n_in * q) - {k} * any_value(a) AS g, sum((y_in - n_in * q) * x) - {k} * (any_value(b) - 1) AS k FROM (SELECT d.*, a, b, 1 / (1 + exp(-(a + b * x))) AS q FROM fit d JOIN line{i} USING (horizon, held)) f GROUP BY 1, 2"
        ctes.append(f"line{i + 1} AS MATERIALIZED (SELECT horizon, held, a + (j * g - i * k) / (h * j - i * i) AS a, b + (h * k - i * g) / (h * j - i * i) AS b FROM ({sums}))")
    return ", ".join(ctes) + f", straight AS (SELECT horizon, held, bin, n_out AS n, y_out AS y, 1 / (1 + exp(-(a + b * x))) AS q FROM held JOIN line{steps} USING (horizon, held) WHERE n_out > 0)"


@query(
    W + f""", {_ROWS}, {_ridge_sql()}, one AS (SELECT horizon, sum(n_out) AS n, sum(raw_out) AS raw FROM held WHERE n_out > 0 GROUP BY 1), two AS (SELECT horizon, sum(n * q * q - 2 * q * y + y) AS ridge FROM straight GROUP BY 1), three AS (SELECT horizon, sum(n * q * q - 2 * q * y + y) AS monotone FROM mono GROUP BY 1)
    SELECT horizon::INTEGER AS horizon, n::BIGINT AS n, {r('raw / n')} AS raw, {r('ridge / n')} AS ridge, {r('monotone / n')} AS monotone FROM one JOIN two USING (horizon) JOIN three USING (horizon)"""
)
def crossfitted_recalibration(spark, sf_dir):
    """Whether a ridge line or a monotone map fitted on three quarters of the dates helps on the fourth."""
    return crossfit.crossfitted(scored(spark, sf_dir), "horizon", "forecast_date")


# ---- chance alone: the same forecasts with outcomes drawn by the forecasts themselves

FLOOR_RUNS = 200
_KEY = "series_id || ':' || composition || ':' || horizon || ':' || forecast_date"
_DRAWN = f"drawn9 AS MATERIALIZED (SELECT run, horizon, predicted AS p, ln(least(greatest(predicted, {calibration.LOW}), {calibration.HIGH}) / (1 - least(greatest(predicted, {calibration.LOW}), {calibration.HIGH}))) AS x, bin, (('0x' || substr(md5('floor:' || run || ':' || {_KEY}), 1, 8))::BIGINT / 4294967296.0::DOUBLE < predicted)::INTEGER::DOUBLE AS y FROM scored, range({FLOOR_RUNS}) q(run))"


def drawn_outcomes(rows: DataFrame, runs: int = FLOOR_RUNS) -> DataFrame:
    """(horizon, run, predicted, realised): each resolved forecast with outcomes that come true by its own chance."""
    key = F.concat_ws(":", F.lit("floor"), F.col("run").cast("string"), "series_id", "composition", F.col("horizon").cast("string"), F.col("forecast_date").cast("string"))
    draw = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / 4294967296.0
    each = rows.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    return each.select("horizon", "run", "predicted", (draw < F.col("predicted")).cast("double").alias("realised"))


@query(
    W + f""", {_DRAWN}, ece9 AS (SELECT horizon, run, sum(n * abs(p - y)) / sum(n) AS ece FROM (SELECT horizon, run, bin, count(*) AS n, avg(p) AS p, avg(y) AS y FROM drawn9 GROUP BY 1, 2, 3) GROUP BY 1, 2),
    own9 AS (SELECT horizon, sum(n * abs(p - y)) / sum(n) AS ece FROM (SELECT horizon, bin, count(*) AS n, avg(predicted) AS p, avg(realised) AS y FROM scored GROUP BY 1, 2) GROUP BY 1)
    SELECT e.horizon::INTEGER AS horizon, count(*) AS runs, {r('any_value(o.ece)')} AS calibration_error, {r('avg(e.ece)')} AS mean_floor, {r('quantile_cont(e.ece, 0.95)')} AS high_floor, any_value(o.ece) > quantile_cont(e.ece, 0.95) AS beyond_chance FROM ece9 e JOIN own9 o ON o.horizon = e.horizon GROUP BY e.horizon"""
)
def calibration_noise_floor(spark, sf_dir):
    """The calibration error that these forecasts would show by chance if they were right, against what they show."""
    rows = scored(spark, sf_dir)
    each = scoring.calibration_error(drawn_outcomes(rows), ["horizon", "run"]).groupBy("horizon").agg(F.count("*").alias("runs"), F.avg("calibration_error").alias("mean_floor"), F.percentile("calibration_error", F.lit(0.95)).alias("high_floor"))
    own = scoring.calibration_error(rows, ["horizon"])
    return each.join(own, "horizon").select("horizon", "runs", "calibration_error", "mean_floor", "high_floor", (F.col("calibration_error") > F.col("high_floor")).alias("beyond_chance"))


def accepted_shares(rows: DataFrame, runs: int = FLOOR_RUNS, batch: int = 50, width: float = 1.96) -> DataFrame:
    """(horizon, runs, fitted, mean_slope, accepted): how often a slope's interval holds 1 if forecasts are right.  A group is
    one horizon's forecasts and a batch of runs, fitted side by side."""
    names = F.concat_ws(":", "series_id", "composition", F.col("horizon").cast("string"), F.col("forecast_date").cast("string"))
    spread = rows.select("horizon", names.alias("name"), "predicted").withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit((runs - 1) // batch))))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("name")
        p, drawn = rows["predicted"].to_numpy(), range(key[1] * batch, min(runs, (key[1] + 1) * batch))
        c = np.clip(p, calibration.LOW, calibration.HIGH)
        x = np.log(c / (1 - c))
        y = np.array([[int(hashlib.md5(f"floor:{i}:{n}".encode()).hexdigest()[:8], 16) / 4294967296.0 for n in rows["name"]] for i in drawn]) < p
        lines = calibration.logistic_lines(x, y.astype(float), np.ones((len(drawn), len(x))))
        q = 1 / (1 + np.exp(-(lines[:, :1] + lines[:, 1:] * x)))
        d = q * (1 - q)
        a, b, e = d.sum(axis=1), d @ x, d @ (x * x)
        error = np.sqrt(a / (a * e - b * b))
        return pd.DataFrame({"horizon": key[0], "slope": lines[:, 1], "accepted": np.where(np.isnan(lines[:, 1]), np.nan, np.abs(lines[:, 1] - 1) <= width * error)})

    each = spread.groupBy("horizon", "batch").applyInPandas(run, "horizon int, slope double, accepted double")
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    return each.groupBy("horizon").agg(F.count("*").alias("runs"), F.count(known("slope")).alias("fitted"), F.avg(known("slope")).alias("mean_slope"), F.avg(known("accepted")).alias("accepted"))


def _lines_sql(steps: int = 14) -> str:
    ctes = ["line0 AS (SELECT DISTINCT horizon, run, 0::DOUBLE AS a, 1::DOUBLE AS b FROM drawn9)"]
    for i in range(steps):
        sums = f"SELECT f.horizon, f.run, any_value(a) AS a, any_value(b) AS b, sum(q * (1 - q)) AS h, sum(q * (1 - q) * x) AS i, sum(q * (1 - q) * x * x) AS j, sum(y - q) AS g, sum((y - q) * x) AS k FROM (SELECT d.*, a, b, 1 / (1 + exp(-(a + b * x))) AS q FROM drawn9 d JOIN line{i} USING (horizon, run)) f GROUP BY 1, 2"
        ctes.append(f"line{i + 1} AS MATERIALIZED (SELECT horizon, run, a + (j * g - i * k) / (h * j - i * i) AS a, b + (h * k - i * g) / (h * j - i * i) AS b FROM ({sums}))")
    return ", ".join(ctes) + f", told9 AS (SELECT horizon, run, any_value(b) AS slope, sqrt(sum(q * (1 - q)) / (sum(q * (1 - q)) * sum(q * (1 - q) * x * x) - pow(sum(q * (1 - q) * x), 2))) AS error FROM (SELECT d.*, a, b, 1 / (1 + exp(-(a + b * x))) AS q FROM drawn9 d JOIN line{steps} USING (horizon, run)) GROUP BY 1, 2)"


@query(W + f", {_DRAWN}, {_lines_sql()} SELECT horizon::INTEGER AS horizon, count(*) AS runs, count(slope) AS fitted, {r('avg(slope)')} AS mean_slope, {r('avg((abs(slope - 1) <= 1.96 * error)::INTEGER)')} AS accepted FROM told9 GROUP BY 1")
def recalibration_test_size(spark, sf_dir):
    """How often the recalibration test accepts forecasts that are right, on the forecasts' own chances."""
    return accepted_shares(scored(spark, sf_dir))


# ---- quarters as the months that know them

QUARTER_LAG, LEADS, FIXED = 30, [1, 2, 3, 4], (-0.1, -0.3)


def surveys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, month, lead, known_quarter, known_share, z, probit, outcome): at each month what was known of the quarters'
    falls and of the monthly price, the chance of a fall some quarters on by a probit with fixed coefficients, and
    what came.  The table's last quarter, which may be cut, is left out."""
    orders = tables.table(spark, sf_dir, "orders")
    sums = stored(orders.groupBy(F.col("o_orderpriority").alias("series_id"), mixed.quarter_of("o_orderdate").cast("date").alias("quarter")).agg(F.sum("o_totalprice").alias("value")), "quarters")
    last = sums.agg(F.max("quarter")).first()[0]  # of the stored quarters
    quarters = mixed.falls(sums.where(F.col("quarter") < F.lit(last)), QUARTER_LAG)
    months = grid(spark, sf_dir)
    known = mixed.carried(months.select("series_id", "month"), quarters.where(F.col("fell").isNotNull()), "told", ["quarter", "known_share"])
    z = transforms.expanding_scores(months, least=12).select("series_id", F.col("month").alias("observed"), F.date_add("month", wf.LAG_DAYS).alias("told"), "z").where(F.col("z").isNotNull())
    state = mixed.carried(months.select("series_id", "month"), z, "told", ["z"])
    rows = known.join(state, ["series_id", "month"]).where(F.col("known_share").isNotNull() & F.col("z").isNotNull())
    rows = rows.withColumn("lead", F.explode(F.array(*map(F.lit, LEADS)))).withColumn("target", F.add_months(mixed.quarter_of("month"), 3 * F.col("lead")).cast("date"))
    came = quarters.select("series_id", F.col("quarter").alias("target"), F.col("fell").alias("outcome"))
    probit = pr.normal_share(FIXED[0] + FIXED[1] * F.col("z"))
    return rows.join(came, ["series_id", "target"], "left").select("series_id", "month", "lead", F.col("quarter").alias("known_quarter"), "known_share", "z", probit.alias("probit"), "outcome")


def _share(x: str) -> str:
    """A normal distribution's share below x for DuckDB: the same series, written out."""
    z, terms, odd = f"least(greatest({x}, -6.5), 6.5)", [], 1.0
    for k in range(81):
        odd *= 2 * k + 1
        terms.append(f"pow(zz_, {2 * k + 1}) / {odd!r}::DOUBLE")
    return f"(SELECT 0.5 + ({' + '.join(terms)}) * exp(-0.5 * zz_ * zz_) / sqrt(2 * pi()) FROM (SELECT {z} AS zz_))"


_SURVEYS = f"""qs AS (SELECT o_orderpriority AS series_id, date_trunc('quarter', o_orderdate)::DATE AS quarter, sum(o_totalprice) AS value FROM orders WHERE o_orderdate < (SELECT date_trunc('quarter', max(o_orderdate)) FROM orders) GROUP BY 1, 2),
qf AS (SELECT series_id, quarter, CASE WHEN lag(quarter) OVER w = (quarter - INTERVAL 3 MONTH)::DATE THEN (value < lag(value) OVER w)::INTEGER::DOUBLE END AS fell, (quarter + INTERVAL 3 MONTH)::DATE + {QUARTER_LAG} AS told FROM qs WINDOW w AS (PARTITION BY series_id ORDER BY quarter)),
qk AS (SELECT *, avg(fell) OVER (PARTITION BY series_id ORDER BY quarter ROWS UNBOUNDED PRECEDING) AS known_share FROM qf),
mz AS (SELECT series_id, month, CASE WHEN count(value) OVER w >= 12 AND stddev_samp(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_samp(value) OVER w END AS z FROM grid WINDOW w AS (PARTITION BY series_id ORDER BY month ROWS UNBOUNDED PRECEDING)),
kq AS (SELECT g.series_id, g.month, max_by(q.quarter, q.told) AS known_quarter, max_by(q.known_share, q.told) AS known_share FROM grid g JOIN qk q ON q.series_id = g.series_id AND q.fell IS NOT NULL AND q.told <= g.month GROUP BY 1, 2),
kz AS (SELECT g.series_id, g.month, max_by(m.z, m.month) AS z FROM grid g JOIN mz m ON m.series_id = g.series_id AND m.z IS NOT NULL AND m.month + {wf.LAG_DAYS} <= g.month GROUP BY 1, 2),
sv8 AS MATERIALIZED (SELECT k.series_id, k.month, lead, known_quarter, known_share, z, {FIXED[0]} + {FIXED[1]} * z AS score, q.fell AS outcome FROM kq k JOIN kz USING (series_id, month) CROSS JOIN (SELECT unnest({LEADS}) AS lead) LEFT JOIN qf q ON q.series_id = k.series_id AND q.quarter = (date_trunc('quarter', k.month) + to_months(3 * lead))::DATE),
sv AS MATERIALIZED (SELECT *, {_share('score')} AS probit FROM sv8)"""


@query(W + f", {_SURVEYS.replace('sv AS MATER', 'svp AS MATER')} SELECT series_id, month, lead::INTEGER AS lead, known_quarter, {r('known_share')} AS known_share, {r('z')} AS z, {r('probit')} AS probit, outcome FROM svp")
def quarterly_surveys(spark, sf_dir):
    return surveys(spark, sf_dir)


_BENCH_KEYS = ("series_id", "lead")


def benchmark_scores(rows: DataFrame, resamples: int = RESAMPLES) -> DataFrame:
    """(series_id, lead, n, base_rate, brier, reference_brier, skill, lower, upper) of each series alone, drawn in blocks of as
    many months as the lead has."""
    known = rows.where(F.col("outcome").isNotNull()).select(*_BENCH_KEYS, F.col("month").alias("forecast_date"), F.lit("one").alias("unit"), F.col("outcome").alias("y"), scoring.squared("probit", "outcome").alias("e"), scoring.squared("known_share", "outcome").alias("f"))
    known = stored(known, "known")
    points = known.groupBy(*_BENCH_KEYS).agg(F.count("*").alias("n"), F.avg("y").alias("base_rate"), F.avg("e").alias("brier"), F.avg("f").alias("reference_brier"), (1 - F.sum("e") / F.nullif(F.sum("f"), F.lit(0.0))).alias("skill"))
    block: Column = 3 * F.col("lead")
    ends = bootstrap.interval(bootstrap.mean_ratios(known, list(_BENCH_KEYS), "forecast_date", "unit", {"skill": ("e", "f")}, block, resamples), list(_BENCH_KEYS), F.col("skill"), resamples=resamples)
    return points.join(ends.drop("usable"), list(_BENCH_KEYS), "left")


@query(
    W + f""", {_SURVEYS.replace('sv AS MATER', 'svp AS MATER')}, known8 AS MATERIALIZED (SELECT series_id, lead, month AS forecast_date, 'one' AS unit, outcome AS y, pow(probit - outcome, 2) AS e, pow(known_share - outcome, 2) AS f FROM svp WHERE outcome IS NOT NULL),
    {draws('known8', 'b8', '3 * lead', keys=_BENCH_KEYS, ratios={'skill': ('e', 'f')})}, pts8 AS (SELECT series_id, lead, count(*) AS n, avg(y) AS base_rate, avg(e) AS brier, avg(f) AS reference_brier, 1 - sum(e) / nullif(sum(f), 0) AS skill FROM known8 GROUP BY 1, 2),
    ends8 AS (SELECT series_id, lead, count(skill) AS usable, quantile_cont(skill, 0.05) AS lower, quantile_cont(skill, 0.95) AS upper FROM b8samples GROUP BY 1, 2)
    SELECT p.series_id, p.lead::INTEGER AS lead, n, {r('base_rate')} AS base_rate, {r('brier')} AS brier, {r('reference_brier')} AS reference_brier, {r('p.skill')} AS skill, CASE WHEN usable >= {LEAST_USABLE} THEN {r('lower')} END AS lower, CASE WHEN usable >= {LEAST_USABLE} THEN {r('upper')} END AS upper FROM pts8 p JOIN ends8 e ON e.series_id = p.series_id AND e.lead = p.lead"""
)
def quarterly_benchmarks(spark, sf_dir):
    """The fixed probit against the share of falls known at the time, for each series and lead."""
    return benchmark_scores(surveys(spark, sf_dir))
