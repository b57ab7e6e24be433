"""Intervals, and the rules that let a model through: two sets of gates, and skill at every horizon.

A query computes the resolved forecasts once (`scored`, stored); the gates below read those few rows.
Dates are drawn in blocks as long as the horizon.  `RESAMPLES` draws are taken.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import bootstrap, calibration, scoring
from ..operators import outcomes as oc
from ..sources import records
from ..sources.scratch import stored
from . import walkforward as wf
from .library import W, grid, query, r, resolved, scored, with_horizons

RESAMPLES = 10_000
SEED = bootstrap.SEED
#: So many of the resamples must have a mean for an interval.
LEAST_USABLE = max(20, RESAMPLES // 100)
#: The rules are a document beside this module: the least mean skill, the most calibration error, the least distance, the
#: sub-periods and how many of them must be above zero; of the skill curve the shortest block and the fewest
#: independent observations that tell anything.
RULES = records.rule_file(str(Path(__file__).with_name("rules.json")))
LEAST_SKILL, MOST_ERROR, LEAST_DISTANCE, PERIODS, GOOD_PERIODS = (RULES["rule_0001"][n] for n in ("least_skill", "most_calibration_error", "least_distance", "periods", "good_periods"))
SHORTEST_BLOCK, LEAST_INDEPENDENT = (RULES["skill_curve"][n] for n in ("shortest_block", "least_independent"))


def unit() -> Column:
    """An indicator: a series and how its question is put."""
    return F.concat("series_id", "composition").alias("unit")



def cells(rows: DataFrame) -> DataFrame:
    """A row for each horizon, date and indicator: squared errors of the model (e), reference (f) and chain (g)."""
    return rows.select("horizon", "forecast_date", unit(), scoring.squared("predicted").alias("e"), scoring.squared("reference").alias("f"), scoring.squared("chain").alias("g"), F.col("realised").alias("y"), F.lit(1.0).alias("n")).where("e IS NOT NULL AND f IS NOT NULL")


def _defined(n: Column, y: Column, f: Column) -> Column:
    """A skill is defined where the outcome varies and the reference errs."""
    return (n >= 2) & (y > 0.5) & (y < n - 0.5) & (f > 1e-12)


def scoreable(found: DataFrame) -> DataFrame:
    """(horizon, unit): the indicators whose skill is defined on all dates, which all resamples must score."""
    n, y, f = F.sum("n"), F.sum("y"), F.sum("f")
    return found.groupBy("horizon", "unit").agg(n.alias("n"), y.alias("y"), f.alias("f")).where(_defined(F.col("n"), F.col("y"), F.col("f"))).select("horizon", "unit")


def mean_skills(sums: DataFrame, units: DataFrame, by: list[str], whole: bool = True) -> DataFrame:
    """(by, skill, chain_skill): means over the fixed set of indicators; with `whole` null unless all are defined."""
    k = units.groupBy("horizon").agg(F.count("*").alias("k"))
    ok = _defined(F.col("n"), F.col("y"), F.col("f"))
    out = sums.join(units, ["horizon", "unit"], "left_semi").groupBy(*by).agg(
        F.count(F.when(ok, 1)).alias("d"), F.avg(F.when(ok, 1 - F.col("e") / F.col("f"))).alias("skill"), F.avg(F.when(ok, 1 - F.col("g") / F.col("f"))).alias("chain_skill")
    )
    full = F.col("d") == F.col("k") if whole else F.col("d") > 0
    return out.join(k, "horizon").select(*by, *(F.when(full, F.col(c)).alias(c) for c in ("skill", "chain_skill")))


def sums_of(found: DataFrame, by: list[str]) -> DataFrame:
    return found.groupBy(*by, "unit").agg(*(F.sum(c).alias(c) for c in "efgyn"))


RATIOS = {"skill": ("e", "f"), "chain_skill": ("g", "f")}


def samples(found: DataFrame, block: Column | None = None, resamples: int = RESAMPLES, keys: tuple[str, ...] = ("horizon",), ratios: dict[str, tuple[str, str]] = RATIOS) -> DataFrame:
    """(keys, resample, skill, chain_skill) of each resample."""
    return bootstrap.mean_ratios(found, list(keys), "forecast_date", "unit", ratios, F.col("horizon") if block is None else block, resamples)


CELLS = "cells AS (SELECT horizon, forecast_date, series_id || composition AS unit, e, f, (chain - realised) * (chain - realised) AS g, realised AS y FROM scored WHERE e IS NOT NULL AND f IS NOT NULL)"
_OK = "n >= 2 AND y > 0.5 AND y < n - 0.5 AND f > 1e-12"


def draws(cells: str, p: str = "", block: str = "horizon", resamples: int = RESAMPLES, keys: tuple[str, ...] = ("horizon",), ratios: dict[str, tuple[str, str]] = RATIOS) -> str:
    """CTEs for DuckDB over `cells`: `placed`, `drawn`, `parts`, `ranges`, `fixed` and `samples`, their names after `p`.  A block's
    sum is a difference of running sums, as in :mod:`..operators.bootstrap`."""
    columns = sorted({c for pair in ratios.values() for c in pair})
    k, on = ", ".join(keys), lambda a, b: " AND ".join(f"{a}.{x} = {b}.{x}" for x in keys)
    ok = lambda den: f"n >= 2 AND y > 0.5 AND y < n - 0.5 AND {den} > 1e-12"
    told = ", ".join(f"CASE WHEN count(*) FILTER (is_{n}) > 0 AND count(*) FILTER (is_{n} AND {ok(b)}) = count(*) FILTER (is_{n}) THEN avg(1 - {a} / {b}) FILTER (is_{n}) END AS {n}" for n, (a, b) in ratios.items())
    return f"""{p}placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY forecast_date) AS pos, count(*) OVER (PARTITION BY {k}) AS n FROM (SELECT DISTINCT {k}, forecast_date FROM {cells})),
{p}drawn AS (SELECT {k}, n, least({block}, n) AS len, unnest(range({resamples})) AS rs FROM (SELECT DISTINCT {k}, n FROM {p}placed)),
{p}parts AS (SELECT *, unnest(range(ceil(n / len::DOUBLE)::BIGINT)) AS k FROM {p}drawn),
{p}ranges AS (SELECT {k}, rs, ('0x' || substr(md5(concat_ws(':', {SEED}, {k}, rs, k)), 1, 8))::BIGINT % (n - len + 1) AS a, least(len, n - k * len) AS size FROM {p}parts),
{p}own AS (SELECT {k}, unit, count(*) AS n, sum(y) AS y, {', '.join(f'sum({c}) AS {c}' for c in columns)} FROM {cells} GROUP BY {k}, unit),
{p}fixed AS MATERIALIZED (SELECT {k}, unit, {', '.join(f'{ok(b)} AS is_{n}' for n, (_, b) in ratios.items())} FROM {p}own),
{p}cum AS MATERIALIZED (SELECT {', '.join(f'g.{x}' for x in keys)}, g.unit, g.pos, count(c.y) OVER w AS n, sum(coalesce(c.y, 0)) OVER w AS y, {', '.join(f'sum(coalesce(c.{x}, 0)) OVER w AS {x}' for x in columns)}
    FROM (SELECT {', '.join(f'o.{x}' for x in keys)}, o.unit, q.pos, q.forecast_date FROM {p}own o JOIN {p}placed q ON {on('o', 'q')} UNION ALL SELECT {k}, unit, 0, NULL FROM {p}own) g LEFT JOIN {cells} c ON {on('c', 'g')} AND c.unit = g.unit AND c.forecast_date = g.forecast_date
    WINDOW w AS (PARTITION BY {', '.join(f'g.{x}' for x in keys)}, g.unit ORDER BY g.pos)),
{p}per AS (SELECT {', '.join(f'r.{x}' for x in keys)}, r.rs, b.unit, sum(b.n - a.n) AS n, sum(b.y - a.y) AS y, {', '.join(f'sum(b.{x} - a.{x}) AS {x}' for x in columns)} FROM {p}ranges r JOIN {p}cum a ON {on('a', 'r')} AND a.pos = r.a JOIN {p}cum b ON {on('b', 'r')} AND b.unit = a.unit AND b.pos = r.a + r.size GROUP BY {', '.join(f'r.{x}' for x in keys)}, r.rs, b.unit),
{p}samples AS MATERIALIZED (SELECT {', '.join(f'd.{x}' for x in keys)}, rs, {told} FROM {p}per d JOIN {p}fixed x ON {on('x', 'd')} AND x.unit = d.unit GROUP BY {', '.join(f'd.{x}' for x in keys)}, rs)"""


def boot(block: str = "horizon", resamples: int = RESAMPLES) -> str:
    """CTEs for DuckDB: `samples` as above, over the scored forecasts."""
    return f"""{CELLS}, {draws('cells', block=block, resamples=resamples)},
units AS (SELECT horizon, unit FROM fixed WHERE is_skill),
wanted AS (SELECT horizon, count(*) AS k FROM units GROUP BY 1)"""


BOOT = boot()
MEANS = f"""means AS (SELECT s.horizon, CASE WHEN count(*) = any_value(k) THEN avg(1 - e / f) END AS mean_skill, CASE WHEN count(*) = any_value(k) THEN avg(1 - g / f) END AS chain_skill FROM (SELECT horizon, unit, sum(e) AS e, sum(f) AS f, sum(g) AS g FROM cells GROUP BY 1, 2) s JOIN units u ON u.horizon = s.horizon AND u.unit = s.unit JOIN wanted w ON w.horizon = s.horizon GROUP BY 1)"""
LEAD = "skill - chain_skill"


@query(W + f", {BOOT} SELECT horizon::INTEGER AS horizon, count(skill) AS usable, {r('quantile_cont(skill, 0.05)')} AS lower, {r('quantile_cont(skill, 0.95)')} AS upper FROM samples GROUP BY horizon")
def block_bootstrap_interval(spark, sf_dir):
    """90 % intervals of the mean skill over the fixed set of indicators."""
    return bootstrap.interval(samples(cells(scored(spark, sf_dir))), ["horizon"], F.col("skill"), resamples=RESAMPLES)


@query(W + f", {BOOT} SELECT horizon::INTEGER AS horizon, count({LEAD}) AS usable, {r(f'quantile_cont({LEAD}, 0.05)')} AS lower, {r(f'quantile_cont({LEAD}, 0.95)')} AS upper FROM samples GROUP BY horizon")
def paired_skill_difference(spark, sf_dir):
    """The blend's mean skill less the chain's, on the same draws."""
    return bootstrap.interval(samples(cells(scored(spark, sf_dir))), ["horizon"], F.expr(LEAD), resamples=RESAMPLES)


@query(W + f", {BOOT} SELECT count(*) AS resamples, count(DISTINCT digest) AS distinct_ FROM (SELECT rs, string_agg(a::VARCHAR, ',' ORDER BY k) AS digest FROM (SELECT rs, k, ('0x' || substr(md5(concat_ws(':', {SEED}, horizon, rs, k)), 1, 8))::BIGINT % (n - len + 1) AS a FROM parts WHERE horizon = 3) GROUP BY rs)")
def distinct_resamples(spark, sf_dir):
    """How many of the draws of one horizon differ: all, where there are many more ways to draw than draws."""
    n = cells(scored(spark, sf_dir)).where("horizon = 3").select("forecast_date").distinct().agg(F.count("*").alias("n"))
    length = F.least(F.lit(3), F.col("n"))
    parts = n.withColumn("rs", F.explode(F.sequence(F.lit(0), F.lit(RESAMPLES - 1)))).withColumn("k", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / length) - 1).cast("int"))))
    starts = parts.withColumn("a", bootstrap.start_of(F.col("n") - length + 1, F.lit(SEED), F.lit(3), F.col("rs"), F.col("k")))
    return starts.groupBy("rs").agg(F.array_sort(F.collect_list(F.struct("k", "a"))).alias("draw")).agg(F.count("*").alias("resamples"), F.count_distinct("draw").alias("distinct_"))


# ---- rule one

_GATES = f""", {BOOT}, {MEANS},
pooled AS (SELECT horizon, 1 - sum(e) / nullif(sum(f), 0) AS pooled_skill FROM cells GROUP BY 1),
bounds AS (SELECT horizon, quantile_cont(skill, 0.05) AS lower, quantile_cont({LEAD}, 0.95) AS lead_upper FROM samples GROUP BY 1),
allbins AS (SELECT horizon, bin, count(*) AS n, avg(predicted) AS p, avg(realised) AS y FROM scored GROUP BY 1, 2),
calib AS (SELECT horizon, sum(n * abs(p - y)) / sum(n) AS ece FROM allbins GROUP BY 1),
errs AS (SELECT horizon, forecast_date, series_id || composition AS unit, realised - predicted AS v FROM scored),
complete AS (SELECT horizon, forecast_date FROM errs GROUP BY 1, 2 HAVING count(DISTINCT unit) = (SELECT count(DISTINCT unit) FROM errs o WHERE o.horizon = errs.horizon)),
full_ AS (SELECT e.* FROM errs e JOIN complete c ON c.horizon = e.horizon AND c.forecast_date = e.forecast_date),
varied AS (SELECT horizon, unit FROM full_ GROUP BY 1, 2 HAVING stddev_pop(v) > 1e-12),
kept_ AS (SELECT f.* FROM full_ f JOIN varied v ON v.horizon = f.horizon AND v.unit = f.unit),
corrs AS (SELECT horizon, avg(c) AS c FROM (SELECT a.horizon, a.unit AS u, b.unit AS w, corr(a.v, b.v) AS c FROM kept_ a JOIN kept_ b ON a.horizon = b.horizon AND a.forecast_date = b.forecast_date AND a.unit < b.unit GROUP BY 1, 2, 3) GROUP BY 1),
effect AS (SELECT v.horizon, greatest(1, 1 + (count(*) - 1) * coalesce(any_value(c), 0)) AS deff FROM varied v LEFT JOIN corrs c ON c.horizon = v.horizon GROUP BY 1),
worth AS (SELECT b.*, sqrt(y * (1 - y) / greatest(n / (b.horizon * coalesce(deff, 1)), 1)) AS se FROM allbins b LEFT JOIN effect e ON e.horizon = b.horizon),
falls AS (SELECT a.horizon, sum((b.y < a.y - 2 * sqrt(a.se * a.se + b.se * b.se))::INTEGER) AS reversals FROM worth a JOIN worth b ON a.horizon = b.horizon AND a.bin < b.bin GROUP BY 1),
blk AS (SELECT horizon, sum((s > 0)::INTEGER) AS good FROM (SELECT x.horizon, x.block, avg(1 - e / f) FILTER ({_OK}) AS s FROM (SELECT c.horizon, b.block, c.unit, sum(e) AS e, sum(f) AS f, sum(y) AS y, count(*) AS n FROM cells c JOIN (SELECT *, ntile({PERIODS}) OVER (PARTITION BY horizon ORDER BY forecast_date) AS block FROM (SELECT DISTINCT horizon, forecast_date FROM cells)) b ON b.horizon = c.horizon AND b.forecast_date = c.forecast_date JOIN units u ON u.horizon = c.horizon AND u.unit = c.unit GROUP BY 1, 2, 3) x GROUP BY 1, 2) GROUP BY 1),
far AS (SELECT horizon, avg(distance) AS distance FROM fore GROUP BY 1),
seq AS (SELECT series_id, holds AS y, lag(holds) OVER (PARTITION BY series_id ORDER BY month) AS y1 FROM grid WHERE holds IS NOT NULL),
regime AS (SELECT sum(gain) > 0 AS regimes_gate FROM (SELECT series_id, 2 * (sum(y * ln(q1) + (1 - y) * ln(1 - q1)) - sum(y * ln(q0) + (1 - y) * ln(1 - q0))) - ln(count(*)) AS gain FROM (SELECT *, (sum(y) OVER a + 0.5) / (count(*) OVER a + 1) AS q1, (sum(y) OVER b + 0.5) / (count(*) OVER b + 1) AS q0 FROM seq WHERE y1 IS NOT NULL WINDOW a AS (PARTITION BY series_id, y1), b AS (PARTITION BY series_id)) GROUP BY 1)),
gates AS (SELECT m.horizon, mean_skill, pooled_skill, lower, ece, distance, lead_upper, regimes_gate, coalesce(mean_skill > {LEAST_SKILL} AND lower > 0, false) AS skill_gate, coalesce(ece < {MOST_ERROR} AND coalesce(reversals, 0) = 0, false) AS calibration_gate, coalesce(good >= {GOOD_PERIODS}, false) AS robustness_gate, coalesce(distance > {LEAST_DISTANCE}, false) AS honesty_gate
    FROM means m JOIN pooled USING (horizon) JOIN bounds USING (horizon) JOIN calib USING (horizon) LEFT JOIN falls USING (horizon) JOIN blk USING (horizon) JOIN far USING (horizon) CROSS JOIN regime)"""
NAMES = ("regimes", "skill", "calibration", "robustness", "honesty")
_ALL = " AND ".join(f"{n}_gate" for n in NAMES)


def regimes_exist(conditions: DataFrame) -> DataFrame:
    """(regimes_gate): whether two states of a condition tell the next month better than one, by the information
    criterion, over all series.  The states of this model are the condition's own."""
    w = oc.Window.partitionBy("series_id").orderBy("month")
    rows = conditions.where(F.col("holds").isNotNull()).select("series_id", F.col("holds").alias("y"), F.lag("holds").over(w).alias("y1")).where(F.col("y1").isNotNull())
    counts = rows.groupBy("series_id", "y1").agg(F.sum("y").alias("s1"), F.count("*").alias("n1"))  # at most two rows a series
    one = oc.Window.partitionBy("series_id")
    counts = counts.withColumn("q0", (F.sum("s1").over(one) + 0.5) / (F.sum("n1").over(one) + 1)).withColumn("q1", (F.col("s1") + 0.5) / (F.col("n1") + 1))

    def likelihood(q: str) -> Column:
        return F.sum(F.col("s1") * F.ln(q) + (F.col("n1") - F.col("s1")) * F.ln(1 - F.col(q)))

    gain = counts.groupBy("series_id").agg((2 * (likelihood("q1") - likelihood("q0")) - F.ln(F.sum("n1"))).alias("gain"))
    return gain.agg((F.sum("gain") > 0).alias("regimes_gate"))


def monotone(rows: DataFrame) -> DataFrame:
    """(horizon, reversals), with errors widened for months that overlap and indicators that move together."""
    errors = rows.select("horizon", "forecast_date", unit(), (F.col("realised") - F.col("predicted")).alias("v"))
    effect = scoring.design_effect(errors, ["horizon"], "unit", "forecast_date", "v")
    inflation = rows.select("horizon").distinct().join(effect, "horizon", "left").select("horizon", (F.col("horizon") * F.coalesce("design_effect", F.lit(1.0))).alias("inflation"))
    return scoring.reversals(rows, ["horizon"], inflation=inflation)


def good_periods(found: DataFrame) -> DataFrame:
    """(horizon, good): in how many of four chronological blocks the mean skill of those defined there is above zero."""
    blocks = scoring.chronological_blocks(found, ["horizon"], "forecast_date", PERIODS)
    each = mean_skills(sums_of(blocks, ["horizon", "block"]), scoreable(found), ["horizon", "block"], whole=False)
    return each.groupBy("horizon").agg(F.sum((F.col("skill") > 0).cast("int")).alias("good"))


def gates(conditions: DataFrame, forecasts: DataFrame, exist: DataFrame | None = None) -> DataFrame:
    """A row for each horizon with what the rules read, and the five gates of rule one.  Whether there are regimes (one row,
    `regimes_gate`) is read from the conditions unless a sweep of models said it."""
    rows = resolved(forecasts)
    found = cells(rows)
    ends = samples(found).groupBy("horizon").agg(F.percentile("skill", F.lit(0.05)).alias("lower"), F.percentile(F.expr(LEAD), F.lit(0.95)).alias("lead_upper"))
    means = mean_skills(sums_of(found, ["horizon"]), scoreable(found), ["horizon"]).select("horizon", F.col("skill").alias("mean_skill"))
    pooled = found.groupBy("horizon").agg((1 - F.sum("e") / F.nullif(F.sum("f"), F.lit(0.0))).alias("pooled_skill"))
    error = scoring.calibration_error(rows, ["horizon"]).withColumnRenamed("calibration_error", "ece")
    far = forecasts.groupBy("horizon").agg(F.avg("distance").alias("distance"))
    joined = means.join(pooled, "horizon").join(ends, "horizon").join(error, "horizon").join(monotone(rows), "horizon", "left").join(good_periods(found), "horizon").join(far, "horizon")
    joined = joined.crossJoin(F.broadcast(regimes_exist(conditions) if exist is None else exist))  # one row
    marks = {
        "skill_gate": (F.col("mean_skill") > LEAST_SKILL) & (F.col("lower") > 0),
        "calibration_gate": (F.col("ece") < MOST_ERROR) & (F.coalesce("reversals", F.lit(0)) == 0),
        "robustness_gate": F.col("good") >= GOOD_PERIODS,
        "honesty_gate": F.col("distance") > LEAST_DISTANCE,
    }
    return joined.select("horizon", "mean_skill", "pooled_skill", "lower", "ece", "distance", "lead_upper", "regimes_gate", *(F.coalesce(c, F.lit(False)).alias(n) for n, c in marks.items()))


def walked(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Conditions and forecasts, from one pass over the raw rows; the forecasts are written once."""
    conditions = grid(spark, sf_dir)
    return conditions, stored(wf.forecasts_from(conditions), "forecasts")


def passed(names: tuple[str, ...] = NAMES) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"{n}_gate")
    return out


def failing(names: tuple[str, ...]) -> Column:
    return F.when(passed(names), "none").otherwise(F.concat_ws(", ", *(F.when(~F.col(f"{n}_gate"), n) for n in names)))


def _failing(names: tuple[str, ...]) -> str:
    return f"CASE WHEN {' AND '.join(f'{n}_gate' for n in names)} THEN 'none' ELSE concat_ws(', ', {', '.join(f'''CASE WHEN NOT {n}_gate THEN '{n}' END''' for n in names)}) END"


@query(W + _GATES + f"SELECT horizon::INTEGER AS horizon, {r('mean_skill')} AS mean_skill, {r('lower')} AS lower, {r('ece')} AS ece, {r('distance')} AS distance, {', '.join(f'{n}_gate' for n in NAMES)}, CASE WHEN {_ALL} THEN 'SHIP MODEL' ELSE 'SHIP BASE RATE' END AS verdict, {_failing(NAMES)} AS failing_gates FROM gates")
def verdict_gates(spark, sf_dir):
    """Rule one: the model ships at a horizon if all five gates hold."""
    g = gates(*walked(spark, sf_dir)).select("horizon", "mean_skill", "lower", "ece", "distance", *(f"{n}_gate" for n in NAMES))
    return g.withColumn("verdict", F.when(passed(), "SHIP MODEL").otherwise("SHIP BASE RATE")).withColumn("failing_gates", failing(NAMES))


# ---- rule two: against the climatology of the model's own sample, and against the chain

SAMPLE_MONTHS = 24


def against_sample(conditions: DataFrame, forecasts: DataFrame) -> DataFrame:
    """The resolved forecasts with the sample's climatology as their reference."""
    rows = resolved(forecasts)
    sample = oc.sample_climatology(oc.outcomes(conditions, wf.HORIZONS), wf.KEYS, wf.LAG_DAYS, SAMPLE_MONTHS).where(F.col("sample_climatology").isNotNull())
    return rows.drop("reference").join(sample.select(*wf.KEYS, F.col("month").alias("forecast_date"), F.col("sample_climatology").alias("reference")), [*wf.KEYS, "forecast_date"])


SECOND = ("skill", "robustness", "honesty", "chain")
_SAMPLE = f"""r1 AS (SELECT a.series_id, a.composition, a.horizon, a.month, avg(b.outcome) AS reference FROM found a JOIN found b ON a.series_id = b.series_id AND a.composition = b.composition AND a.horizon = b.horizon AND b.outcome IS NOT NULL
    AND (b.month + to_months(b.horizon))::DATE + {wf.LAG_DAYS} <= a.month AND b.month >= (a.month - to_months({SAMPLE_MONTHS}))::DATE GROUP BY 1, 2, 3, 4),
first_ AS (SELECT * FROM scored),
second_ AS (SELECT s.* REPLACE (q.reference AS reference, (q.reference - s.realised) * (q.reference - s.realised) AS f) FROM first_ s JOIN r1 q ON q.series_id = s.series_id AND q.composition = s.composition AND q.horizon = s.horizon AND q.month = s.forecast_date)"""


def _against_sample(sql: str) -> str:
    return sql.replace("FROM scored", "FROM second_")


@query(
    W + f", {_SAMPLE}" + _against_sample(_GATES) + f""", two AS (SELECT horizon, mean_skill, pooled_skill, lower, lead_upper, distance, coalesce(mean_skill > {LEAST_SKILL} AND lower > 0 AND sign(mean_skill) = sign(pooled_skill), false) AS skill_gate, robustness_gate, honesty_gate, coalesce(NOT lead_upper < 0, false) AS chain_gate FROM gates)
    SELECT horizon::INTEGER AS horizon, {r('mean_skill')} AS mean_skill, {r('pooled_skill')} AS pooled_skill, {r('lower')} AS lower, {r('lead_upper')} AS lead_upper, {', '.join(f'{n}_gate' for n in SECOND)}, {_failing(SECOND)} AS failing_gates FROM two"""
)
def successor_gates(spark, sf_dir):
    """Rule two but for its calibration gate (`successor_verdict` has that): skill against the sample's climatology
    with pooled skill of the same sign, robustness, honesty, and not beaten by the chain."""
    return _successor(*walked(spark, sf_dir))


def _successor(conditions: DataFrame, forecasts: DataFrame) -> DataFrame:
    rows = stored(against_sample(conditions, forecasts), "rows")
    found = cells(rows)
    ends = samples(found).groupBy("horizon").agg(F.percentile("skill", F.lit(0.05)).alias("lower"), F.percentile(F.expr(LEAD), F.lit(0.95)).alias("lead_upper"))
    means = mean_skills(sums_of(found, ["horizon"]), scoreable(found), ["horizon"]).select("horizon", F.col("skill").alias("mean_skill"))
    pooled = found.groupBy("horizon").agg((1 - F.sum("e") / F.nullif(F.sum("f"), F.lit(0.0))).alias("pooled_skill"))
    far = forecasts.groupBy("horizon").agg(F.avg("distance").alias("distance"))
    joined = means.join(pooled, "horizon").join(ends, "horizon").join(good_periods(found), "horizon").join(far, "horizon")
    marks = {
        "skill_gate": (F.col("mean_skill") > LEAST_SKILL) & (F.col("lower") > 0) & (F.signum("mean_skill") == F.signum("pooled_skill")),
        "robustness_gate": F.col("good") >= GOOD_PERIODS,
        "honesty_gate": F.col("distance") > LEAST_DISTANCE,
        "chain_gate": ~(F.col("lead_upper") < 0),
    }
    out = joined.select("horizon", "mean_skill", "pooled_skill", "lower", "lead_upper", *(F.coalesce(c, F.lit(False)).alias(n) for n, c in marks.items()))
    return out.withColumn("failing_gates", failing(SECOND))


@query()
def successor_verdict(spark, sf_dir):
    """Rule two with all five gates: calibrated where the interval of the recalibration's slope holds 1."""
    conditions, forecasts = walked(spark, sf_dir)
    slopes = calibration.slope_interval(resolved(forecasts), ["horizon"], "horizon int", "forecast_date", F.col("horizon"), resamples=RESAMPLES)
    rows = _successor(conditions, forecasts).drop("failing_gates").join(slopes.select("horizon", "slope", F.col("lower").alias("slope_lower"), F.col("upper").alias("slope_upper")), "horizon", "left")
    rows = rows.withColumn("calibration_gate", F.coalesce((F.col("slope_lower") <= 1) & (F.col("slope_upper") >= 1), F.lit(False)))
    names = ("skill", "calibration", "robustness", "honesty", "chain")
    return rows.withColumn("verdict", F.when(passed(names), "SHIP MODEL").otherwise("SHIP BASE RATE")).withColumn("failing_gates", failing(names))


# ---- skill at every horizon

LONGEST = 120
_BLOCKS = f"greatest(horizon, {SHORTEST_BLOCK})"
CURVE = with_horizons(range(1, LONGEST + 1)) + f""", {boot(_BLOCKS, RESAMPLES)}, {MEANS},
ends AS (SELECT horizon, count(skill) AS usable, quantile_cont(skill, 0.05) AS lower, quantile_cont(skill, 0.95) AS upper, quantile_cont(chain_skill, 0.05) AS chain_lower FROM samples GROUP BY 1),
curve AS (SELECT m.horizon, mean_skill, chain_skill, CASE WHEN usable >= {LEAST_USABLE} THEN lower END AS lower, CASE WHEN usable >= {LEAST_USABLE} THEN upper END AS upper, CASE WHEN usable >= {LEAST_USABLE} THEN chain_lower END AS chain_lower, n AS dates, n / least({_BLOCKS.replace('horizon', 'm.horizon')}, n)::DOUBLE AS independent FROM means m JOIN ends e ON e.horizon = m.horizon JOIN (SELECT DISTINCT horizon, n FROM placed) p ON p.horizon = m.horizon),
read AS (SELECT *, coalesce(mean_skill > {LEAST_SKILL} AND lower > 0, false) AS carries_skill, coalesce(chain_skill > {LEAST_SKILL} AND chain_lower > 0, false) AS chain_carries, independent >= {LEAST_INDEPENDENT} AS informative FROM curve)"""


def curve(spark, sf_dir) -> DataFrame:
    """(horizon, ...): mean skill of blend and chain at every horizon that resolves, with intervals."""
    found = stored(cells(scored(spark, sf_dir, list(range(1, LONGEST + 1)))), "rows")
    block = F.greatest(F.col("horizon"), F.lit(SHORTEST_BLOCK))
    n = F.count("skill")
    ends = samples(found, block, RESAMPLES).groupBy("horizon").agg(*(F.when(n >= LEAST_USABLE, F.percentile(c, F.lit(q))).alias(a) for a, c, q in (("lower", "skill", 0.05), ("upper", "skill", 0.95), ("chain_lower", "chain_skill", 0.05))))
    means = mean_skills(sums_of(found, ["horizon"]), scoreable(found), ["horizon"]).withColumnRenamed("skill", "mean_skill")
    dates = found.groupBy("horizon").agg(F.count_distinct("forecast_date").alias("dates"))
    rows = means.join(ends, "horizon").join(dates, "horizon").withColumn("independent", F.col("dates") / F.least(block, F.col("dates")))
    rows = rows.withColumn("carries_skill", F.coalesce((F.col("mean_skill") > LEAST_SKILL) & (F.col("lower") > 0), F.lit(False)))
    rows = rows.withColumn("chain_carries", F.coalesce((F.col("chain_skill") > LEAST_SKILL) & (F.col("chain_lower") > 0), F.lit(False)))
    return rows.withColumn("informative", F.col("independent") >= LEAST_INDEPENDENT)


@query(CURVE + f" SELECT horizon::INTEGER AS horizon, {r('mean_skill')} AS mean_skill, {r('chain_skill')} AS chain_skill, {r('lower')} AS lower, {r('upper')} AS upper, dates, {r('independent')} AS independent, carries_skill, chain_carries, informative FROM read")
def skill_by_horizon(spark, sf_dir):
    return curve(spark, sf_dir).select("horizon", "mean_skill", "chain_skill", "lower", "upper", "dates", "independent", "carries_skill", "chain_carries", "informative")


@query(
    CURVE + """ SELECT coalesce(max(horizon) FILTER (carries_skill), 0)::INTEGER AS last_with_skill,
    (SELECT count(*) FROM read a WHERE NOT EXISTS (SELECT 1 FROM generate_series(1, a.horizon) h(x) LEFT JOIN read b ON b.horizon = h.x AND b.carries_skill WHERE b.horizon IS NULL))::INTEGER AS unbroken_skill,
    (SELECT count(*) FROM read a WHERE NOT EXISTS (SELECT 1 FROM generate_series(1, a.horizon) h(x) LEFT JOIN read b ON b.horizon = h.x AND b.mean_skill > 0 WHERE b.horizon IS NULL))::INTEGER AS unbroken_positive,
    coalesce(max(horizon) FILTER (informative), 0)::INTEGER AS last_informative FROM read"""
)
def skill_curve_readings(spark, sf_dir):
    """The last horizon with skill, how far it reaches from one month on without a break, and the last that tells anything."""
    rows = stored(curve(spark, sf_dir), "rows")
    w = oc.Window.orderBy("horizon")  # at most `LONGEST` rows

    def unbroken(ok: Column) -> DataFrame:
        place = rows.where(ok).withColumn("place", F.row_number().over(w))
        return place.where("place = horizon").agg(F.coalesce(F.max("horizon"), F.lit(0)).alias("x"))

    last = rows.agg(F.coalesce(F.max(F.when(F.col("carries_skill"), F.col("horizon"))), F.lit(0)).alias("last_with_skill"), F.coalesce(F.max(F.when(F.col("informative"), F.col("horizon"))), F.lit(0)).alias("last_informative"))
    a, b = unbroken(F.col("carries_skill")).withColumnRenamed("x", "unbroken_skill"), unbroken(F.col("mean_skill") > 0).withColumnRenamed("x", "unbroken_positive")
    return last.crossJoin(a).crossJoin(b)  # one row each
