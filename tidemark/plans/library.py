"""The registered queries of the library and their SQL for DuckDB, each over whole tables.

Doubles are rounded to six places on both sides, as engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import probability as pr
from ..operators import bootstrap, diff, pointintime, scoring, timegrid, transforms
from ..operators import outcomes as oc
from ..sources import register, tables
from ..sources.scratch import stored
from . import walkforward as wf

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

PLACES = 6
KEYS = wf.KEYS


def rounded(df: DataFrame, places: int = PLACES) -> DataFrame:
    return df.select(*((F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def put(fn: Query) -> Query:
        QUERIES[fn.__name__] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return put


def r(expression: str) -> str:
    return f"(round(({expression})::DOUBLE, {PLACES}) + 0.0)"


# What the SQL shares: the same steps as in :mod:`.walkforward`, written for DuckDB.


def at(months: int) -> str:
    """The month so many after the first of the orders, for DuckDB."""
    return f"(SELECT (date_trunc('month', min(o_orderdate)) + to_months({months}))::DATE FROM orders)"


def with_horizons(horizons) -> str:
    return f"""WITH RECURSIVE raw AS (SELECT o_orderpriority AS series_id, date_trunc('month', o_orderdate)::DATE AS month, avg(o_totalprice) AS value FROM orders WHERE o_orderdate < (SELECT date_trunc('month', CASE WHEN last_day(max(o_orderdate)) = max(o_orderdate)::DATE THEN max(o_orderdate) + INTERVAL 1 MONTH ELSE max(o_orderdate) END) FROM orders) GROUP BY 1, 2),
span AS (SELECT series_id, min(month) AS a, max(month) AS b FROM raw GROUP BY 1),
cal AS (SELECT series_id, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month FROM span),
grid AS (SELECT c.series_id, c.month, v.value, CASE WHEN v.value > 250000 THEN 1::DOUBLE WHEN v.value <= 250000 THEN 0::DOUBLE END AS holds FROM cal c LEFT JOIN raw v ON v.series_id = c.series_id AND v.month = c.month),
sparse AS (SELECT o_orderpriority AS series_id, date_trunc('month', o_orderdate)::DATE AS month, avg(o_totalprice) AS value FROM orders WHERE o_totalprice > 480000 GROUP BY 1, 2),
sspan AS (SELECT series_id, min(month) AS a, max(month) AS b FROM sparse GROUP BY 1),
scal AS (SELECT series_id, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month FROM sspan),
sgrid AS (SELECT c.series_id, c.month, v.value FROM scal c LEFT JOIN sparse v ON v.series_id = c.series_id AND v.month = c.month),
lines AS (SELECT date_trunc('month', l_shipdate)::DATE AS month, count(*)::DOUBLE AS growth, avg(l_extendedprice) AS inflation, avg(l_discount) AS rates FROM lineitem GROUP BY 1),
measures AS (SELECT 'growth' AS series_id, month, growth AS value FROM lines UNION ALL SELECT 'inflation', month, inflation FROM lines UNION ALL SELECT 'rates', month, rates FROM lines),
idx AS (SELECT series_id, month, holds, row_number() OVER w AS i, count(holds) OVER w AS c, coalesce(sum(holds) OVER w, 0) AS s FROM grid WINDOW w AS (PARTITION BY series_id ORDER BY month)),
asked AS (SELECT series_id, month, i, c, s, composition, horizon FROM idx, (VALUES ('at_horizon'), ('within_horizon')) q(composition), (SELECT unnest([{', '.join(map(str, horizons))}]) AS horizon)),
found AS (SELECT a.series_id, a.month, a.composition, a.horizon, CASE WHEN a.composition = 'at_horizon' THEN b.holds WHEN b.c - a.c = a.horizon THEN (b.s - a.s > 0)::INTEGER::DOUBLE END AS outcome FROM asked a LEFT JOIN idx b ON b.series_id = a.series_id AND b.i = a.i + a.horizon),
clim AS (SELECT a.series_id, a.composition, a.horizon, a.month, a.outcome, avg(b.outcome) AS climatology FROM found a LEFT JOIN found b ON a.series_id = b.series_id AND a.composition = b.composition AND a.horizon = b.horizon AND b.outcome IS NOT NULL AND (b.month + to_months(b.horizon))::DATE + 45 <= a.month GROUP BY ALL),
st AS (SELECT series_id, month, holds, lag(holds) OVER (PARTITION BY series_id ORDER BY month) AS before FROM grid WHERE holds IS NOT NULL),
cnt AS (SELECT series_id, month, holds AS now, before, count(*) OVER u AS n, sum(holds) OVER u AS s, sum(CASE WHEN before = 0 THEN 1 ELSE 0 END) OVER u AS n_off, sum(CASE WHEN before = 1 THEN 1 ELSE 0 END) OVER u AS n_on,
    sum(CASE WHEN before = 0 THEN holds ELSE 0 END) OVER u AS entries, sum(CASE WHEN before = 1 THEN holds ELSE 0 END) OVER u AS stays FROM st WINDOW u AS (PARTITION BY series_id ORDER BY month ROWS UNBOUNDED PRECEDING)),
rates AS (SELECT g.series_id, g.month, c.month AS known_month, c.now, (c.entries + 10 * c.s / c.n) / (c.n_off + 10) AS entry, (c.stays + 10 * c.s / c.n) / (c.n_on + 10) AS stay FROM grid g JOIN cnt c ON c.series_id = g.series_id AND c.month + 45 <= g.month
    QUALIFY row_number() OVER (PARTITION BY g.series_id, g.month ORDER BY c.month DESC) = 1),
steps AS (SELECT c.*, k.known_month, k.now, k.entry, k.stay, k.entry / (1 - (k.stay - k.entry)) AS run, k.stay - k.entry AS ratio, datediff('month', k.known_month, c.month) AS gap FROM clim c JOIN rates k ON c.series_id = k.series_id AND c.month = k.month WHERE climatology IS NOT NULL),
here AS (SELECT *, run + (now - run) * pow(ratio, gap) AS q, run + (now - run) * pow(ratio, gap + horizon) AS at_h FROM steps),
chained AS (SELECT *, CASE WHEN composition = 'at_horizon' THEN at_h ELSE 1 - (q * (1 - stay) + (1 - q) * (1 - entry)) * pow(1 - entry, horizon - 1) END AS chain FROM here),
fore AS (SELECT series_id, composition, horizon, month AS forecast_date, 0.5::DOUBLE * chain + 0.5::DOUBLE * climatology AS predicted, climatology AS reference, chain, outcome AS realised, known_month, abs(at_h - run) AS distance FROM chained),
scored AS (SELECT *, (predicted - realised) * (predicted - realised) AS e, (reference - realised) * (reference - realised) AS f,
    {' + '.join(f'(predicted >= {e!r}::DOUBLE)::INTEGER' for e in scoring.EDGES)} AS bin FROM (SELECT * REPLACE (round(predicted, 9) AS predicted) FROM fore) WHERE realised IS NOT NULL),
bins AS (SELECT series_id, composition, horizon, bin, count(*) AS n, avg(predicted) AS p, avg(realised) AS y, sqrt(avg(realised) * (1 - avg(realised)) / count(*)) AS se FROM scored GROUP BY 1, 2, 3, 4)
"""


W = with_horizons(wf.HORIZONS)
K = "series_id, composition, horizon"


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wf.conditions(spark, sf_dir)


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series with gaps, as the tables have none: mean of the dearest orders by priority and month."""
    orders = tables.table(spark, sf_dir, "orders").where("o_totalprice > 480000")
    return tables.monthly(orders, "o_orderdate", F.avg("o_totalprice"), F.col("o_orderpriority"))


def scored(spark: SparkSession, sf_dir: str, horizons: list[int] | None = None) -> DataFrame:
    """The resolved forecasts, written once: all scores of a query read the same few rows."""
    return stored(resolved(wf.forecasts(spark, sf_dir, horizons)), "scored")


def resolved(forecasts: DataFrame) -> DataFrame:
    return forecasts.withColumn("predicted", F.round("predicted", 9)).where(F.col("realised").isNotNull())


# ---- series and grids


@query(W + f"SELECT series_id, month, {r('value')} AS value FROM raw")
def monthly_series(spark, sf_dir):
    return tables.order_prices(spark, sf_dir)


@query(W + f"SELECT series_id, month, {r('value')} AS value FROM sgrid")
def complete_month_grid(spark, sf_dir):
    return timegrid.complete_grid(sparse(spark, sf_dir))


@query("""SELECT o_orderpriority AS series_id, date_trunc('month', o_orderdate)::DATE AS month, max_by(o_totalprice, (o_orderkey, o_orderdate::DATE)) AS value FROM orders GROUP BY 1, 2""")
def month_start_dedup(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").cast("date").alias("observation_date"), F.col("o_orderkey").alias("position"), F.col("o_totalprice").alias("value"))
    return timegrid.first_of_month_rows(rows)


@query(W + "SELECT series_id, min(month) AS first_month, max(month) AS last_month, count(*) AS months FROM (SELECT *, year(month) * 12 + month(month) - row_number() OVER (PARTITION BY series_id ORDER BY month) AS run FROM sgrid WHERE value IS NULL) GROUP BY series_id, run")
def gap_runs(spark, sf_dir):
    return timegrid.gap_runs(timegrid.complete_grid(sparse(spark, sf_dir)))


@query(W + f"SELECT series_id, month, value IS NULL AND a IS NOT NULL AND b IS NOT NULL AS is_bridged, {r('CASE WHEN value IS NULL THEN (a + b) / 2 ELSE value END')} AS value FROM (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM sgrid WINDOW w AS (PARTITION BY series_id ORDER BY month))")
def bridge_isolated_gap(spark, sf_dir):
    return timegrid.bridged(timegrid.complete_grid(sparse(spark, sf_dir))).select("series_id", "month", "is_bridged", "value")


@query(W + "SELECT series_id, n, n_distinct, span, n = n_distinct AND n_distinct = span AS is_strict FROM (SELECT series_id, count(*) AS n, count(DISTINCT month) AS n_distinct, (max(year(month) * 12 + month(month)) - min(year(month) * 12 + month(month)) + 1)::INTEGER AS span FROM sparse GROUP BY 1)")
def strict_monthly_check(spark, sf_dir):
    return timegrid.strictly_monthly(sparse(spark, sf_dir))


@query(W + "SELECT min(last) AS latest_common_month FROM (SELECT series_id, max(month) AS last FROM sparse GROUP BY 1)")
def latest_common_month(spark, sf_dir):
    return timegrid.latest_common_month(sparse(spark, sf_dir))


@query(W + "SELECT series_id, min(month) AS first_month, max(month) AS last_month, count(*) AS months, sum((value IS NULL)::INTEGER)::BIGINT AS missing FROM sgrid GROUP BY 1")
def series_audit(spark, sf_dir):
    return pointintime.series_audit(timegrid.complete_grid(sparse(spark, sf_dir)))


@query(W + "SELECT series_id, min(month) AS first_month, max(month) AS last_month, count(*) AS months FROM (SELECT *, year(month) * 12 + month(month) - row_number() OVER (PARTITION BY series_id ORDER BY month) AS run FROM grid WHERE holds = 1) GROUP BY series_id, run")
def month_ranges(spark, sf_dir):
    return timegrid.islands(grid(spark, sf_dir).where("holds = 1"))


# ---- transforms


def _changes(kind: str, sql: str) -> str:
    return W + f"SELECT series_id, month, {r(sql)} AS transformed FROM (SELECT *, lag(value, 12) OVER (PARTITION BY series_id ORDER BY month) AS b FROM grid)"


@query(_changes("log", "CASE WHEN value > 0 AND b > 0 THEN ln(value) - ln(b) END"))
def yoy_log_change(spark, sf_dir):
    return transforms.transformed(grid(spark, sf_dir), transforms.LOG_CHANGE).select("series_id", "month", "transformed")


@query(_changes("percent", "100 * (value / nullif(b, 0) - 1)"))
def yoy_percent_change(spark, sf_dir):
    return transforms.transformed(grid(spark, sf_dir), transforms.PERCENT_CHANGE).select("series_id", "month", "transformed")


@query(_changes("level", "value"))
def level(spark, sf_dir):
    return transforms.transformed(grid(spark, sf_dir), transforms.LEVEL).select("series_id", "month", "transformed")


@query(W + f"SELECT '1-URGENT-5-LOW' AS series_id, a.month, {r('a.value - b.value')} AS value FROM raw a JOIN raw b USING (month) WHERE a.series_id = '1-URGENT' AND b.series_id = '5-LOW'")
def series_difference(spark, sf_dir):
    return transforms.difference(tables.order_prices(spark, sf_dir), "1-URGENT", "5-LOW")


@query(W + f"SELECT series_id, month, {r('CASE WHEN n >= 36 AND sd > 0 THEN (value - mu) / sd END')} AS z FROM (SELECT *, count(value) OVER w AS n, avg(value) OVER w AS mu, stddev_samp(value) OVER w AS sd FROM grid WINDOW w AS (PARTITION BY series_id ORDER BY month ROWS UNBOUNDED PRECEDING))")
def expanding_zscore(spark, sf_dir):
    return transforms.expanding_scores(grid(spark, sf_dir)).select("series_id", "month", "z")


@query(
    W + f"""SELECT month, {r('g')} AS growth, {r('i')} AS inflation, {r('x')} AS rates FROM (SELECT month, max(z) FILTER (series_id = 'growth') AS g, max(z) FILTER (series_id = 'inflation') AS i, max(z) FILTER (series_id = 'rates') AS x FROM (
    SELECT series_id, month, CASE WHEN count(v) OVER w >= 24 AND stddev_samp(v) OVER w > 0 THEN (v - avg(v) OVER w) / stddev_samp(v) OVER w END AS z FROM (
    SELECT series_id, month, CASE WHEN series_id = 'rates' THEN value ELSE ln(value) - ln(lag(value, 12) OVER (PARTITION BY series_id ORDER BY month)) END AS v FROM measures) WINDOW w AS (PARTITION BY series_id ORDER BY month ROWS UNBOUNDED PRECEDING)) GROUP BY month)
    WHERE g IS NOT NULL AND i IS NOT NULL AND x IS NOT NULL"""
)
def observation_matrix(spark, sf_dir):
    lines = timegrid.complete_grid(tables.line_measures(spark, sf_dir))
    return transforms.observation_matrix(lines, {"growth": transforms.LOG_CHANGE, "inflation": transforms.LOG_CHANGE, "rates": transforms.LEVEL}, least=24)


# ---- point in time

_DATES = f"(SELECT unnest(generate_series({at(24)}::TIMESTAMP, (SELECT max(o_orderdate)::TIMESTAMP FROM orders), INTERVAL 6 MONTH))::DATE AS as_of)"


def as_of_dates(spark: SparkSession, sf_dir: str, first: int = 24) -> DataFrame:
    """The dates asked about: every half year, from so many months after the first of the orders to their last."""
    orders = tables.table(spark, sf_dir, "orders").agg(F.add_months(F.trunc(F.min("o_orderdate"), "MM"), first).alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    return stored(orders.select(F.explode(F.sequence("a", "b", F.expr("interval 6 months"))).alias("as_of")), "as-of")


@query(W + f"SELECT d.as_of, series_id, count(*) AS months, max(month) AS last_month, {r('avg(value)')} AS mean_value FROM {_DATES} d JOIN raw ON month + 45 <= d.as_of GROUP BY 1, 2")
def publication_lag_asof(spark, sf_dir):
    known = pointintime.published_by(tables.order_prices(spark, sf_dir), F.broadcast(as_of_dates(spark, sf_dir)), wf.LAG_DAYS)
    return known.groupBy("as_of", "series_id").agg(F.count("*").alias("months"), F.max("month").alias("last_month"), F.avg("value").alias("mean_value"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their month and when they were known: the later of order and shipping."""
    lines = tables.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_shipdate", "l_extendedprice")
    orders = tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select("l_returnflag", tables.month_of("l_shipdate").alias("month"), F.greatest("o_orderdate", "l_shipdate").alias("known"), "l_extendedprice")


def _vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pointintime.vintages(facts(spark, sf_dir), F.broadcast(as_of_dates(spark, sf_dir)), "l_returnflag", "month", "known", F.col("l_extendedprice"))


_VINTAGES = f"""facts AS (SELECT l_returnflag AS series_id, date_trunc('month', l_shipdate)::DATE AS month, date_trunc('month', greatest(o_orderdate, l_shipdate))::DATE AS known, l_extendedprice AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
vint AS (SELECT d.as_of, series_id, month, sum(x) / count(x) AS value FROM {_DATES} d JOIN facts ON known < d.as_of GROUP BY 1, 2, 3),
final AS (SELECT series_id, month, avg(x) AS value FROM facts GROUP BY 1, 2)"""


@query(W + f", {_VINTAGES} SELECT as_of, series_id, month, {r('value')} AS value FROM vint")
def bitemporal_vintages(spark, sf_dir):
    return _vintages(spark, sf_dir)


@query(W + f", {_VINTAGES} SELECT v.series_id, count(*) AS months, sum((abs(f.value - v.value) > 1e-9)::INTEGER)::BIGINT AS moved, {r('quantile_cont(abs(f.value - v.value), 0.5)')} AS median_change, {r('max(abs(f.value - v.value))')} AS largest_change FROM vint v JOIN final f ON v.series_id = f.series_id AND v.month = f.month WHERE v.as_of = {at(48)} GROUP BY 1")
def revision_audit(spark, sf_dir):
    then = _vintages(spark, sf_dir).where(F.col("as_of") == F.lit(tables.month_at(spark, sf_dir, 48)))
    now = tables.monthly(facts(spark, sf_dir), "month", F.avg("l_extendedprice"), F.col("l_returnflag"))
    return pointintime.revisions(then, now)


@query(W + f", {_VINTAGES} SELECT v.series_id, count(*) AS months, sum(((v.value > 52500) <> (f.value > 52500))::INTEGER)::BIGINT AS flips FROM vint v JOIN final f ON v.series_id = f.series_id AND v.month = f.month WHERE v.as_of = {at(48)} GROUP BY 1")
def threshold_flips(spark, sf_dir):
    then = _vintages(spark, sf_dir).where(F.col("as_of") == F.lit(tables.month_at(spark, sf_dir, 48)))
    now = tables.monthly(facts(spark, sf_dir), "month", F.avg("l_extendedprice"), F.col("l_returnflag"))
    return pointintime.threshold_flips(then, now, 52500.0)


_POLICY = f"""cover AS (SELECT d.as_of, s.series_id, s.series_id <> 'N' AS is_revised, coalesce(n, 0) AS vintage_values FROM {_DATES} d CROSS JOIN (SELECT DISTINCT series_id FROM facts) s LEFT JOIN (SELECT as_of, series_id, count(value) AS n FROM vint GROUP BY 1, 2) v ON v.as_of = d.as_of AND v.series_id = s.series_id),
policy AS (SELECT *, CASE WHEN NOT is_revised THEN 'unrevised' WHEN vintage_values >= 40 THEN 'vintage' ELSE 'publication_lag_fallback' END AS policy FROM cover)"""


def _policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _vintages(spark, sf_dir).groupBy("as_of", "series_id").agg(F.count("value").alias("vintage_values"))
    series = tables.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("series_id")).distinct().withColumn("is_revised", F.col("series_id") != "N")
    wanted = series.crossJoin(F.broadcast(as_of_dates(spark, sf_dir)))  # a few names with two dates a year
    return pointintime.vintage_policy(wanted.join(found, ["as_of", "series_id"], "left").withColumn("vintage_values", F.coalesce("vintage_values", F.lit(0))), usable=40)


@query(W + f", {_VINTAGES}, {_POLICY} SELECT as_of, series_id, is_revised, vintage_values, policy FROM policy")
def vintage_policy_choice(spark, sf_dir):
    return _policies(spark, sf_dir).select("as_of", "series_id", "is_revised", "vintage_values", "policy")


@query(W + f", {_VINTAGES}, {_POLICY} SELECT n.policy, count(p.policy) AS n FROM (VALUES ('unrevised'), ('vintage'), ('publication_lag_fallback')) n(policy) LEFT JOIN policy p ON p.policy = n.policy GROUP BY 1")
def policy_counts(spark, sf_dir):
    names = spark.createDataFrame([("unrevised",), ("vintage",), ("publication_lag_fallback",)], "policy string")
    return pointintime.policy_counts(_policies(spark, sf_dir), names)


@query(W + f", {_VINTAGES} SELECT as_of, series_id, max(month) AS last_month FROM vint GROUP BY 1, 2 HAVING max(month) >= as_of")
def no_look_ahead_check(spark, sf_dir):
    return pointintime.looks_ahead(_vintages(spark, sf_dir))


@query(W + "SELECT series_id, month, max(refit) OVER (PARTITION BY series_id ORDER BY month) AS refit FROM (SELECT series_id, month, CASE WHEN (row_number() OVER (PARTITION BY series_id ORDER BY month) - 1) % 6 = 0 THEN month END AS refit FROM grid)")
def asof_latest_refit(spark, sf_dir):
    dates = timegrid.refit_schedule(grid(spark, sf_dir).select("series_id", "month"), 6, "series_id")
    return pointintime.latest_before(dates.select("series_id", "month"), dates.where("is_refit").select("series_id", F.col("month").alias("refit")), "series_id")


#: Turning points and when they were told, for series without real ones.
_TOLD = [("1996-03-01", "1996-12-20"), ("1997-02-01", "1997-04-28"), ("1999-07-01", "2000-06-08"), ("2000-11-01", "2001-11-26")]


@query(W + f", told(turning_point, announced) AS (VALUES {', '.join(f'''(DATE '{a}', DATE '{b}')''' for a, b in _TOLD)}) SELECT series_id, month, max(announced) AS announced, greatest(month + 45, coalesce(max(announced), month + 45)) AS published FROM grid LEFT JOIN told ON turning_point <= month GROUP BY 1, 2")
def announcement_asof(spark, sf_dir):
    told = spark.createDataFrame(_TOLD, "turning_point string, announced string").select(F.col("turning_point").cast("date"), F.col("announced").cast("date"))
    return pointintime.published_with_announcements(grid(spark, sf_dir).select("series_id", "month"), told, wf.LAG_DAYS)


# ---- outcomes and what is known of them


@query(W + "SELECT series_id, month, holds FROM grid")
def monthly_condition(spark, sf_dir):
    return grid(spark, sf_dir).select("series_id", "month", "holds")


@query(W + "SELECT series_id, month, composition, horizon::INTEGER AS horizon, outcome FROM found WHERE composition = 'at_horizon'")
def outcome_at_horizon(spark, sf_dir):
    return oc.outcomes(grid(spark, sf_dir), wf.HORIZONS).where(F.col("composition") == oc.AT)


@query(W + "SELECT series_id, month, composition, horizon::INTEGER AS horizon, outcome FROM found WHERE composition = 'within_horizon'")
def outcome_within_horizon_above(spark, sf_dir):
    return oc.outcomes(grid(spark, sf_dir), wf.HORIZONS).where(F.col("composition") == oc.ANY)


@query(W + f"SELECT series_id, month, {r('CASE WHEN count(value) OVER w = 6 THEN min(value) OVER w END')} AS extreme, CASE WHEN count(value) OVER w = 6 THEN (min(value) OVER w < 240000)::INTEGER::DOUBLE END AS outcome FROM grid WINDOW w AS (PARTITION BY series_id ORDER BY month ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)")
def outcome_within_horizon_below(spark, sf_dir):
    return oc.extreme_within(grid(spark, sf_dir), 6, lowest=True).select("series_id", "month", "extreme", (F.col("extreme") < 240000).cast("double").alias("outcome"))


@query(W + f"SELECT {K.replace('horizon', 'horizon::INTEGER AS horizon')}, count(outcome) AS resolved, sum(outcome) AS positive, {r('avg(outcome)')} AS base_rate FROM found GROUP BY series_id, composition, horizon")
def base_rates(spark, sf_dir):
    return oc.base_rates(oc.outcomes(grid(spark, sf_dir), wf.HORIZONS), KEYS)


@query(W + f"SELECT series_id, composition, horizon::INTEGER AS horizon, month, outcome, {r('climatology')} AS climatology FROM clim")
def expanding_climatology(spark, sf_dir):
    return oc.running_climatology(oc.outcomes(grid(spark, sf_dir), wf.HORIZONS), KEYS, wf.LAG_DAYS)


@query(W + f"SELECT a.series_id, a.composition, a.horizon::INTEGER AS horizon, a.month, a.outcome, {r('avg(b.outcome)')} AS sample_climatology FROM found a LEFT JOIN found b ON a.series_id = b.series_id AND a.composition = b.composition AND a.horizon = b.horizon AND b.outcome IS NOT NULL AND (b.month + to_months(b.horizon))::DATE + 45 <= a.month AND b.month >= (a.month - INTERVAL 24 MONTH)::DATE GROUP BY a.series_id, a.composition, a.horizon, a.month, a.outcome")
def window_climatology_r1(spark, sf_dir):
    return oc.sample_climatology(oc.outcomes(grid(spark, sf_dir), wf.HORIZONS), KEYS, wf.LAG_DAYS, 24)


@query(W + f"SELECT series_id, month, known_month, now, {r('entry')} AS entry, {r('stay')} AS stay FROM rates")
def shrunk_rates(spark, sf_dir):
    return wf.known_rates(grid(spark, sf_dir))


def _chains(composition: str) -> str:
    return W + f"SELECT series_id, composition, horizon::INTEGER AS horizon, month AS forecast_date, {r('chain')} AS chain FROM chained WHERE composition = '{composition}'"


@query(_chains("at_horizon"))
def condition_chain_point_in_time(spark, sf_dir):
    return wf.forecasts(spark, sf_dir).where(F.col("composition") == oc.AT).select(*KEYS, "forecast_date", "chain")


@query(_chains("within_horizon"))
def condition_chain_any_time(spark, sf_dir):
    return wf.forecasts(spark, sf_dir).where(F.col("composition") == oc.ANY).select(*KEYS, "forecast_date", "chain")


@query(W + f"SELECT series_id, composition, horizon::INTEGER AS horizon, month AS forecast_date, {r('0.5 * chain + 0.5 * climatology')} AS predicted FROM chained")
def equal_blend(spark, sf_dir):
    return wf.forecasts(spark, sf_dir).select(*KEYS, "forecast_date", "predicted")


@query(W + f"SELECT series_id, composition, horizon::INTEGER AS horizon, forecast_date, {r('predicted')} AS predicted, {r('reference')} AS reference, {r('chain')} AS chain, realised, known_month, {r('distance')} AS distance FROM fore")
def walk_forward_forecasts(spark, sf_dir):
    return wf.forecasts(spark, sf_dir)


# ---- states: projections of distributions

_P = "[[0.9, 0.1], [0.25, 0.75]]"


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A distribution over two states for each customer segment, from its customers' balances."""
    share = F.avg((F.col("c_acctbal") > 4500).cast("double"))
    rows = tables.table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(share.alias("p"))
    tm = F.array(F.array(F.lit(0.9), F.lit(0.1)), F.array(F.lit(0.25), F.lit(0.75)))
    return rows.select("c_mktsegment", F.array(1 - F.col("p"), F.col("p")).alias("d"), tm.alias("tm"), F.array(F.lit(0.2), F.lit(0.6)).alias("occ"), F.array(F.lit(0.1), F.lit(0.3)).alias("ent"), F.explode(F.array(*map(F.lit, (1, 6, 12)))).alias("h"))


_WALK = """seg AS (SELECT c_mktsegment, avg((c_acctbal > 4500)::INTEGER) AS p FROM customer GROUP BY 1),
walk AS (SELECT c_mktsegment, 0 AS h, 1 - p AS a, p AS b, (1 - p)::DOUBLE AS x, p::DOUBLE AS y FROM seg UNION ALL
    SELECT c_mktsegment, h + 1, a * 0.9::DOUBLE + b * 0.25::DOUBLE, a * 0.1::DOUBLE + b * 0.75::DOUBLE, (x * 0.9::DOUBLE + y * 0.25::DOUBLE) * 0.9::DOUBLE, (x * 0.1::DOUBLE + y * 0.75::DOUBLE) * 0.7::DOUBLE FROM walk WHERE h < 12)"""


@query(f"WITH RECURSIVE {_WALK} SELECT c_mktsegment, h::INTEGER AS h, {r('a')} AS p0, {r('b')} AS p1, {r('0.2 * a + 0.6 * b')} AS point_in_time, {r('1 - x - y')} AS any_time FROM walk WHERE h IN (1, 6, 12)")
def state_projection(spark, sf_dir):
    rows = _states(spark, sf_dir)
    after = pr.stepped(F.col("d"), F.col("tm"), F.col("h"))
    return rows.withColumn("after", after).select("c_mktsegment", "h", F.col("after")[0].alias("p0"), F.col("after")[1].alias("p1"), pr.expectation(F.col("after"), F.col("occ")).alias("point_in_time"), pr.within_horizon(F.col("d"), F.col("tm"), F.col("ent"), F.col("ent"), F.col("h")).alias("any_time"))


@query(f"WITH RECURSIVE {_WALK} SELECT c_mktsegment, h::INTEGER AS h, {r('0.5 * (abs(a - 0.25 / 0.35) + abs(b - 0.1 / 0.35))')} AS distance, {r('ln(0.5) / ln(0.65)')} AS half_life FROM walk WHERE h IN (1, 6, 12)")
def stationary_tv_distance(spark, sf_dir):
    rest = F.array(F.lit(0.25 / 0.35), F.lit(0.1 / 0.35))
    return _states(spark, sf_dir).select("c_mktsegment", "h", pr.total_variation(pr.stepped(F.col("d"), F.col("tm"), F.col("h")), rest).alias("distance"), pr.half_life(F.lit(0.65)).alias("half_life"))


# ---- scores

_KI = "series_id, composition, horizon::INTEGER AS horizon"


@query(W + f"SELECT {_KI}, {r('avg(e)')} AS brier FROM scored GROUP BY {K}")
def brier_score(spark, sf_dir):
    return scored(spark, sf_dir).groupBy(*KEYS).agg(F.avg(scoring.squared("predicted")).alias("brier"))


@query(W + f"SELECT {_KI}, {r('1 - sum(e) / nullif(sum(f), 0)')} AS skill FROM scored GROUP BY {K}")
def brier_skill(spark, sf_dir):
    return scored(spark, sf_dir).groupBy(*KEYS).agg(scoring.skill().alias("skill"))


_LOSS = "-(realised * ln(least(greatest(predicted, 0.01), 0.99)) + (1 - realised) * ln(1 - least(greatest(predicted, 0.01), 0.99)))"
_AUC = f"auc AS (SELECT {K}, CASE WHEN sum(realised) > 0 AND sum(realised) < count(*) THEN (sum(realised * rk) - sum(realised) * (sum(realised) + 1) / 2) / (sum(realised) * (count(*) - sum(realised))) END AS auc FROM (SELECT *, rank() OVER (PARTITION BY {K} ORDER BY predicted) + (count(*) OVER (PARTITION BY {K}, predicted) - 1) / 2::DOUBLE AS rk FROM scored) GROUP BY {K})"
_MURPHY = f"murphy AS (SELECT b.series_id, b.composition, b.horizon, sum(n * (p - y) * (p - y)) / sum(n) AS reliability, sum(n * (y - base) * (y - base)) / sum(n) AS resolution, any_value(base * (1 - base)) AS uncertainty, any_value(brier) AS brier, sum(n * abs(p - y)) / sum(n) AS ece FROM bins b JOIN (SELECT {K}, avg(realised) AS base, avg(e) AS brier FROM scored GROUP BY {K}) t ON b.series_id = t.series_id AND b.composition = t.composition AND b.horizon = t.horizon GROUP BY b.series_id, b.composition, b.horizon)"


@query(W + f"SELECT {_KI}, {r(f'avg({_LOSS})')} AS log_loss FROM scored GROUP BY {K}")
def log_loss(spark, sf_dir):
    return scored(spark, sf_dir).groupBy(*KEYS).agg(F.avg(scoring.log_loss(F.col("predicted"), F.col("realised"))).alias("log_loss"))


@query(W + f", {_AUC} SELECT {_KI}, {r('auc')} AS auc FROM auc")
def auc_midrank(spark, sf_dir):
    return scoring.area_under_curve(scored(spark, sf_dir), KEYS)


@query(W + f", {_MURPHY} SELECT {_KI}, {r('reliability')} AS reliability, {r('resolution')} AS resolution, {r('uncertainty')} AS uncertainty, {r('brier')} AS brier, {r('brier - (reliability - resolution + uncertainty)')} AS residual FROM murphy")
def murphy_decomposition(spark, sf_dir):
    return scoring.murphy(scored(spark, sf_dir), KEYS)


@query(W + f"SELECT {_KI}, bin::INTEGER AS bin, n, {r('p')} AS mean_forecast, {r('y')} AS observed_rate, {r('se')} AS standard_error FROM bins")
def reliability_bins(spark, sf_dir):
    return scoring.reliability_bins(scored(spark, sf_dir), KEYS)


@query(W + f", {_MURPHY} SELECT {_KI}, {r('ece')} AS calibration_error FROM murphy")
def expected_calibration_error(spark, sf_dir):
    return scoring.calibration_error(scored(spark, sf_dir), KEYS)


@query(W + "SELECT a.series_id, a.composition, a.horizon::INTEGER AS horizon, count(*) AS pairs, sum((b.y < a.y - 2 * sqrt(a.se * a.se + b.se * b.se))::INTEGER)::BIGINT AS reversals FROM bins a JOIN bins b ON a.series_id = b.series_id AND a.composition = b.composition AND a.horizon = b.horizon AND a.bin < b.bin GROUP BY 1, 2, a.horizon")
def monotonicity_reversals(spark, sf_dir):
    return scoring.reversals(scored(spark, sf_dir), KEYS)


@query(
    W + f""", {_AUC}, {_MURPHY}, basic AS (SELECT {K}, count(*) AS resolved_forecasts, avg(realised) AS base_rate, avg(e) AS bs, avg(f) AS rbs, 1 - sum(e) / nullif(sum(f), 0) AS skill, avg({_LOSS}) AS loss FROM scored GROUP BY {K})
    SELECT {_KI}, resolved_forecasts, {r('base_rate')} AS base_rate, {r('bs')} AS brier_score, {r('rbs')} AS reference_brier_score, {r('skill')} AS brier_skill, {r('loss')} AS log_loss, {r('auc')} AS auc, {r('ece')} AS calibration_error, {r('reliability')} AS reliability, {r('resolution')} AS resolution FROM basic JOIN auc USING ({K}) JOIN murphy USING ({K})"""
)
def metric_table(spark, sf_dir):
    return scoring.metric_table(scored(spark, sf_dir), KEYS)


_MEAN = "each AS (SELECT horizon, series_id || composition AS indicator, CASE WHEN count(*) >= 2 AND sum(realised) > 0 AND sum(realised) < count(*) AND sum(f) > 0 THEN 1 - sum(e) / sum(f) END AS skill, sum(e) AS e, sum(f) AS f FROM scored GROUP BY 1, 2)"


@query(W + f", {_MEAN} SELECT horizon::INTEGER AS horizon, {r('CASE WHEN count(skill) = count(*) THEN avg(skill) END')} AS mean_skill, count(skill) AS defined, count(*) AS indicators, {r('1 - sum(e) / nullif(sum(f), 0)')} AS pooled_skill FROM each GROUP BY horizon")
def mean_skill_fixed_set(spark, sf_dir):
    return scoring.mean_skill(scored(spark, sf_dir).withColumn("indicator", F.concat("series_id", "composition")), "horizon", "indicator")


@query(W + f"SELECT horizon::INTEGER AS horizon, {r('1 - sum(e) / nullif(sum(f), 0)')} AS pooled_skill FROM scored GROUP BY horizon")
def pooled_skill(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("horizon").agg(scoring.skill().alias("pooled_skill"))


@query(
    W + f""", one AS (SELECT forecast_date, series_id, e FROM scored WHERE composition = 'at_horizon' AND horizon = 3), full_dates AS (SELECT forecast_date FROM one GROUP BY 1 HAVING count(DISTINCT series_id) = (SELECT count(DISTINCT series_id) FROM one)),
    kept AS (SELECT * FROM one WHERE forecast_date IN (SELECT forecast_date FROM full_dates)), varied AS (SELECT series_id FROM kept GROUP BY 1 HAVING stddev_pop(e) > 1e-12), rows_ AS (SELECT * FROM kept WHERE series_id IN (SELECT series_id FROM varied)),
    pairs AS (SELECT a.series_id AS u, b.series_id AS w, corr(a.e, b.e) AS c FROM rows_ a JOIN rows_ b ON a.forecast_date = b.forecast_date AND a.series_id < b.series_id GROUP BY 1, 2)
    SELECT (SELECT count(*) FROM varied) AS units, {r('avg(c)')} AS mean_correlation, {r('greatest(1, 1 + ((SELECT count(*) FROM varied) - 1) * coalesce(avg(c), 0))')} AS design_effect FROM pairs"""
)
def design_effect(spark, sf_dir):
    rows = scored(spark, sf_dir).where((F.col("composition") == oc.AT) & (F.col("horizon") == 3)).withColumn("e", scoring.squared("predicted"))
    return scoring.design_effect(rows, ["horizon"], "series_id", "forecast_date", "e").drop("horizon")


@query(W + f", dated AS (SELECT DISTINCT horizon, forecast_date FROM scored), blocked AS (SELECT *, ntile(4) OVER (PARTITION BY horizon ORDER BY forecast_date) AS block FROM dated) SELECT s.horizon::INTEGER AS horizon, block::INTEGER AS block, count(*) AS n, min(forecast_date) AS first_date, {r('1 - sum(e) / nullif(sum(f), 0)')} AS skill FROM scored s JOIN blocked USING (horizon, forecast_date) GROUP BY s.horizon, block")
def chronological_blocks(spark, sf_dir):
    rows = scoring.chronological_blocks(scored(spark, sf_dir), ["horizon"], "forecast_date")
    return rows.groupBy("horizon", "block").agg(F.count("*").alias("n"), F.min("forecast_date").alias("first_date"), scoring.skill().alias("skill"))


@query(W + f"SELECT a.series_id, a.composition, {', '.join(r(f'max(skill) FILTER (horizon = {h})') + f' AS h{h}' for h in wf.HORIZONS)} FROM (SELECT {K}, 1 - sum(e) / nullif(sum(f), 0) AS skill FROM scored GROUP BY {K}) a GROUP BY 1, 2")
def forecast_grid_pivot(spark, sf_dir):
    wide = scored(spark, sf_dir).groupBy(*KEYS).agg(scoring.skill().alias("skill")).groupBy("series_id", "composition").pivot("horizon", wf.HORIZONS).agg(F.first("skill"))
    return wide.select("series_id", "composition", *(F.col(str(h)).alias(f"h{h}") for h in wf.HORIZONS))


@query(W + f"SELECT {_KI}, {r('max_by(reference, forecast_date)')} AS latest, max(forecast_date) AS forecast_date FROM fore WHERE reference IS NOT NULL GROUP BY {K}")
def latest_benchmark_per_key(spark, sf_dir):
    return wf.forecasts(spark, sf_dir).where(F.col("reference").isNotNull()).groupBy(*KEYS).agg(F.max_by("reference", "forecast_date").alias("latest"), F.max("forecast_date").alias("forecast_date"))


@query(W + "SELECT count(DISTINCT forecast_date) AS dates, count(DISTINCT series_id) AS series, min(forecast_date) AS first_date, max(forecast_date) AS last_date, count(*) AS forecasts, count(realised) AS resolved FROM fore")
def run_identity(spark, sf_dir):
    return wf.forecasts(spark, sf_dir).agg(F.count_distinct("forecast_date").alias("dates"), F.count_distinct("series_id").alias("series"), F.min("forecast_date").alias("first_date"), F.max("forecast_date").alias("last_date"), F.count("*").alias("forecasts"), F.count("realised").alias("resolved"))


@query(
    W + f"""SELECT requirement, offending = 0 AS passed, offending FROM (
    SELECT 'keys are unique' AS requirement, count(*) AS offending FROM (SELECT {K}, forecast_date FROM fore GROUP BY ALL HAVING count(*) > 1)
    UNION ALL SELECT 'probabilities lie in 0 to 1', count(*) FROM fore WHERE NOT (predicted BETWEEN 0 AND 1 AND chain BETWEEN 0 AND 1)
    UNION ALL SELECT 'outcomes are 0, 1 or unknown', count(*) FROM fore WHERE realised NOT IN (0, 1)
    UNION ALL SELECT 'nothing later is known', count(*) FROM fore WHERE known_month >= forecast_date)"""
)
def result_checks(spark, sf_dir):
    f = wf.forecasts(spark, sf_dir)
    return diff.checks(
        ("keys are unique", f.groupBy(*KEYS, "forecast_date").count().where("count > 1")),
        ("probabilities lie in 0 to 1", f.where("NOT (predicted BETWEEN 0 AND 1 AND chain BETWEEN 0 AND 1)")),
        ("outcomes are 0, 1 or unknown", f.where("realised NOT IN (0, 1)")),
        ("nothing later is known", f.where("known_month >= forecast_date")),
    )


# ---- comparing runs

_OTHER = f"other AS (SELECT series_id, month, CASE WHEN month >= {at(60)} THEN value * 1.7 + 11 ELSE value + 1e-12 END AS value FROM grid WHERE month < {at(72)})"


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A run and another that differs from it.  Both come from one aggregate of the raw rows: sums taken twice may be added
    in another order, and their last bits would count as differences."""
    one = grid(spark, sf_dir)
    changed = one.select("series_id", "month", (F.col("value") + 1e-12).alias("value")).where(F.col("month") < F.lit(tables.month_at(spark, sf_dir, 72)))
    return one, changed.withColumn("value", F.when(F.col("month") >= F.lit(tables.month_at(spark, sf_dir, 60)), F.col("value") * 1.7 + 11).otherwise(F.col("value")))


@query(W + f", {_OTHER} SELECT band, count(*) AS n FROM (SELECT CASE WHEN g.series_id IS NULL THEN 'ADDED' WHEN o.series_id IS NULL THEN 'REMOVED' WHEN g.value IS NOT DISTINCT FROM o.value THEN 'IDENTICAL' WHEN abs(g.value - o.value) <= 1e-9 THEN 'NUMERICAL' ELSE 'MOVED' END AS band FROM grid g FULL JOIN other o ON g.series_id = o.series_id AND g.month = o.month) GROUP BY 1")
def banded_field_diff(spark, sf_dir):
    return diff.banded(*_both(spark, sf_dir), ["series_id", "month"], ["value"]).groupBy("band").agg(F.count("*").alias("n"))


@query(W + f", {_OTHER} SELECT CASE WHEN o.series_id IS NULL THEN 'only_first' WHEN g.series_id IS NULL THEN 'only_second' ELSE 'both' END AS side, count(*) AS n FROM grid g FULL JOIN other o ON g.series_id = o.series_id AND g.month = o.month GROUP BY 1")
def key_three_way_split(spark, sf_dir):
    return diff.key_split(*_both(spark, sf_dir), ["series_id", "month"])


@query(W + f"SELECT series_id, count(*) AS values_, sum((month + 45 > {at(62)} AND value IS NOT NULL)::INTEGER)::BIGINT AS perturbed FROM grid GROUP BY 1")
def perturbation_counts(spark, sf_dir):
    g = grid(spark, sf_dir)
    after = diff.perturbed(g, F.date_add("month", wf.LAG_DAYS) > F.lit(tables.month_at(spark, sf_dir, 62)))
    both = g.select("series_id", "month", "value").join(after.select("series_id", "month", F.col("value").alias("other")), ["series_id", "month"])
    return both.groupBy("series_id").agg(F.count("*").alias("values_"), F.sum((F.col("value") != F.col("other")).cast("long")).alias("perturbed"))


# ---- the register of forecasts


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = wf.forecasts(spark, sf_dir).where((F.col("horizon") == 12) & (F.month("forecast_date") == 1))
    return rows.select(F.concat_ws("/", "series_id", "composition").alias("indicator"), F.lit(1).alias("horizon_years"), F.col("forecast_date").alias("data_as_of"), F.lit("h1").alias("configuration_hash"), F.lit("blend").alias("forecaster"), F.round("predicted", 9).alias("probability"), F.col("reference").alias("climatological_base_rate"), F.date_add("forecast_date", 10).alias("made_on"))


_CLAIMS = "claims AS (SELECT series_id || '/' || composition AS indicator, forecast_date AS data_as_of, round(predicted, 9) AS probability, reference AS base, realised, (forecast_date + INTERVAL 12 MONTH)::DATE AS resolves_on FROM fore WHERE horizon = 12 AND month(forecast_date) = 1)"


@query(W + f", {_CLAIMS} SELECT indicator, data_as_of, {r('probability')} AS probability FROM claims WHERE data_as_of >= {at(48)}")
def register_dedup(spark, sf_dir):
    claims = _claims(spark, sf_dir)
    again = claims.union(claims.withColumn("made_on", F.date_add("made_on", 5)))
    return register.new_claims(again, claims.where(F.col("data_as_of") < F.lit(tables.month_at(spark, sf_dir, 48)))).select("indicator", "data_as_of", "probability")


def _resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = wf.forecasts(spark, sf_dir).where("horizon = 12").select(F.concat_ws("/", "series_id", "composition").alias("indicator"), F.add_months("forecast_date", 12).alias("month"), F.col("realised").alias("outcome"))
    return register.resolved(_claims(spark, sf_dir), told, tables.month_at(spark, sf_dir, 73))


@query(W + f", {_CLAIMS} SELECT indicator, data_as_of, resolves_on, CASE WHEN realised IS NULL THEN 'pending' ELSE 'resolved' END AS state, {r('(probability - realised) * (probability - realised)')} AS brier FROM claims WHERE resolves_on <= {at(73)}")
def due_and_resolved(spark, sf_dir):
    return _resolutions(spark, sf_dir).select("indicator", "data_as_of", "resolves_on", "state", "brier")


@query(W + f", {_CLAIMS}, told AS (SELECT (probability - realised) * (probability - realised) AS b, (base - realised) * (base - realised) AS c FROM claims WHERE resolves_on <= {at(73)}), one AS (SELECT count(b) AS n, {r('avg(b)')} AS brier, {r('avg(c)')} AS brier_climatology, {r('CASE WHEN count(b) >= 10 THEN 1 - sum(b) / nullif(sum(c), 0) END')} AS skill FROM told) SELECT 1::INTEGER AS horizon_years, * FROM one UNION ALL SELECT NULL, * FROM one")
def scorecard_rollup(spark, sf_dir):
    return register.scorecard(_resolutions(spark, sf_dir))
