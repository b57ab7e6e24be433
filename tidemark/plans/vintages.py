"""The walk forward from a bitemporal store: each forecast date reads the panel that stood then, by the vintage policy,
and an audit forks the store to see whether anything later was known.

Growth, inflation and rates are those of the shipped lines; a line becomes known with the end of the month in which it
was both ordered and shipped, so a month's values are revised for years.  The registry takes rates for a series that
isn't revised; the others are read from their vintages once those have `USABLE` months, and before that from the
latest state, cut by the publication lag.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diff, timegrid, validity
from ..operators import outcomes as oc
from ..sources import forks, tables
from ..sources.scratch import folder, stored
from . import regimewalk as rw
from . import walkforward as wf
from .library import W, at, query, r

USABLE = 54
REVISED = {"growth": True, "inflation": True, "rates": False}
#: The audit's cutoff, in months after the first of the orders, and the same for DuckDB.
CUTOFF_MONTH = 62
CUTOFF = at(CUTOFF_MONTH)
#: Whole forecasts are compared: every field that a run makes.
FIELDS = ["model", "chain", "predicted", "joint", "effective_sample", "distance", "reference"]
PRICE = "price/"


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, vintage_date, observation_date, value): what each month's three measures were said to be, whenever
    that changed.  The raw rows are joined and summed once; the running sums are over (month, month of knowledge)."""
    lines = tables.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_extendedprice", "l_discount")
    orders = tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    told = F.add_months(tables.month_of(F.greatest("o_orderdate", "l_shipdate")), 1)
    facts = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(tables.month_of("l_shipdate").alias("month"), told.alias("vintage_date"), F.lit(1).alias("n"), "l_extendedprice", "l_discount")
    sums = validity.running(facts, ["month"], "vintage_date", ["n", "l_extendedprice", "l_discount"])
    wide = sums.select("month", "vintage_date", F.col("n").cast("double").alias("growth"), F.round(F.col("l_extendedprice") / F.col("n"), 9).alias("inflation"), F.round(F.col("l_discount") / F.col("n"), 9).alias("rates"))  # sums of another order are no revision
    return wide.unpivot(["month", "vintage_date"], list(REVISED), "series_id", "value").select("series_id", "vintage_date", F.col("month").alias("observation_date"), "value")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store's observations: vintages and latest state of the measures, latest state of the prices."""
    log = stored(change_log(spark, sf_dir), "log")
    latest = log.groupBy("series_id", "observation_date").agg(F.max_by("value", "vintage_date").alias("value"))
    prices = tables.order_prices(spark, sf_dir).select(F.concat(F.lit(PRICE), "series_id").alias("series_id"), F.col("month").alias("observation_date"), "value")
    now = latest.unionByName(prices).withColumn("vintage_date", F.lit(None).cast("date"))
    return log.unionByName(now)


def conditions_of(observations: DataFrame) -> DataFrame:
    prices = observations.where(F.col("vintage_date").isNull() & F.startswith("series_id", F.lit(PRICE)))
    rows = prices.select(F.substring("series_id", len(PRICE) + 1, 1000).alias("series_id"), F.col("observation_date").alias("month"), "value")
    return oc.condition(timegrid.complete_grid(rows), wf.THRESHOLD)


def versions_of(observations: DataFrame) -> DataFrame:
    log = observations.where(F.col("vintage_date").isNotNull()).withColumnRenamed("observation_date", "month")
    return validity.intervals(log, ["series_id", "month"])


def choices_of(observations: DataFrame, dates: DataFrame) -> DataFrame:
    """(as_of, series_id, is_revised, vintage_values, policy) of each forecast date."""
    spark = observations.sparkSession
    revised = spark.createDataFrame(list(REVISED.items()), "series_id string, is_revised boolean")
    wanted = dates.select(F.col("month").alias("as_of")).crossJoin(F.broadcast(revised.select("series_id")))  # the registry's few names
    return validity.policies(versions_of(observations), wanted, revised, USABLE)


def panel_of(observations: DataFrame, dates: DataFrame, lead_months: int = 0) -> DataFrame:
    latest = observations.where(F.col("vintage_date").isNull() & F.col("series_id").isin(*REVISED)).withColumnRenamed("observation_date", "month")
    return validity.panel_by_policy(versions_of(observations), latest, choices_of(observations, dates), wf.LAG_DAYS, lead_months)


def run(observations: DataFrame, lead_months: int = 0) -> DataFrame:
    """The whole walk forward from scratch, from nothing but a store's observations."""
    grid = conditions_of(observations)
    dates = stored(rw.forecast_dates(grid), "dates")
    found = stored(rw.matrices(panel_of(observations, dates, lead_months)), "panel")
    return rw.forecasts(grid, found, dates, rw.given_models(observations.sparkSession, dates.select("refit")), ["growth"])


# ---- the same for DuckDB


def _log(changed: bool) -> str:
    """`log` and `latest`; where `changed`, what was told after the cutoff is another."""
    other = lambda late: f"CASE WHEN {late} THEN value * 1.7 + 11 ELSE value END" if changed else "value"
    return f"""
told3 AS (SELECT date_trunc('month', l_shipdate)::DATE AS month, (date_trunc('month', greatest(o_orderdate, l_shipdate)) + INTERVAL 1 MONTH)::DATE AS told, count(*) AS n, sum(l_extendedprice) AS p, sum(l_discount) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
upto AS (SELECT month, told, sum(n) OVER w AS n, sum(p) OVER w AS p, sum(d) OVER w AS d FROM told3 WINDOW w AS (PARTITION BY month ORDER BY told)),
log0 AS (SELECT 'growth' AS series_id, month, told, n::DOUBLE AS value FROM upto UNION ALL SELECT 'inflation', month, told, round(p / n, 9) FROM upto UNION ALL SELECT 'rates', month, told, round(d / n, 9) FROM upto),
latest AS (SELECT series_id, month, {other(f"month + {wf.LAG_DAYS} > {CUTOFF}")} AS value FROM (SELECT series_id, month, max_by(value, told) AS value FROM log0 GROUP BY 1, 2)),
log1 AS (SELECT series_id, month, told, {other(f"told > {CUTOFF}")} AS value FROM log0),
valid AS MATERIALIZED (SELECT *, lead(told, 1, DATE '{validity.OPEN}') OVER (PARTITION BY series_id, month ORDER BY told) AS until FROM (SELECT *, row_number() OVER w AS rn, lag(value) OVER w AS b FROM log1 WINDOW w AS (PARTITION BY series_id, month ORDER BY told)) WHERE rn = 1 OR value IS DISTINCT FROM b),"""


def _panel(changed: bool = False, lead: int = 0) -> str:
    """The panel by policy and the filter over it, in place of the one cut by the lag."""
    at = f"(as_of + INTERVAL {lead} MONTH)::DATE" if lead else "as_of"
    return _log(changed) + f"""
cover AS (SELECT as_of, series_id, count(value) AS n FROM fdates JOIN valid ON told <= as_of AND as_of < until GROUP BY 1, 2),
pol AS MATERIALIZED (SELECT f.as_of, s.series_id, s.series_id <> 'rates' AS is_revised, coalesce(n, 0) AS vintage_values, CASE WHEN s.series_id = 'rates' THEN 'unrevised' WHEN coalesce(n, 0) >= {USABLE} THEN 'vintage' ELSE 'publication_lag_fallback' END AS policy
    FROM fdates f CROSS JOIN (SELECT DISTINCT series_id FROM log0) s LEFT JOIN cover c ON c.as_of = f.as_of AND c.series_id = s.series_id),
pan AS MATERIALIZED (SELECT as_of, v.series_id, month, value, policy FROM valid v JOIN pol p ON p.series_id = v.series_id WHERE policy = 'vintage' AND told <= {at} AND {at} < until
    UNION ALL SELECT as_of, l.series_id, month, value, policy FROM latest l JOIN pol p ON p.series_id = l.series_id WHERE policy <> 'vintage' AND month + {wf.LAG_DAYS} <= as_of),
pt AS (SELECT as_of, series_id, month, CASE WHEN series_id = 'rates' THEN value ELSE ln(value) - ln(lag(value, 12) OVER (PARTITION BY as_of, series_id ORDER BY month)) END AS t FROM pan),
pw AS (SELECT as_of, month, max(t) FILTER (series_id = 'growth') AS g, max(t) FILTER (series_id = 'inflation') AS i, max(t) FILTER (series_id = 'rates') AS x FROM pt GROUP BY 1, 2),
zz AS (SELECT as_of, month, {', '.join(f'CASE WHEN count({c}) OVER w >= {rw.LEAST_MONTHS} AND stddev_samp({c}) OVER w > 0 THEN ({c} - avg({c}) OVER w) / stddev_samp({c}) OVER w END AS {c}' for c in 'gix')} FROM pw WINDOW w AS (PARTITION BY as_of ORDER BY month ROWS UNBOUNDED PRECEDING)),
em AS MATERIALIZED (SELECT as_of, month, row_number() OVER (PARTITION BY as_of ORDER BY month) AS i, exp(-0.5 * (g + 0.5) * (g + 0.5)) AS e0, exp(-0.5 * (g - 0.5) * (g - 0.5)) AS e1 FROM zz WHERE g IS NOT NULL AND i IS NOT NULL AND x IS NOT NULL),
fil AS (SELECT as_of, month, i, (e0 / (e0 + e1))::DOUBLE AS p FROM em WHERE i = 1 UNION ALL
    SELECT em.as_of, em.month, em.i, (e0 * (p * 0.95::DOUBLE + (1 - p) * 0.1::DOUBLE) / (e0 * (p * 0.95::DOUBLE + (1 - p) * 0.1::DOUBLE) + e1 * (p * 0.05::DOUBLE + (1 - p) * 0.9::DOUBLE)))::DOUBLE FROM fil JOIN em ON em.as_of = fil.as_of AND em.i = fil.i + 1),
fnow AS (SELECT f.as_of, f.refit, max_by(p, fil.month) AS p FROM fdates f JOIN fil ON fil.as_of = f.as_of GROUP BY 1, 2),
al AS (SELECT refit, series_id, g.month, holds AS y, lag(holds) OVER (PARTITION BY refit, series_id ORDER BY g.month) AS b, p FROM (SELECT DISTINCT refit FROM fdates) q JOIN grid g ON g.month + {wf.LAG_DAYS} <= refit AND holds IS NOT NULL JOIN fil ON fil.as_of = refit AND fil.month = g.month),"""


def _walk(changed: bool = False, lead: int = 0) -> str:
    head, rest = W, ""
    if changed:  # prices that weren't published by the cutoff are others
        head, _, rest = W.partition("grid AS (")
        body, _, tail = rest.partition("\nsparse AS (")
        value = f"CASE WHEN c.month + {wf.LAG_DAYS} > {CUTOFF} THEN v.value * 1.7 + 11 ELSE v.value END"
        head += "grid AS (" + body.replace("v.value > 250000", f"{value} > 250000").replace("v.value <= 250000", f"{value} <= 250000") + "\nsparse AS (" + tail
    return head + rw.DATES + _panel(changed, lead) + rw.REST


@query(W + rw.DATES + _log(False) + f"one AS (SELECT 1) SELECT series_id, month, {r('value')} AS value, told AS known_from, until AS known_to FROM valid")
def validity_table(spark, sf_dir):
    """From when to when each version of each month's measures stood."""
    return versions_of(stored(change_log(spark, sf_dir), "log"))


@query(W + rw.DATES + _panel() + "one AS (SELECT 1) SELECT as_of, series_id, is_revised, vintage_values, policy FROM pol")
def panel_policies(spark, sf_dir):
    """What each forecast date's panel reads each series from."""
    rows = stored(history(spark, sf_dir), "history")
    return choices_of(rows, stored(rw.forecast_dates(conditions_of(rows)), "dates"))


@query(W + rw.DATES + _panel() + f"one AS (SELECT 1) SELECT as_of, series_id, month, {r('value')} AS value, policy FROM pan")
def panel_by_policy(spark, sf_dir):
    """Every forecast date's panel."""
    rows = stored(history(spark, sf_dir), "history")
    return panel_of(rows, stored(rw.forecast_dates(conditions_of(rows)), "dates"))


@query(_walk() + rw.MADE)
def vintage_walk_forward(spark, sf_dir):
    """The walk forward of a given model over panels as they stood at each date."""
    return run(stored(history(spark, sf_dir), "history"))


# ---- nothing later was known: two runs from scratch, over the store and over a fork with another future


def unpublished(cutoff: date) -> Column:
    """Whether an observation wasn't known by the cutoff."""
    return F.when(F.col("vintage_date").isNotNull(), F.col("vintage_date") > F.lit(cutoff)).otherwise(F.date_add("observation_date", wf.LAG_DAYS) > F.lit(cutoff))


def forked(spark: SparkSession, sf_dir: str) -> str:
    """The root of a store with a state `main` and a fork `future` whose values differ where the cutoff knew none."""
    root = folder(spark, "store")
    forks.create(history(spark, sf_dir), root)
    forks.fork(spark, root, "main", "future", unpublished(tables.month_at(spark, sf_dir, CUTOFF_MONTH)), F.col("value") * 1.7 + 11)
    return root


def audit(spark: SparkSession, sf_dir: str, lead_months: int = 0) -> DataFrame:
    """(forecasts, differing, sound): forecasts made by the cutoff from both states, compared exactly in every field.

    Both the rows and an order-independent sum of their digests must agree; sums of chances inside a run don't depend on
    the order of rows either (`rates.exact_sum`), so equality is asked for without a tolerance.
    """
    root, cutoff, keys = forked(spark, sf_dir), F.lit(tables.month_at(spark, sf_dir, CUTOFF_MONTH)), [*wf.KEYS, "forecast_date"]
    made = [stored(run(forks.opened(spark, root, name), lead_months).where(F.col("forecast_date") <= cutoff).select(*keys, *FIELDS), "audit") for name in ("main", "future")]
    rows = diff.differing(*made, keys, FIELDS).agg(F.count("*").alias("differing"))
    digests = [df.agg(F.count("*").alias(f"n{k}"), F.sum(F.xxhash64(*keys, *FIELDS).cast("decimal(38,0)")).alias(f"sum{k}")) for k, df in enumerate(made)]
    both = rows.crossJoin(digests[0]).crossJoin(digests[1])  # one row each
    sound = (F.col("differing") == 0) & (F.col("n0") == F.col("n1")) & F.col("sum0").eqNullSafe(F.col("sum1"))
    return both.select(F.col("n0").alias("forecasts"), "differing", sound.alias("sound"))


def _audit_sql(lead: int) -> str:
    """For DuckDB, whose sums depend on the order of rows: fields differ where they are more than 1e-9 apart."""
    side = lambda changed: f"SELECT series_id, composition, horizon, as_of, model, chain, 0.5 * model + 0.5 * chain AS predicted, joint, effective_sample, distance, climatology AS reference FROM ({_walk(changed, lead)} SELECT * FROM made) WHERE as_of <= {CUTOFF}"
    differ = " OR ".join(f"coalesce(abs(a.{c} - b.{c}) > 1e-9, (a.{c} IS NULL) <> (b.{c} IS NULL))" for c in FIELDS)
    wrong = f"a.series_id IS NULL OR b.series_id IS NULL OR {differ}"
    return f"SELECT count(a.series_id) AS forecasts, count(*) FILTER ({wrong}) AS differing, count(*) FILTER ({wrong}) = 0 AS sound FROM ({side(False)}) a FULL JOIN ({side(True)}) b ON a.series_id = b.series_id AND a.composition = b.composition AND a.horizon = b.horizon AND a.as_of = b.as_of"


@query(_audit_sql(0))
def fork_audit(spark, sf_dir):
    """The whole walk forward with vintages must not notice another future."""
    return audit(spark, sf_dir)


@query(_audit_sql(6))
def fork_audit_leak(spark, sf_dir):
    """The audit of a panel that reads vintages half a year ahead: it must find them."""
    return audit(spark, sf_dir, 6)


_BLOCKS = f"""obs AS (SELECT series_id, told AS vintage, month, value, told > {CUTOFF} AS late FROM log0 UNION ALL SELECT series_id, NULL, month, value, month + {wf.LAG_DAYS} > {CUTOFF} FROM latest
    UNION ALL SELECT '{PRICE}' || series_id, NULL, month, value, month + {wf.LAG_DAYS} > {CUTOFF} FROM raw),
blk AS (SELECT series_id, CASE WHEN vintage IS NULL THEN 'latest/' || year(month) ELSE 'vintages/' || year(vintage) END AS block, bool_or(late) AS late FROM obs GROUP BY 1, 2)
SELECT series_id, count(*) AS blocks, sum((NOT late)::INTEGER)::BIGINT AS shared FROM blk GROUP BY 1"""


@query(W + rw.DATES + _log(False) + _BLOCKS)
def fork_blocks(spark, sf_dir):
    """How many blocks of each series the fork shares with the store it came from."""
    return forks.shared_blocks(spark, forked(spark, sf_dir), "main", "future")


# ---- fits over the panels as they stood, kept from run to run


def fitted_run(observations: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(forecasts, statistics): the walk forward with a model fitted at each refit date on what stood then; fits that `path`
    holds already are read."""
    grid = conditions_of(observations)
    dates = stored(rw.forecast_dates(grid), "dates")
    found = stored(rw.matrices(panel_of(observations, dates)), "panel")
    fits, statistics = rw.cached_models(found, dates, path)
    return rw.forecasts(grid, found, dates, fits, list(rw.KINDS)), statistics


@query()
def fitted_vintage_walk_forward(spark, sf_dir):
    """Growth and levels chains fitted together at each refit, from twenty starts, on the vintages of that date."""
    return fitted_run(stored(history(spark, sf_dir), "history"), folder(spark, "fits"))[0]


@query(W + rw.DATES + "halves AS (SELECT count(DISTINCT refit) AS n, count(DISTINCT refit) FILTER (as_of <= (SELECT median(as_of) FROM fdates)) AS early FROM fdates) SELECT 'early dates' AS run, early AS lookups, 0::BIGINT AS hits FROM halves UNION ALL SELECT 'all dates', n, early FROM halves UNION ALL SELECT 'again', n, n FROM halves")
def fit_cache(spark, sf_dir):
    """What a cache of fits saves: refits of the first half of the dates, then of all, then of all once more."""
    observations, path, out = stored(history(spark, sf_dir), "history"), folder(spark, "fits"), None
    dates = stored(rw.forecast_dates(conditions_of(observations)), "dates")
    found = stored(rw.matrices(panel_of(observations, dates)), "panel")
    half = dates.agg(F.percentile(F.unix_date("month"), F.lit(0.5)).alias("m")).select(F.date_from_unix_date(F.floor("m").cast("int")).alias("m")).first()[0]
    for name, asked in (("early dates", dates.where(F.col("month") <= F.lit(half))), ("all dates", dates), ("again", dates)):
        _, statistics = rw.cached_models(found, asked, path)
        row = statistics.select(F.lit(name).alias("run"), "lookups", "hits")
        out = row if out is None else out.unionByName(row)
    return out


# ---- two by two: panels as they stood or cut by the lag, the model alone or blended


_UNITS = "SELECT horizon, unit, count(*) AS n, sum(y) AS y, sum(e) AS e, sum(b) AS b, sum(f) AS f FROM (SELECT horizon, series_id || composition AS unit, outcome AS y, pow(model - outcome, 2) AS e, pow(0.5 * model + 0.5 * chain - outcome, 2) AS b, pow(climatology - outcome, 2) AS f FROM made WHERE outcome IS NOT NULL AND climatology IS NOT NULL) GROUP BY 1, 2"


@query(
    f"WITH both_ AS (SELECT 'vintages' AS panel, * FROM ({_walk()} {_UNITS}) UNION ALL SELECT 'publication lag', * FROM ({rw.WHOLE} {_UNITS})), ok AS (SELECT * FROM both_ WHERE n >= 2 AND y > 0.5 AND y < n - 0.5 AND f > 1e-12) "
    f"SELECT panel, 'model' AS forecaster, horizon::INTEGER AS horizon, count(*) AS units, {r('avg(1 - e / f)')} AS mean_skill FROM ok GROUP BY panel, horizon UNION ALL SELECT panel, 'blend', horizon::INTEGER, count(*), {r('avg(1 - b / f)')} FROM ok GROUP BY panel, horizon"
)
def regime_variants(spark, sf_dir):
    """Skill of the regimes' run in its four variants."""
    made = {"vintages": run(stored(history(spark, sf_dir), "history")), "publication lag": rw.given_run(spark, sf_dir)}
    out = None
    for panel, df in made.items():
        df = df.where(F.col("realised").isNotNull() & F.col("reference").isNotNull()).withColumn("unit", F.concat("series_id", "composition"))
        each = F.explode(F.array(*(F.struct(F.lit(n).alias("forecaster"), F.col(c).alias("p")) for n, c in (("model", "model"), ("blend", "predicted")))))
        rows = df.select("horizon", "unit", "realised", "reference", each.alias("x")).select("horizon", "unit", "realised", "reference", "x.*")
        error = lambda c: (F.col(c) - F.col("realised")) * (F.col(c) - F.col("realised"))
        sums = rows.groupBy("forecaster", "horizon", "unit").agg(F.count("*").alias("n"), F.sum("realised").alias("y"), F.sum(error("p")).alias("e"), F.sum(error("reference")).alias("f"))
        ok = sums.where((F.col("n") >= 2) & (F.col("y") > 0.5) & (F.col("y") < F.col("n") - 0.5) & (F.col("f") > 1e-12))
        part = ok.groupBy("forecaster", "horizon").agg(F.count("*").alias("units"), F.avg(1 - F.col("e") / F.col("f")).alias("mean_skill")).withColumn("panel", F.lit(panel))
        out = part if out is None else out.unionByName(part)
    return out.select("panel", "forecaster", "horizon", "units", "mean_skill")
