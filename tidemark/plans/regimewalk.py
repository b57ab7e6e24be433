"""The walk forward with regime models, as one set-oriented plan.

Every forecast date sees the panel as it was published by then.  At refit dates a model is fitted (one task for each
refit and restart), and the rates of each condition in each state are learned from what was known then.  Filtering
is one group for each forecast date; everything after it (projection, composition, chains, blends, distances) is
column expressions over dates, series, compositions and horizons.

Growth is the number of lines shipped in a month, levels their mean price and discount; conditions are those of
:mod:`.walkforward`.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import probability as pr
from ..operators import outcomes as oc
from ..operators import pointintime, rates, regimes, timegrid, transforms
from ..sources import models as documents
from ..sources import tables
from ..sources.scratch import stored
from . import walkforward as wf
from .library import W, query, r

REFIT_EVERY = 6
LEAST_MONTHS = 24
KINDS = {"growth": transforms.LOG_CHANGE, "inflation": transforms.LOG_CHANGE, "rates": transforms.LEVEL}
MODEL = "refit date, start array<double>, transition array<array<double>>, means array<array<double>>, covariances array<array<array<double>>>, stationary array<double>, log_likelihood double"


def forecast_dates(grid: DataFrame) -> DataFrame:
    """(schedule, month, refit): the months from the fourth year on, each with its latest refit."""
    months = grid.groupBy("month").agg(F.lit("all").alias("schedule"))
    first = months.agg(F.add_months(F.min("month"), 42).alias("first"))
    dates = months.crossJoin(F.broadcast(first)).where(F.col("month") >= F.col("first")).select("schedule", "month")  # one row
    schedule = timegrid.refit_schedule(dates, REFIT_EVERY)
    return pointintime.latest_before(dates, schedule.where("is_refit").select("schedule", F.col("month").alias("refit")), "schedule")


def panel(spark: SparkSession, sf_dir: str, dates: DataFrame) -> DataFrame:
    """(as_of, series_id, month, value): what was published of each series by each forecast date."""
    final = timegrid.complete_grid(tables.line_measures(spark, sf_dir))
    return pointintime.published_by(final, F.broadcast(dates.select(F.col("month").alias("as_of")).distinct()), wf.LAG_DAYS).select("as_of", "series_id", "month", "value")


def matrices(known: DataFrame, key: str = "as_of") -> DataFrame:
    """(key, month, growth, inflation, rates): bridged, transformed and standardised by what each date (or panel) knew."""
    keyed = known.select(F.struct(key, "series_id").alias("k"), "month", "value")
    rows = timegrid.bridged(timegrid.complete_grid(keyed, "k"), "k")
    kind = F.when(F.lit(False), "")
    for name, value in KINDS.items():
        kind = kind.when(F.col("k.series_id") == name, value)
    z = transforms.expanding_scores(transforms.transformed(rows, kind, "k"), "transformed", "k", LEAST_MONTHS)
    wide = z.groupBy(F.col(f"k.{key}").alias(key), "month").pivot("k.series_id", list(KINDS)).agg(F.first("z")).na.drop()
    return timegrid.asserted_monthly(wide, key)


def panel_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(panel, month, growth, inflation, rates) of each kind of return, standardised."""
    return stored(matrices(tables.panel_measures(spark, sf_dir), "panel"), "panels")


def given_models(spark: SparkSession, keys: DataFrame) -> DataFrame:
    """One model of two states of growth for every key (a refit date, a panel)."""
    model = regimes.Model(np.array([0.5, 0.5]), np.array([[0.95, 0.05], [0.1, 0.9]]), np.array([[-0.5], [0.5]]), np.ones((2, 1, 1)))
    flat = spark.createDataFrame([(*model.flat().values(), [2 / 3, 1 / 3], None)], MODEL.partition(", ")[2])
    return keys.distinct().crossJoin(F.broadcast(flat))  # one row


def fitted_models(found: DataFrame, dates: DataFrame, growth: int = 2, levels: int = 2, restarts: int = regimes.RESTARTS, seed: int = 20) -> DataFrame:
    """At each refit the product of a growth chain and a levels chain, fitted together from several starts.  A group is the
    panel of one refit date; its restarts take their steps as one array."""
    refits = dates.select(F.col("refit").alias("as_of")).distinct()

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        refit = key[0]
        x = rows.sort_values("month")[list(KINDS)].to_numpy(dtype=float)
        own = seed + refit.year * 100 + refit.month
        blocks = [x[:, :1], x[:, 1:]]
        chains, total = regimes.fit_together(blocks, regimes.starts_of(blocks, [growth, levels], [own, own + 1], restarts))
        joint = chains[0].times(chains[1])
        return pd.DataFrame([{"refit": refit, **joint.flat(), "stationary": joint.stationary().tolist(), "log_likelihood": total}])

    return found.join(F.broadcast(refits), "as_of").groupBy("as_of").applyInPandas(run, MODEL)


FIT = {"growth": 2, "levels": 2, "restarts": regimes.RESTARTS, "iterations": regimes.ITERATIONS, "seed": 20}


def cached_models(found: DataFrame, dates: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(models, statistics): the models of all refit dates, each from the documents below `path` or fitted once and kept there."""
    spark = found.sparkSession
    refits = dates.select(F.col("refit").alias("as_of")).distinct()
    panels = found.join(F.broadcast(refits), "as_of").groupBy(F.col("as_of").alias("key")).agg(F.sort_array(F.collect_list(F.struct("month", *KINDS))).alias("rows"))

    def fit(lacking: DataFrame) -> DataFrame:
        rows = lacking.select(F.col("key").alias("as_of"), F.explode("rows").alias("r")).select("as_of", "r.*")
        wanted = lacking.select(F.col("key").alias("refit"), "digest")
        made = fitted_models(rows, wanted, FIT["growth"], FIT["levels"], FIT["restarts"], FIT["seed"])
        return made.join(wanted, "refit").select("digest", documents.document(documents.chain(list(KINDS), *(F.col(p) for p in documents.PARTS))).alias("document"))

    held, statistics = documents.get_or_fit(stored(panels, "panels"), json.dumps(FIT, sort_keys=True), path, fit)
    models = documents.parsed(held.select(F.col("key").alias("refit"), "document"))
    return stored(regimes.long_runs(models, "transition").withColumnRenamed("long_run", "stationary"), "models"), statistics


def filtered(found: DataFrame, dates: DataFrame, models: DataFrame, columns: list[str]) -> DataFrame:
    """(as_of, month, refit, filtered): the chances of the states up to each month of a date's panel."""
    dated = found.join(F.broadcast(dates.select(F.col("month").alias("as_of"), "refit")), "as_of")
    return regimes.filtered_states(dated, models, ["refit"], ["as_of", "refit"], "month", columns).select("as_of", "month", "refit", "filtered")


def conditional(states: DataFrame, grid: DataFrame, strengths: list[float] | None = None) -> DataFrame:
    """(refit, series_id, occupancy, entry, stay, counts) from the conditions published by each refit; with `strengths` for
    each of them (a key `strength`), from the same counts."""
    at_refit = states.where("as_of = refit").select("refit", "month", F.col("filtered").alias("weights"))
    conditions = grid.where(F.col("holds").isNotNull()).select("series_id", "month", "holds")
    rows = conditions.join(at_refit, "month").where(F.date_add("month", wf.LAG_DAYS) <= F.col("refit"))
    keys = ["refit", "series_id"]
    if strengths is None:
        return rates.shrunk_rates(rows, keys, wf.STRENGTH)
    sums = rates.state_sums(rows, keys).withColumn("strength", F.explode(F.array(*map(F.lit, strengths))))
    return rates.drawn_rates(sums, [*keys, "strength"], F.col("strength"))


def forecasts(grid: DataFrame, found: DataFrame, dates: DataFrame, models: DataFrame, columns: list[str], horizons: list[int] = wf.HORIZONS, strengths: list[float] | None = None) -> DataFrame:
    """One row per series, composition, horizon and forecast date: the model's chance, the chain's, their blend, the
    chain of state and condition together, the effective sample and how far the states still are from their long run.

    With `strengths` a row for each of them too: states, chain and reference don't depend on how firmly the rates are drawn
    towards the pooled ones, so the strengths are one more dimension of what follows the counts.
    """
    more = ["strength"] if strengths else []
    states = stored(filtered(found, dates, models, columns), "states")
    now = states.groupBy("as_of", "refit").agg(F.max_by("filtered", "month").alias("d"))
    known = wf.known_rates(grid).select("series_id", F.col("month").alias("as_of"), "known_month", "now", F.col("entry").alias("chain_entry"), F.col("stay").alias("chain_stay"))
    rows = now.join(conditional(states, grid, strengths), "refit").join(known, ["series_id", "as_of"]).join(models.select("refit", "transition", "stationary"), "refit")
    rows = rows.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons)))).withColumn("composition", F.explode(F.array(F.lit(oc.AT), F.lit(oc.ANY))))
    d, tm, h, at = F.col("d"), F.col("transition"), F.col("horizon"), F.col("composition") == oc.AT
    rows = rows.withColumn("after", pr.stepped(d, tm, h)).withColumn("gap", F.months_between("as_of", "known_month").cast("int"))
    first = F.when(F.col("now") > 0.5, F.col("stay")).otherwise(F.col("entry"))
    any_ = pr.within_horizon(d, tm, first, F.col("entry"), h)
    rows = rows.withColumn("model", F.when(at, pr.expectation(F.col("after"), F.col("occupancy"))).otherwise(any_))
    there = pr.chain_at(F.col("now"), F.col("chain_entry"), F.col("chain_stay"), F.col("gap"))
    chain = F.when(at, pr.chain_at(F.col("now"), F.col("chain_entry"), F.col("chain_stay"), F.col("gap") + h)).otherwise(pr.chain_within(there, F.col("chain_entry"), F.col("chain_stay"), h))
    weights = F.when(at, F.col("after")).otherwise(F.zip_with(d, "after", lambda x, y: 0.5 * (x + y)))
    rows = rows.withColumn("chain", chain).select(
        *more, "series_id", "composition", "horizon", F.col("as_of").alias("forecast_date"), "refit", "model", "chain",
        pr.blend(F.col("model"), F.col("chain")).alias("predicted"),
        pr.joint_chain(d, tm, F.col("entry"), F.col("stay"), F.col("now"), F.col("gap"), h, at).alias("joint"),
        pr.expectation(weights, F.col("counts")).alias("effective_sample"),
        pr.total_variation(F.col("after"), F.col("stationary")).alias("distance"),
    )
    told = oc.running_climatology(oc.outcomes(grid, horizons), wf.KEYS, wf.LAG_DAYS).select(*wf.KEYS, F.col("month").alias("forecast_date"), F.col("climatology").alias("reference"), F.col("outcome").alias("realised"))
    return rows.join(told, [*wf.KEYS, "forecast_date"])


#: The walk forward for DuckDB, in three parts: the dates, the panel as it was known (`fil`, `fnow` and `al` come of it), the rest.
DATES = f""", first_date AS (SELECT (min(month) + INTERVAL 42 MONTH)::DATE AS d FROM grid),
fdates AS (SELECT month AS as_of, max(CASE WHEN (rn - 1) % {REFIT_EVERY} = 0 THEN month END) OVER (ORDER BY month) AS refit FROM (SELECT month, row_number() OVER (ORDER BY month) AS rn FROM (SELECT DISTINCT month FROM grid, first_date WHERE month >= d))),"""
_LAGGED = f"""
lspan AS (SELECT unnest(generate_series(min(month)::TIMESTAMP, max(month)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month FROM lines),
v AS (SELECT month, ln(growth) - ln(lag(growth, 12) OVER (ORDER BY month)) AS g, ln(inflation) - ln(lag(inflation, 12) OVER (ORDER BY month)) AS i, rates AS x FROM lspan LEFT JOIN lines USING (month)),
zz AS (SELECT month, {', '.join(f'CASE WHEN count({c}) OVER w >= {LEAST_MONTHS} AND stddev_samp({c}) OVER w > 0 THEN ({c} - avg({c}) OVER w) / stddev_samp({c}) OVER w END AS {c}' for c in 'gix')} FROM v WINDOW w AS (ORDER BY month ROWS UNBOUNDED PRECEDING)),
em AS (SELECT month, row_number() OVER (ORDER BY month) AS i, exp(-0.5 * (g + 0.5) * (g + 0.5)) AS e0, exp(-0.5 * (g - 0.5) * (g - 0.5)) AS e1 FROM (SELECT * FROM zz WHERE g IS NOT NULL AND i IS NOT NULL AND x IS NOT NULL)),
fil AS (SELECT month, i, (e0 / (e0 + e1))::DOUBLE AS p FROM em WHERE i = 1 UNION ALL
    SELECT em.month, em.i, (e0 * (p * 0.95::DOUBLE + (1 - p) * 0.1::DOUBLE) / (e0 * (p * 0.95::DOUBLE + (1 - p) * 0.1::DOUBLE) + e1 * (p * 0.05::DOUBLE + (1 - p) * 0.9::DOUBLE)))::DOUBLE FROM fil JOIN em ON em.i = fil.i + 1),
fnow AS (SELECT as_of, refit, max_by(p, fil.month) AS p FROM fdates JOIN fil ON fil.month + {wf.LAG_DAYS} <= as_of GROUP BY 1, 2),
al AS (SELECT refit, series_id, g.month, holds AS y, lag(holds) OVER (PARTITION BY refit, series_id ORDER BY g.month) AS b, p FROM (SELECT DISTINCT refit FROM fdates) q JOIN grid g ON g.month + {wf.LAG_DAYS} <= refit AND holds IS NOT NULL JOIN fil ON fil.month = g.month),"""
REST = f"""
pool AS (SELECT refit, series_id, avg(y) AS o, coalesce(avg(y) FILTER (b = 0), 0) AS e, coalesce(avg(y) FILTER (b = 1), avg(y)) AS s FROM al GROUP BY 1, 2),
cr AS (SELECT a.refit, a.series_id, {', '.join(f'''(coalesce(sum({w} * y), 0) + 10 * any_value(o)) / (sum({w}) + 10) AS o{k}, (coalesce(sum({w} * y) FILTER (b = 0), 0) + 10 * any_value(e)) / (coalesce(sum({w}) FILTER (b = 0), 0) + 10) AS e{k}, (coalesce(sum({w} * y) FILTER (b = 1), 0) + 10 * any_value(s)) / (coalesce(sum({w}) FILTER (b = 1), 0) + 10) AS s{k}, sum({w}) AS n{k}''' for k, w in ((0, 'p'), (1, '(1 - p)')))} FROM al a JOIN pool q ON q.refit = a.refit AND q.series_id = a.series_id GROUP BY 1, 2),
base AS (SELECT n.as_of, n.refit, n.p, c.* EXCLUDE (refit), k.known_month, k.now, k.entry, k.stay, datediff('month', k.known_month, n.as_of) AS gap, k.entry / (1 - (k.stay - k.entry)) AS run, k.stay - k.entry AS ratio FROM fnow n JOIN cr c ON c.refit = n.refit JOIN rates k ON k.series_id = c.series_id AND k.month = n.as_of),
sv AS (SELECT as_of, series_id, 1 AS h, (0.95 * p + 0.1 * (1 - p)) * (1 - CASE WHEN now = 1 THEN s0 ELSE e0 END) AS a, (0.05 * p + 0.9 * (1 - p)) * (1 - CASE WHEN now = 1 THEN s1 ELSE e1 END) AS b, e0, e1 FROM base UNION ALL SELECT as_of, series_id, h + 1, (0.95 * a + 0.1 * b) * (1 - e0), (0.05 * a + 0.9 * b) * (1 - e1), e0, e1 FROM sv WHERE h < 12),
jc AS (SELECT as_of, series_id, 0 AS t, gap, CASE WHEN now = 1 THEN 0 ELSE p END AS f0, CASE WHEN now = 1 THEN 0 ELSE 1 - p END AS f1, CASE WHEN now = 1 THEN p ELSE 0 END AS n0, CASE WHEN now = 1 THEN 1 - p ELSE 0 END AS n1, e0, e1, s0, s1 FROM base UNION ALL
    SELECT as_of, series_id, t + 1, gap, (0.95 * f0 + 0.1 * f1) * (1 - e0) + (0.95 * n0 + 0.1 * n1) * (1 - s0), (0.05 * f0 + 0.9 * f1) * (1 - e1) + (0.05 * n0 + 0.9 * n1) * (1 - s1), (0.95 * f0 + 0.1 * f1) * e0 + (0.95 * n0 + 0.1 * n1) * s0, (0.05 * f0 + 0.9 * f1) * e1 + (0.05 * n0 + 0.9 * n1) * s1, e0, e1, s0, s1 FROM jc WHERE t < gap + 12),
js AS (SELECT as_of, series_id, 1 AS h, (0.95 * f0 + 0.1 * f1) * (1 - e0) + (0.95 * n0 + 0.1 * n1) * (1 - s0) AS a, (0.05 * f0 + 0.9 * f1) * (1 - e1) + (0.05 * n0 + 0.9 * n1) * (1 - s1) AS b, e0, e1 FROM jc WHERE t = gap UNION ALL SELECT as_of, series_id, h + 1, (0.95 * a + 0.1 * b) * (1 - e0), (0.05 * a + 0.9 * b) * (1 - e1), e0, e1 FROM js WHERE h < 12),
long AS (SELECT b.*, c.horizon, c.composition, c.climatology, c.outcome, 2 / 3::DOUBLE + (p - 2 / 3::DOUBLE) * pow(0.85::DOUBLE, c.horizon) AS ph FROM base b JOIN clim c ON c.series_id = b.series_id AND c.month = b.as_of),
made AS (SELECT l.*, CASE WHEN composition = 'at_horizon' THEN ph * o0 + (1 - ph) * o1 ELSE 1 - sv.a - sv.b END AS model,
    CASE WHEN composition = 'at_horizon' THEN run + (now - run) * pow(ratio, l.gap + l.horizon) ELSE 1 - ((run + (now - run) * pow(ratio, l.gap)) * (1 - stay) + (1 - (run + (now - run) * pow(ratio, l.gap))) * (1 - entry)) * pow(1 - entry, l.horizon - 1) END AS chain,
    CASE WHEN composition = 'at_horizon' THEN jc.n0 + jc.n1 ELSE 1 - js.a - js.b END AS joint,
    CASE WHEN composition = 'at_horizon' THEN ph * n0_ + (1 - ph) * n1_ ELSE 0.5 * ((p + ph) * n0_ + (2 - p - ph) * n1_) END AS effective_sample, abs(ph - 2 / 3::DOUBLE) AS distance
    FROM (SELECT * RENAME (n0 AS n0_, n1 AS n1_) FROM long) l JOIN sv ON sv.as_of = l.as_of AND sv.series_id = l.series_id AND sv.h = l.horizon JOIN jc ON jc.as_of = l.as_of AND jc.series_id = l.series_id AND jc.t = l.gap + l.horizon JOIN js ON js.as_of = l.as_of AND js.series_id = l.series_id AND js.h = l.horizon)
"""
WHOLE = W + DATES + _LAGGED + REST


def given_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk forward of a model with given parameters of two states."""
    grid = wf.conditions(spark, sf_dir)
    dates = stored(forecast_dates(grid), "dates")
    found = stored(matrices(panel(spark, sf_dir, dates)), "panel")
    return forecasts(grid, found, dates, given_models(spark, dates.select("refit")), ["growth"])


MADE = f"SELECT series_id, composition, horizon::INTEGER AS horizon, as_of AS forecast_date, refit, {', '.join(f'{r(c)} AS {c}' for c in ('model', 'chain'))}, {r('0.5 * model + 0.5 * chain')} AS predicted, {', '.join(f'{r(c)} AS {c}' for c in ('joint', 'effective_sample', 'distance'))}, {r('climatology')} AS reference, outcome AS realised FROM made"


@query(WHOLE + MADE)
def regime_walk_forward(spark, sf_dir):
    return given_run(spark, sf_dir)


@query(WHOLE + f"SELECT refit, series_id, {', '.join(f'{r(c)} AS {c}' for c in ('o0', 'o1', 'e0', 'e1', 's0', 's1', 'n0', 'n1'))} FROM cr")
def regime_rates(spark, sf_dir):
    """What each refit may know of how often a condition holds, begins and goes on in each state."""
    grid = wf.conditions(spark, sf_dir)
    dates = stored(forecast_dates(grid), "dates")
    found = stored(matrices(panel(spark, sf_dir, dates)), "panel")
    rows = conditional(filtered(found, dates, given_models(spark, dates.select("refit")), ["growth"]), grid)
    return rows.select("refit", "series_id", *(F.col(c)[k].alias(f"{a}{k}") for a, c in (("o", "occupancy"), ("e", "entry"), ("s", "stay"), ("n", "counts")) for k in (0, 1)))


@query()
def fitted_regime_walk_forward(spark, sf_dir):
    """The walk forward of the product of a growth and a levels chain, refitted twice a year on what was known then."""
    grid = wf.conditions(spark, sf_dir)
    dates = stored(forecast_dates(grid), "dates")
    found = stored(matrices(panel(spark, sf_dir, dates)), "panel")
    models = stored(fitted_models(found, dates), "models")
    return forecasts(grid, found, dates, models, list(KINDS))


_MIX = "(VALUES (1), (3), (6), (12), (24)) q(horizon)"


@query(WHOLE + f"SELECT horizon::INTEGER AS horizon, {r('avg(d)')} AS mean_distance, {r('max(d)')} AS most, {r('min(d)')} AS least FROM (SELECT horizon, abs(p - 2 / 3::DOUBLE) * pow(0.85::DOUBLE, horizon) AS d FROM fnow, {_MIX}) GROUP BY 1")
def mixing_distances(spark, sf_dir):
    """How far the states seen so far are from their long run after some months: mean, most and least."""
    return _mixing(spark, sf_dir)


def _mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = stored(forecast_dates(wf.conditions(spark, sf_dir)), "dates")
    models = given_models(spark, dates.select("refit"))
    states = filtered(matrices(panel(spark, sf_dir, dates)), dates, models, ["growth"])
    now = states.groupBy("as_of", "refit").agg(F.max_by("filtered", "month").alias("d")).join(models.select("refit", "transition", "stationary"), "refit")
    rows = now.withColumn("horizon", F.explode(F.array(*map(F.lit, (1, 3, 6, 12, 24)))))
    far = pr.total_variation(pr.stepped(F.col("d"), F.col("transition"), F.col("horizon")), F.col("stationary"))
    return rows.groupBy("horizon").agg(F.avg(far).alias("mean_distance"), F.max(far).alias("most"), F.min(far).alias("least"))


@query(WHOLE + f"SELECT coalesce(max(horizon) FILTER (d > 0.05), 0)::INTEGER AS information_horizon FROM (SELECT horizon, avg(abs(p - 2 / 3::DOUBLE) * pow(0.85::DOUBLE, horizon)) AS d FROM fnow, {_MIX} GROUP BY 1)")
def information_horizon(spark, sf_dir):
    """The longest measured horizon at which the states still tell more than their long run."""
    return _mixing(spark, sf_dir).agg(F.coalesce(F.max(F.when(F.col("mean_distance") > 0.05, F.col("horizon"))), F.lit(0)).alias("information_horizon"))


PANELS = f"""WITH RECURSIVE pl AS (SELECT l_returnflag AS panel, date_trunc('month', l_shipdate)::DATE AS month, count(*)::DOUBLE AS growth, avg(l_extendedprice) AS inflation, avg(l_discount) AS rates FROM lineitem GROUP BY 1, 2),
pspan AS (SELECT panel, unnest(generate_series(min(month)::TIMESTAMP, max(month)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month FROM pl GROUP BY panel),
pv AS (SELECT panel, month, ln(growth) - ln(lag(growth, 12) OVER w) AS g, ln(inflation) - ln(lag(inflation, 12) OVER w) AS i, rates AS x FROM pspan LEFT JOIN pl USING (panel, month) WINDOW w AS (PARTITION BY panel ORDER BY month)),
pz AS (SELECT * FROM (SELECT panel, month, {', '.join(f'CASE WHEN count({c}) OVER w >= {LEAST_MONTHS} AND stddev_samp({c}) OVER w > 0 THEN ({c} - avg({c}) OVER w) / stddev_samp({c}) OVER w END AS {c}' for c in 'gix')} FROM pv WINDOW w AS (PARTITION BY panel ORDER BY month ROWS UNBOUNDED PRECEDING)) WHERE g IS NOT NULL AND i IS NOT NULL AND x IS NOT NULL),
pe AS (SELECT panel, month, row_number() OVER (PARTITION BY panel ORDER BY month) AS n, exp(-0.5 * (g + 0.5) * (g + 0.5)) AS e0, exp(-0.5 * (g - 0.5) * (g - 0.5)) AS e1 FROM pz),
pf AS (SELECT panel, month, n, (e0 / (e0 + e1))::DOUBLE AS p FROM pe WHERE n = 1 UNION ALL
    SELECT pe.panel, pe.month, pe.n, (e0 * (p * 0.95::DOUBLE + (1 - p) * 0.1::DOUBLE) / (e0 * (p * 0.95::DOUBLE + (1 - p) * 0.1::DOUBLE) + e1 * (p * 0.05::DOUBLE + (1 - p) * 0.9::DOUBLE)))::DOUBLE FROM pf JOIN pe ON pe.panel = pf.panel AND pe.n = pf.n + 1)
"""


def panel_states(spark: SparkSession, found: DataFrame) -> DataFrame:
    """(panel, month, filtered) of panel matrices, by the given model."""
    return regimes.filtered_states(found, given_models(spark, found.select("panel")), ["panel"], ["panel"], "month", ["growth"])


@query(PANELS + f"SELECT panel, count(*) AS months, coalesce(sum((s <> b)::INTEGER), 0)::BIGINT AS switches, {r('12.0 * coalesce(sum((s <> b)::INTEGER), 0) / count(*)')} AS switches_per_year FROM (SELECT panel, s, lag(s) OVER (PARTITION BY panel ORDER BY month) AS b FROM (SELECT panel, month, (p < 0.5)::INTEGER AS s FROM pf)) GROUP BY panel")
def regime_switches(spark, sf_dir):
    """How often the likelier state of a panel changes from month to month."""
    path = panel_states(spark, panel_matrices(spark, sf_dir)).withColumn("s", (F.col("filtered")[0] < 0.5).cast("int"))
    changed = path.withColumn("b", F.lag("s").over(Window.partitionBy("panel").orderBy("month")))
    n = F.coalesce(F.sum((F.col("s") != F.col("b")).cast("long")), F.lit(0))
    return changed.groupBy("panel").agg(F.count("*").alias("months"), n.alias("switches"), (12.0 * n / F.count("*")).alias("switches_per_year"))
