"""Choices among regime models, fitted or given: how many states, whether there are regimes at all, how firmly rates are drawn
towards the pooled ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import algebra
from ..operators import calibration, regimes, scoring
from ..sources.scratch import stored
from . import regimewalk as rw
from . import walkforward as wf
from .library import grid, query, r
from .regimes import daily
from .regimewalk import KINDS, panel_matrices

STATES = [1, 2, 3]


@query()
def regimes_exist_in_fits(spark, sf_dir):
    """Whether more than one state tells left-out months better than one, and by the information criterion too."""
    found = stored(regimes.fits(daily(spark, sf_dir), ["x"], STATES), "fits")
    return regimes.existence(found)


@query()
def state_choice(spark, sf_dir):
    """Of each event type the chosen number of states, the runner-up, and what the criterion alone would choose."""
    return regimes.choices(stored(regimes.fits(daily(spark, sf_dir), ["x"], STATES), "fits"))


def sweep(found: DataFrame) -> DataFrame:
    """(panel, growth, levels, ...): of each panel all pairs of state numbers of the two chains; likelihoods, criteria and
    held-out scores add up, as the chains are independent, and the slower chain sets the second eigenvalue.  A group is one
    panel's chain with one number of states."""
    keep = ["states", "log_likelihood", "information_criterion", "held_out_per_month", "second_modulus", "shortest_duration", "smallest_share"]
    panels = found.withColumnRenamed("panel", "series_id")
    blocks = {"growth": regimes.fits(panels, ["growth"], STATES), "levels": regimes.fits(panels, [c for c in KINDS if c != "growth"], STATES, seed=21)}
    a, b = (stored(df.select(F.col("series_id").alias("panel"), *(F.col(c).alias(f"{name}_{c}") for c in keep)), "sweep") for name, df in blocks.items())
    both = a.join(b, "panel")  # three rows a panel each
    plus = {c: F.col(f"growth_{c}") + F.col(f"levels_{c}") for c in ("log_likelihood", "information_criterion", "held_out_per_month")}
    sound = [(F.col(f"{n}_states") == 1) | ((F.col(f"{n}_shortest_duration") >= 3) & (F.col(f"{n}_smallest_share") >= 0.05)) for n in blocks]
    return both.select(
        "panel", F.col("growth_states").alias("growth"), F.col("levels_states").alias("levels"), (F.col("growth_states") * F.col("levels_states")).alias("states"),
        *(v.alias(c) for c, v in plus.items()), F.greatest("growth_second_modulus", "levels_second_modulus").alias("second_modulus"), (sound[0] & sound[1]).alias("admissible"),
    )


@query()
def two_chain_sweep(spark, sf_dir):
    return sweep(panel_matrices(spark, sf_dir))


#: Months of a panel that are read before the walk forward begins.
BURN_IN = 36


@query()
def burn_in_choice(spark, sf_dir):
    """The numbers of states chosen for each panel on its first months, once for the whole walk forward."""
    first = Window.partitionBy("panel").orderBy("month")
    found = panel_matrices(spark, sf_dir).withColumn("n", F.row_number().over(first)).where(F.col("n") <= BURN_IN).drop("n")
    place = Window.partitionBy("panel").orderBy(F.desc("admissible"), F.desc_nulls_last("held_out_per_month"), "states", "growth")  # eight rows a panel
    best = sweep(found).where("states > 1").withColumn("place", F.row_number().over(place)).where("place = 1").drop("place")
    return best.join(found.groupBy("panel").agg(F.max("month").alias("last_month"), F.count("*").alias("months")), "panel")


# ---- a choice among given models, whose likelihoods need no fit

_CHAINS = {
    1: ([1.0], [[1.0]], [0.0]),
    2: ([0.5, 0.5], [[0.95, 0.05], [0.1, 0.9]], [-0.5, 0.5]),
    3: ([0.25, 0.5, 0.25], [[0.9, 0.05, 0.05], [0.05, 0.9, 0.05], [0.05, 0.05, 0.9]], [-1.0, 0.0, 1.0]),
}
HELD_OUT = 0.2


def given_models(rows: DataFrame) -> DataFrame:
    """(series_id, states, ...): models of one to three states that lie around each series' own mean."""
    usual = rows.groupBy("series_id").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"), F.count("x").alias("n"))
    array = lambda a: F.array(*(array(x) if isinstance(x, list) else F.lit(x) for x in a))
    kinds = F.array(*(F.struct(F.lit(k).alias("states"), array(s).alias("start"), array(t).alias("transition"), array(z).alias("z")) for k, (s, t, z) in _CHAINS.items()))
    models = usual.select("series_id", "m", "sd", "n", F.explode(kinds).alias("c")).select("series_id", "m", "sd", "n", "c.*")
    models = models.withColumn("means", F.transform("z", lambda z: F.array(F.col("m") + z * F.col("sd"))))
    return stored(models.withColumn("covariances", F.transform("z", lambda _: F.array(F.array(F.col("sd") * F.col("sd"))))), "models")


def given_states(rows: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """(series_id, states, month, filtered, log_likelihood) of rows (series_id, states, month, x)."""
    keys = ["series_id", "states"]
    return regimes.filtered_states(rows, given_models(rows) if models is None else models, keys, keys, "month", ["x"])


def given_fits(rows: DataFrame) -> DataFrame:
    """(series_id, states, ...) as :func:`..operators.regimes.fits` gives them, of the given models: likelihoods and shares come
    of the filter in column expressions."""
    models, keys = given_models(rows), ["series_id", "states"]
    told = given_states(rows.withColumn("states", F.explode(F.array(*map(F.lit, _CHAINS)))), models)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("month"))
    told = told.withColumn("place", place).join(models.select(*keys, "n", "transition"), keys)
    out = F.floor(F.col("n") * HELD_OUT)
    sums = told.groupBy(*keys).agg(
        F.max_by("log_likelihood", "place").alias("log_likelihood"), F.max(F.when(F.col("place") == F.col("n") - out, F.col("log_likelihood"))).alias("early"), F.first("n").alias("n"), F.first("transition").alias("transition"),
        *(F.avg(F.get("filtered", F.lit(k))).alias(f"share{k}") for k in range(max(_CHAINS))),
    )
    k, log_n = F.col("states"), F.ln("n")
    free = algebra.free_parameters(k, F.lit(1))
    stays = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.col("transition")[i][i])
    return sums.select(
        *keys, "log_likelihood", free.alias("free_parameters"), (-2 * F.col("log_likelihood") + free * log_n).alias("information_criterion"),
        ((F.col("log_likelihood") - F.col("early")) / F.floor(F.col("n") * HELD_OUT)).alias("held_out_per_month"), (1 / (1 - F.least(F.array_min(stays), F.lit(1 - 1e-12)))).alias("shortest_duration"),
        F.least("share0", "share1", "share2").alias("smallest_share"),
    )


EVENTS = "d AS (SELECT event_type AS series_id, ts::DATE AS day, avg(value) AS x FROM events GROUP BY 1, 2)"


def given_sql(series: str = EVENTS, head: str = "WITH RECURSIVE") -> str:
    """CTEs for DuckDB: `fits` of the given models over `d` (series_id, day, x), and `f`, the chances of the states."""
    t = [[(_CHAINS[k][1][i][j] if i < k and j < k else 0.0) for i in range(3) for j in range(3)] for k in _CHAINS]
    rows = ", ".join(f"({k}, {', '.join(f'{v}::DOUBLE' for v in [*(list(_CHAINS[k][0]) + [0.0] * 3)[:3], *(list(_CHAINS[k][2]) + [0.0] * 3)[:3], *t[k - 1]])}, {1 / (1 - min(min(_CHAINS[k][1][i][i] for i in range(k)), 1 - 1e-12))!r}::DOUBLE)" for k in _CHAINS)
    names = ["states", "s0", "s1", "s2", "z0", "z1", "z2", *(f"t{i}{j}" for i in range(3) for j in range(3)), "duration"]
    step = [f"(p0 * t0{j} + p1 * t1{j} + p2 * t2{j}) * e.e{j}" for j in range(3)]
    return f"""{head} ch({', '.join(names)}) AS (VALUES {rows}),
    {series}, u AS (SELECT series_id, avg(x) AS m, stddev_pop(x) AS sd, count(x) AS n FROM d GROUP BY 1),
    e AS MATERIALIZED (SELECT d.series_id, c.*, u.n, row_number() OVER (PARTITION BY d.series_id, c.states ORDER BY day) AS i, {', '.join(f"exp(-0.5 * pow((x - (m + z{j} * sd)) / sd, 2)) / (sd * sqrt(2 * pi())) AS e{j}" for j in range(3))} FROM d JOIN u ON u.series_id = d.series_id CROSS JOIN ch c),
    f AS (SELECT series_id, states, i, (s0 * e0 / w)::DOUBLE AS p0, (s1 * e1 / w)::DOUBLE AS p1, (s2 * e2 / w)::DOUBLE AS p2, ln(w)::DOUBLE AS ll FROM (SELECT *, s0 * e0 + s1 * e1 + s2 * e2 AS w FROM e WHERE i = 1) UNION ALL
        SELECT series_id, states, i, (q0 / w)::DOUBLE, (q1 / w)::DOUBLE, (q2 / w)::DOUBLE, (ll + ln(w))::DOUBLE FROM (SELECT *, q0 + q1 + q2 AS w FROM (SELECT e.series_id, e.states, e.i, f.ll, {', '.join(f'{s} AS q{j}' for j, s in enumerate(step))} FROM f JOIN e ON e.series_id = f.series_id AND e.states = f.states AND e.i = f.i + 1))),
    g AS (SELECT f.series_id, f.states, max_by(ll, f.i) AS ll, max(ll) FILTER (f.i = e.n - floor(e.n * {HELD_OUT})) AS early, any_value(e.n) AS n, any_value(duration) AS duration, CASE f.states WHEN 1 THEN avg(p0) WHEN 2 THEN least(avg(p0), avg(p1)) ELSE least(avg(p0), avg(p1), avg(p2)) END AS share FROM f JOIN e ON e.series_id = f.series_id AND e.states = f.states AND e.i = f.i GROUP BY 1, 2),
    fits AS (SELECT series_id, states, ll, (states - 1) + states * (states - 1) + 2 * states AS free, (ll - early) / floor(n * {HELD_OUT}) AS held, duration, share, n, -2 * ll + ((states - 1) + states * (states - 1) + 2 * states) * ln(n) AS bic FROM g)"""


@query(given_sql() + f" SELECT series_id, states::INTEGER AS states, {r('ll')} AS log_likelihood, free::INTEGER AS free_parameters, {r('bic')} AS information_criterion, {r('held')} AS held_out_per_month, {r('duration')} AS shortest_duration, {r('share')} AS smallest_share FROM fits")
def given_model_scores(spark, sf_dir):
    """Likelihood, criterion, held-out score and shares of given models of one to three states."""
    return given_fits(daily(spark, sf_dir))


@query(
    given_sql() + """, placed AS (SELECT *, states > 1 AND duration >= 3 AND share >= 0.05 AS ok, row_number() OVER (PARTITION BY series_id ORDER BY (states > 1 AND duration >= 3 AND share >= 0.05) DESC, held DESC NULLS LAST, states) AS place FROM fits)
    SELECT series_id, coalesce(max(states) FILTER (place = 1 AND ok), 1)::INTEGER AS states, (max(states) FILTER (place = 2 AND ok))::INTEGER AS runner_up, arg_min(states, bic)::INTEGER AS by_criterion,
        coalesce(max(held) FILTER (states > 1) > max(held) FILTER (states = 1), false) AS on_holdout, coalesce(min(bic) FILTER (states > 1) < min(bic) FILTER (states = 1), false) AS on_criterion,
        coalesce(max(held) FILTER (states > 1) > max(held) FILTER (states = 1), false) AND coalesce(min(bic) FILTER (states > 1) < min(bic) FILTER (states = 1), false) AS exist FROM placed GROUP BY series_id"""
)
def given_model_choice(spark, sf_dir):
    """Of each series the number of states that given models speak for, the runner-up, and whether there are regimes at all."""
    found = stored(given_fits(daily(spark, sf_dir)), "fits")
    return regimes.choices(found).join(regimes.existence(found), "series_id")


# ---- how firmly rates are drawn towards the pooled ones, over the whole walk forward

STRENGTHS = [2.0, 10.0, 40.0]


def _strength_sql(k: float) -> str:
    rest = rw.REST.replace("10 * any_value", f"{k} * any_value").replace("+ 10) AS", f"+ {k}) AS")
    return f"SELECT {k}::DOUBLE AS strength, * FROM ({rw.WHOLE.removesuffix(rw.REST)}{rest} SELECT horizon, unit, count(*) AS n, sum(y) AS y, sum(e) AS e, sum(f) AS f FROM (SELECT horizon, series_id || composition AS unit, outcome AS y, pow(model - outcome, 2) AS e, pow(climatology - outcome, 2) AS f FROM made WHERE outcome IS NOT NULL AND climatology IS NOT NULL) GROUP BY 1, 2)"


@query(f"SELECT strength, horizon::INTEGER AS horizon, sum(n)::BIGINT AS forecasts, count(*) FILTER (ok) AS units, {r('avg(1 - e / f) FILTER (ok)')} AS mean_skill, {r('sum(e) / sum(n)')} AS brier FROM (SELECT *, n >= 2 AND y > 0.5 AND y < n - 0.5 AND f > 1e-12 AS ok FROM ({' UNION ALL '.join(map(_strength_sql, STRENGTHS))})) GROUP BY 1, 2")
def shrinkage_sweep(spark, sf_dir):
    """Skill of the regimes' forecasts at each horizon and strength; the states are filtered once for all strengths."""
    conditions = wf.conditions(spark, sf_dir)
    dates = stored(rw.forecast_dates(conditions), "dates")
    found = stored(rw.matrices(rw.panel(spark, sf_dir, dates)), "panel")
    rows = rw.forecasts(conditions, found, dates, rw.given_models(spark, dates.select("refit")), ["growth"], strengths=STRENGTHS)
    rows = rows.where(F.col("realised").isNotNull() & F.col("reference").isNotNull()).withColumn("unit", F.concat("series_id", "composition"))
    sums = rows.groupBy("strength", "horizon", "unit").agg(F.count("*").alias("n"), F.sum("realised").alias("y"), F.sum(scoring.squared("model")).alias("e"), F.sum(scoring.squared("reference")).alias("f"))
    ok = (F.col("n") >= 2) & (F.col("y") > 0.5) & (F.col("y") < F.col("n") - 0.5) & (F.col("f") > 1e-12)
    skill = F.when(ok, 1 - F.col("e") / F.col("f"))
    return sums.groupBy("strength", "horizon").agg(F.sum("n").alias("forecasts"), F.count(skill).alias("units"), F.avg(skill).alias("mean_skill"), (F.sum("e") / F.sum("n")).alias("brier"))


@query()
def expanding_probit(spark, sf_dir):
    """The chance that a condition holds a quarter on, by a probit on the value, refitted at each date on what was known."""
    g = grid(spark, sf_dir).where(F.col("value").isNotNull())
    return calibration.expanding_probit(g, 3, wf.LAG_DAYS, least=24)
