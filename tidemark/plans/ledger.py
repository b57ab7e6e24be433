"""What a run leaves behind and is held to: its identity, its metrics, its gates, its files, and the facts of its chains."""

from __future__ import annotations

import json
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import probability as pr
from ..operators import bootstrap, diff, rates, regimes, runs, scoring, timegrid
from ..operators import outcomes as oc
from ..sources import baseline, register, store, tables
from ..sources.scratch import folder, stored
from . import comparisons, vintages
from . import regimewalk as rw
from . import walkforward as wf
from .documents import second_moduli
from .gates import _ALL, _GATES, NAMES, RULES, _failing, failing, gates, passed
from .library import _AUC, _CLAIMS, _LOSS, _MURPHY, K, W, _claims, grid, query, r
from .regimewalk import PANELS, panel_matrices, panel_states
from .regimes import daily
from .sweeps import given_fits, given_sql

_PANEL_CTES = PANELS.removeprefix("WITH RECURSIVE ")

# ---- rates and metrics of the regimes


@query(
    W + f", {_PANEL_CTES}, rs AS (SELECT series_id, panel, g.month, holds AS y, k.state, CASE WHEN k.state = 0 THEN p ELSE 1 - p END AS w FROM grid g JOIN pf ON pf.month = g.month CROSS JOIN (VALUES (0), (1)) k(state) WHERE holds IS NOT NULL), "
    f"rs2 AS (SELECT series_id, panel, month, y, w, state, lag(y) OVER (PARTITION BY series_id, panel, state ORDER BY month) AS b FROM rs) SELECT series_id, panel, state::INTEGER AS state, {r('sum(w * y) / sum(w)')} AS occupancy, {r('sum(w * y) FILTER (b = 0) / nullif(sum(w) FILTER (b = 0), 0)')} AS entry, {r('sum(w * y) FILTER (b = 1) / nullif(sum(w) FILTER (b = 1), 0)')} AS persistence, {r('sum(w)')} AS weight FROM rs2 GROUP BY 1, 2, 3"
)
def conditional_rates_by_state(spark, sf_dir):
    """How often each condition holds, begins and goes on in each state of each panel, weighted by the filtered chance of the
    state."""
    states = panel_states(spark, panel_matrices(spark, sf_dir)).select("panel", "month", F.col("filtered").alias("weights"))
    rows = grid(spark, sf_dir).where(F.col("holds").isNotNull()).select("series_id", "month", "holds").join(states, "month")
    before = F.lag("holds").over(Window.partitionBy("series_id", "panel").orderBy("month"))
    return rates.conditional_rates(rows.withColumn("before", before), ["series_id", "panel"])


_REGIME_SCORED = f"""fore2 AS (SELECT series_id, composition, horizon, as_of AS forecast_date, 0.5 * model + 0.5 * chain AS predicted, climatology AS reference, chain, outcome AS realised, effective_sample, distance FROM made),
scored2 AS (SELECT *, pow(predicted - realised, 2) AS e, pow(reference - realised, 2) AS f, {' + '.join(f'(predicted >= {e!r}::DOUBLE)::INTEGER' for e in scoring.EDGES)} AS bin FROM (SELECT * REPLACE (round(predicted, 9) AS predicted) FROM fore2) WHERE realised IS NOT NULL),
bins2 AS (SELECT series_id, composition, horizon, bin, count(*) AS n, avg(predicted) AS p, avg(realised) AS y, sqrt(avg(realised) * (1 - avg(realised)) / count(*)) AS se FROM scored2 GROUP BY 1, 2, 3, 4)"""


def _of_regimes(sql: str) -> str:
    """SQL over the scored forecasts of the chain, turned to those of the regimes."""
    return sql.replace("FROM scored", "FROM scored2").replace("FROM bins", "FROM bins2").replace("FROM fore ", "FROM fore2 ")


@query(
    rw.WHOLE + f", {_REGIME_SCORED}, " + _of_regimes(f"{_AUC}, {_MURPHY}, basic AS (SELECT {K}, count(*) AS resolved_forecasts, avg(realised) AS base_rate, avg(e) AS bs, 1 - sum(e) / nullif(sum(f), 0) AS skill, avg({_LOSS}) AS loss, avg(distance) AS distance, avg(effective_sample) AS effective FROM scored GROUP BY {K}) ")
    + f"SELECT series_id, composition, horizon::INTEGER AS horizon, resolved_forecasts, {r('base_rate')} AS base_rate, {r('bs')} AS brier_score, {r('skill')} AS brier_skill, {r('loss')} AS log_loss, {r('auc')} AS auc, {r('ece')} AS calibration_error, {r('reliability')} AS reliability, {r('resolution')} AS resolution, {r('distance')} AS mean_distance, {r('effective')} AS mean_effective_sample FROM basic JOIN auc USING ({K}) JOIN murphy USING ({K})"
)
def regime_metric_table(spark, sf_dir):
    """All scores of each question and horizon of the regimes' run, with how far its states were from their long run and how
    many months stood behind a forecast."""
    rows = stored(rw.given_run(spark, sf_dir).withColumn("predicted", F.round("predicted", 9)).where(F.col("realised").isNotNull()), "scored")
    more = rows.groupBy(*wf.KEYS).agg(F.avg("distance").alias("mean_distance"), F.avg("effective_sample").alias("mean_effective_sample"))
    return scoring.metric_table(rows, wf.KEYS).drop("reference_brier_score").join(more, wf.KEYS)


# ---- who a run is

SETTINGS = {"block": "horizon", "horizons": wf.HORIZONS, "lag_days": wf.LAG_DAYS, "least_months": rw.LEAST_MONTHS, "refit_every": rw.REFIT_EVERY, "strength": wf.STRENGTH, "threshold": wf.THRESHOLD, "transforms": rw.KINDS}
SETTINGS_TEXT = json.dumps(SETTINGS, sort_keys=True)


def only(column: str) -> Column:
    """The one value that a column has; a run with two is two runs, and is refused."""
    why = F.concat(F.lit(f"{column} has "), F.count_distinct(column).cast("string"), F.lit(" values"))
    return F.when(F.count_distinct(column) <= 1, F.max(column)).otherwise(F.raise_error(why))


def identity(run: DataFrame) -> DataFrame:
    """(configuration_hash, seed, state_count, refits, dates, first_date, last_date, forecasts, resolved) of results that carry
    their hash, seed and number of states in every row."""
    return run.agg(
        only("configuration_hash").alias("configuration_hash"), only("seed").cast("long").alias("seed"), only("state_count").cast("int").alias("state_count"), F.count_distinct("refit").alias("refits"),
        F.count_distinct("forecast_date").alias("dates"), F.min("forecast_date").alias("first_date"), F.max("forecast_date").alias("last_date"), F.count("*").alias("forecasts"), F.count("realised").alias("resolved"),
    )


def stamped(run: DataFrame, states: int = 2) -> DataFrame:
    """Results as they are kept: every row names the settings, the seed and the states they were made with."""
    return run.select("*", F.sha2(F.lit(SETTINGS_TEXT), 256).alias("configuration_hash"), F.lit(bootstrap.SEED).alias("seed"), F.lit(states).alias("state_count"))


@query(rw.WHOLE + f"SELECT sha256('{SETTINGS_TEXT}') AS configuration_hash, {bootstrap.SEED}::BIGINT AS seed, 2::INTEGER AS state_count, count(DISTINCT refit) AS refits, count(DISTINCT as_of) AS dates, min(as_of) AS first_date, max(as_of) AS last_date, count(*) AS forecasts, count(outcome) AS resolved FROM made")
def regime_run_identity(spark, sf_dir):
    return identity(stored(stamped(rw.given_run(spark, sf_dir)), "results"))


# ---- gates of the regime model, and rule one with regimes from a sweep

_REGIME_RULE = RULES["regime_model"]
_CHOSEN = f"""ordered AS (SELECT *, states > 1 AND duration >= {_REGIME_RULE['shortest_duration']} AND share >= {_REGIME_RULE['smallest_share']} AS ok, row_number() OVER (PARTITION BY series_id ORDER BY (states > 1 AND duration >= {_REGIME_RULE['shortest_duration']} AND share >= {_REGIME_RULE['smallest_share']}) DESC, held DESC NULLS LAST, states) AS place FROM fits),
chosen AS (SELECT series_id, coalesce(max(states) FILTER (place = 1 AND ok), 1) AS states, coalesce(max(held) FILTER (states > 1) > max(held) FILTER (states = 1), false) AS on_holdout, coalesce(min(bic) FILTER (states > 1) < min(bic) FILTER (states = 1), false) AS on_criterion FROM ordered GROUP BY 1),
path AS (SELECT f.series_id, f.i, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS s FROM f JOIN chosen c ON c.series_id = f.series_id AND c.states = f.states),
flick AS (SELECT series_id, sum((s <> b)::INTEGER) AS switches, count(*) AS months FROM (SELECT *, lag(s) OVER (PARTITION BY series_id ORDER BY i) AS b FROM path) GROUP BY 1)"""
REQUIREMENTS = ("more than one state beats one out of sample", "the information criterion agrees", "no state is left too soon", "no state is too rare", "the path rarely switches")


@query(
    given_sql() + f""", {_CHOSEN}, facts3 AS (SELECT c.series_id, on_holdout, on_criterion, duration, share, coalesce(switches, 0) / greatest(months / 12.0, 1) AS rate FROM chosen c JOIN fits t ON t.series_id = c.series_id AND t.states = c.states JOIN flick k ON k.series_id = c.series_id)
    {' UNION ALL '.join(f"SELECT series_id, '{q}' AS requirement, {c} AS passed, {r(e)} AS evidence FROM facts3" for q, c, e in zip(REQUIREMENTS, ("on_holdout", "on_criterion", f"duration >= {_REGIME_RULE['shortest_duration']}", f"share >= {_REGIME_RULE['smallest_share']}", f"rate <= {_REGIME_RULE['most_switches_a_year']}"), ("on_holdout::INTEGER", "on_criterion::INTEGER", "duration", "share", "rate")))}"""
)
def regime_model_gates(spark, sf_dir):
    """What a regime model must have shown, of each series: that there are regimes, by left-out rows and by the criterion, and
    that the chosen ones last, are met, and don't flicker."""
    rows = daily(spark, sf_dir)
    found = stored(given_fits(rows), "fits")
    picked = regimes.choices(found).join(regimes.existence(found), "series_id").select("series_id", "states", "on_holdout", "on_criterion")
    facts = picked.join(found.select("series_id", "states", "shortest_duration", "smallest_share"), ["series_id", "states"])
    facts = facts.join(flicker(rows, picked.select("series_id", "states")), "series_id")
    rate = F.col("switches") / F.greatest(F.col("months") / 12.0, F.lit(1.0))
    rule = _REGIME_RULE
    checks = [
        (F.col("on_holdout"), F.col("on_holdout").cast("double")), (F.col("on_criterion"), F.col("on_criterion").cast("double")),
        (F.col("shortest_duration") >= rule["shortest_duration"], F.col("shortest_duration")), (F.col("smallest_share") >= rule["smallest_share"], F.col("smallest_share")),
        (rate <= rule["most_switches_a_year"], rate),
    ]
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("requirement"), ok.alias("passed"), e.alias("evidence")) for n, (ok, e) in zip(REQUIREMENTS, checks))))
    return facts.select("series_id", each.alias("c")).select("series_id", "c.*")


def flicker(rows: DataFrame, picked: DataFrame) -> DataFrame:
    """(series_id, switches, months) of the likeliest states under the chosen given model."""
    from .sweeps import given_states

    path = given_states(rows.join(picked, "series_id"))
    state = F.array_position("filtered", F.array_max("filtered"))
    w = Window.partitionBy("series_id").orderBy("month")
    changed = path.withColumn("s", state).withColumn("b", F.lag("s").over(w))
    return changed.groupBy("series_id").agg(F.coalesce(F.sum((F.col("s") != F.col("b")).cast("long")), F.lit(0)).alias("switches"), F.count("*").alias("months"))


_SWEPT = _GATES.partition("seq AS (SELECT")
_AFTER = _SWEPT[2].partition("gates AS (SELECT")


@query(
    rw.WHOLE + f", {_REGIME_SCORED}, " + given_sql("d AS (SELECT 'lines' AS series_id, month AS day, g AS x FROM zz WHERE g IS NOT NULL AND i IS NOT NULL AND x IS NOT NULL)", "") + f", {_CHOSEN}, regime AS (SELECT bool_and(on_holdout AND on_criterion) AS regimes_gate FROM chosen)"
    + _of_regimes(_SWEPT[0]).rstrip().rstrip(",") + ", gates AS (SELECT" + _of_regimes(_AFTER[2])
    + f"SELECT horizon::INTEGER AS horizon, {r('mean_skill')} AS mean_skill, {r('lower')} AS lower, {r('ece')} AS ece, {r('distance')} AS distance, {', '.join(f'{n}_gate' for n in NAMES)}, CASE WHEN {_ALL} THEN 'SHIP MODEL' ELSE 'SHIP BASE RATE' END AS verdict, {_failing(NAMES)} AS failing_gates FROM gates"
)
def regime_verdict(spark, sf_dir):
    """Rule one on the regimes' run, whose regimes gate is what the sweep of models over the run's own panel says."""
    conditions = wf.conditions(spark, sf_dir)
    dates = stored(rw.forecast_dates(conditions), "dates")
    found = stored(rw.matrices(rw.panel(spark, sf_dir, dates)), "panel")
    forecasts = stored(rw.forecasts(conditions, found, dates, rw.given_models(spark, dates.select("refit")), ["growth"]), "forecasts")
    whole = rw.matrices(tables.line_measures(spark, sf_dir).withColumn("panel", F.lit("lines")), "panel")
    swept = stored(given_fits(whole.select(F.col("panel").alias("series_id"), "month", F.col("growth").alias("x"))), "fits")
    exist = regimes.existence(swept).agg(F.bool_and("exist").alias("regimes_gate"))
    g = gates(conditions, forecasts, exist).select("horizon", "mean_skill", "lower", "ece", "distance", *(f"{n}_gate" for n in NAMES))
    return g.withColumn("verdict", F.when(passed(), "SHIP MODEL").otherwise("SHIP BASE RATE")).withColumn("failing_gates", failing(NAMES))


# ---- timelines, covariances, paths, long runs


@query(PANELS + f"SELECT panel, state, min(month) AS first_month, max(month) AS last_month, count(*) AS months, {r('avg(c)')} AS mean_chance FROM (SELECT panel, month, (p < 0.5)::INTEGER AS state, greatest(p, 1 - p) AS c, n - row_number() OVER (PARTITION BY panel, (p < 0.5)::INTEGER ORDER BY n) AS run FROM pf) GROUP BY panel, state, run")
def regime_timeline(spark, sf_dir):
    """Each panel's history as spells of its likelier state, with how sure the filter was."""
    path = panel_states(spark, panel_matrices(spark, sf_dir)).select("panel", "month", (F.col("filtered")[0] < 0.5).cast("int").alias("state"), F.array_max("filtered").alias("c"))
    spells = timegrid.islands(path.withColumn("k", F.struct("panel", "state")), "k").select("k.*", "first_month", "last_month", "months")
    inside = path.join(spells, ["panel", "state"]).where((F.col("month") >= F.col("first_month")) & (F.col("month") <= F.col("last_month")))
    return inside.groupBy("panel", "state", "first_month", "last_month", "months").agg(F.avg("c").alias("mean_chance"))


_PAIRS = [("growth", "g"), ("inflation", "i"), ("rates", "x")]


@query(PANELS + " UNION ALL ".join(f"SELECT panel, '{a}' AS first, '{b}' AS second, count(*) AS months, {r(f'covar_samp({x}, {y})')} AS covariance, {r(f'corr({x}, {y})')} AS correlation FROM pz GROUP BY panel" for i, (a, x) in enumerate(_PAIRS) for b, y in _PAIRS[i:]))
def panel_covariances(spark, sf_dir):
    """How the standardised measures of each panel move together."""
    z, names = panel_matrices(spark, sf_dir), [a for a, _ in _PAIRS]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    cells = F.array(*(F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in pairs))
    each = z.select("panel", F.explode(cells).alias("c")).select("panel", "c.*")
    return each.groupBy("panel", "first", "second").agg(F.count("*").alias("months"), F.covar_samp("x", "y").alias("covariance"), F.corr("x", "y").alias("correlation"))


@query(
    PANELS + """, vd AS (SELECT panel, month, n, ln(0.5) + ln(e0) AS a, ln(0.5) + ln(e1) AS b, 0 AS fa, 0 AS fb FROM pe WHERE n = 1 UNION ALL
    SELECT e.panel, e.month, e.n, ln(e.e0) + greatest(v.a + ln(0.95), v.b + ln(0.1)), ln(e.e1) + greatest(v.a + ln(0.05), v.b + ln(0.9)), (v.b + ln(0.1) > v.a + ln(0.95))::INTEGER, (v.b + ln(0.9) > v.a + ln(0.05))::INTEGER FROM vd v JOIN pe e ON e.panel = v.panel AND e.n = v.n + 1),
    vl AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY panel) AS last FROM vd),
    vb AS (SELECT panel, month, n, (b > a)::INTEGER AS state, fa, fb FROM vl WHERE n = last UNION ALL SELECT l.panel, l.month, l.n, CASE WHEN v.state = 0 THEN v.fa ELSE v.fb END, l.fa, l.fb FROM vb v JOIN vl l ON l.panel = v.panel AND l.n = v.n - 1)
    SELECT panel, month, state::INTEGER AS state FROM vb"""
)
def likeliest_path(spark, sf_dir):
    """The likeliest path of states of each panel under the given model."""
    found = panel_matrices(spark, sf_dir)
    models = rw.given_models(spark, found.select("panel")).withColumnRenamed("panel", "series_id")
    return regimes.readings(found.withColumnRenamed("panel", "series_id"), models, ["growth"]).select(F.col("series_id").alias("panel"), "month", "state")


@query(W + f", one AS (SELECT series_id, max_by(entry, known_month) AS e, max_by(stay, known_month) AS s FROM rates GROUP BY 1) SELECT series_id, {r('e / (1 - (s - e))')} AS long_run, {r('abs(s - e)')} AS second_modulus, {r('CASE WHEN abs(s - e) <= 0 THEN 0 ELSE ln(0.5) / ln(abs(s - e)) END')} AS half_life, {r('1 / (1 - s)')} AS duration_on, {r('1 / e')} AS duration_off FROM one")
def chain_facts(spark, sf_dir):
    """Of each condition's chain: its long run, how fast it is reached, and how long spells last."""
    last = wf.known_rates(grid(spark, sf_dir)).groupBy("series_id").agg(F.max_by(F.struct("entry", "stay"), "known_month").alias("r"))
    chains = last.select("series_id", F.array(F.array(1 - F.col("r.entry"), F.col("r.entry")), F.array(1 - F.col("r.stay"), F.col("r.stay"))).alias("m"))
    rows = second_moduli(regimes.long_runs(chains, "m"), {"second_modulus": "m"})
    return rows.select("series_id", F.col("long_run")[1].alias("long_run"), "second_modulus", pr.half_life(F.col("second_modulus")).alias("half_life"), pr.expected_duration(F.col("m")[1][1]).alias("duration_on"), pr.expected_duration(F.col("m")[0][0]).alias("duration_off"))


# ---- tables that refer to one another

REFERENCES = [("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels", "doc_id", "documents", "doc_id")]


@query(" UNION ALL ".join(f"SELECT '{a}.{x}' AS reference, (SELECT count({x}) FROM {a}) AS references_, (SELECT count(*) FROM {a} WHERE {x} IS NOT NULL AND {x} NOT IN (SELECT {y} FROM {b} WHERE {y} IS NOT NULL)) AS unknown" for a, x, b, y in REFERENCES))
def table_references(spark, sf_dir):
    """How many rows of each table refer to one that isn't there."""
    out = None
    for a, x, b, y in REFERENCES:
        child, parent = tables.table(spark, sf_dir, a).where(F.col(x).isNotNull()).select(F.col(x).alias("key")), tables.table(spark, sf_dir, b).select(F.col(y).alias("key")).distinct()
        row = child.join(parent.withColumn("known", F.lit(True)), "key", "left").agg(F.count("*").alias("references_"), F.sum(F.col("known").isNull().cast("long")).alias("unknown"))
        row = row.select(F.lit(f"{a}.{x}").alias("reference"), "references_", F.coalesce("unknown", F.lit(0)).alias("unknown"))
        out = row if out is None else out.unionByName(row)
    return out


# ---- files: delivered text, the store, the register, submissions, records of runs


@query(W + f"SELECT series_id, month AS observation_date, CASE WHEN value > 255000 THEN NULL ELSE {r('value')} END AS value FROM raw")
def delivered_values(spark, sf_dir):
    """Delivered text read strictly: marks of missing values are null."""
    rows = tables.order_prices(spark, sf_dir)
    text = F.when(F.col("value") > 255_000, F.when(F.month("month") % 2 == 0, ".").otherwise(" NA ")).otherwise(F.concat(F.lit(" "), F.col("value").cast("string")))
    lines = rows.select("series_id", F.lit(None).cast("string").alias("vintage_date"), F.col("month").cast("string").alias("observation_date"), text.alias("value"))
    path = folder(spark, "delivered")
    lines.write.option("header", True).csv(path)
    return store.parse_delivered(spark.read.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).schema("series_id string, vintage_date string, observation_date string, value string").csv(path)).select("series_id", "observation_date", "value")


_OBSERVED = W + rw.DATES + vintages._log(False) + f"obs AS (SELECT series_id, told AS vintage, month, value FROM log0 UNION ALL SELECT series_id, NULL, month, value FROM latest UNION ALL SELECT '{vintages.PRICE}' || series_id, NULL, month, value FROM raw)"


@query(_OBSERVED + " SELECT series_id, count(DISTINCT coalesce(vintage, DATE '1000-01-01')) AS snapshots, count(*) AS observations, sum((value IS NULL)::INTEGER)::BIGINT AS missing, min(month) AS first_month, max(month) AS last_month, 0::BIGINT AS unsound FROM obs GROUP BY 1")
def store_snapshots(spark, sf_dir):
    """A store written, read back and verified: what its snapshots say of each series, and how many don't fit their values."""
    path = folder(spark, "store")
    store.write(vintages.history(spark, sf_dir), path)
    bad = store.verified(spark, path).groupBy("series_id").agg(F.count("*").alias("unsound"))
    held = spark.read.parquet(f"{path}/snapshots").groupBy("series_id").agg(
        F.count("*").alias("snapshots"), F.sum("observation_count").alias("observations"), F.sum("missing_value_count").alias("missing"), F.min("observation_start").alias("first_month"), F.max("observation_end").alias("last_month")
    )
    return held.join(bad, "series_id", "left").withColumn("unsound", F.coalesce("unsound", F.lit(0)))


@query(_OBSERVED + f", want AS (SELECT DISTINCT series_id, vintage FROM obs WHERE vintage IS NOT NULL UNION ALL SELECT 'growth', DATE '1900-01-01'), hits AS (SELECT count(*) FILTER (vintage <= {vintages.CUTOFF} AND vintage > DATE '1900-01-01') AS h, count(*) AS n FROM want) SELECT n AS lookups, h AS hits, {r('h / n::DOUBLE')} AS hit_rate, (SELECT count(*) FROM obs WHERE vintage IS NOT NULL) AS observations FROM hits")
def store_fetches(spark, sf_dir):
    """All vintages asked of a store that holds the early ones: what it lacked was fetched and kept, and one that nobody has is
    empty."""
    path, source = folder(spark, "store"), stored(vintages.change_log(spark, sf_dir), "log")
    store.write(source.where(F.col("vintage_date") <= F.lit(tables.month_at(spark, sf_dir, vintages.CUTOFF_MONTH))), path)
    none = spark.createDataFrame([("growth", "1900-01-01")], "series_id string, vintage_date string").select("series_id", F.col("vintage_date").cast("date"))
    wanted = source.select("series_id", "vintage_date").distinct().unionByName(none)
    rows, statistics = store.get_or_fetch(wanted, path, lambda lacking: source.join(lacking, ["series_id", "vintage_date"], "left_semi"))
    return statistics.crossJoin(rows.agg(F.count("*").alias("observations")))  # one row each


@query(W + f", {_CLAIMS} SELECT indicator, data_as_of, {r('probability')} AS probability, 1::BIGINT AS lines FROM claims")
def register_lines(spark, sf_dir):
    """A register of JSON lines to which the same claims are brought twice, in two rounds: each is there once."""
    path, claims = folder(spark, "register"), stored(_claims(spark, sf_dir), "claims")
    early = claims.where(F.col("data_as_of") < F.lit(tables.month_at(spark, sf_dir, 48)))
    register.append(register.new_claims(early, spark.createDataFrame([], register.CLAIMS)), path)
    register.append(register.new_claims(claims.union(claims.withColumn("made_on", F.date_add("made_on", 3))), register.read(spark, path)), path)
    return register.read(spark, path).groupBy("indicator", "data_as_of").agg(F.max("probability").alias("probability"), F.count("*").alias("lines"))


@query(W + f"SELECT indicator, horizon, round_even(p, 4) + 0.0 AS probability, row_number() OVER (ORDER BY indicator, horizon)::INTEGER AS place, rows, horizons FROM (SELECT series_id || '/' || composition AS indicator, horizon::INTEGER AS horizon, max_by(reference, forecast_date) AS p FROM fore WHERE reference IS NOT NULL GROUP BY 1, 2), (SELECT count(*) AS rows, count(DISTINCT horizon) AS horizons FROM (SELECT DISTINCT {K} FROM fore WHERE reference IS NOT NULL))")
def submission_file(spark, sf_dir):
    """A submission as it lies on disk, in its order, with its manifest."""
    path = f"{folder(spark, 'submission')}/forecasts"
    latest = wf.forecasts(spark, sf_dir).where(F.col("reference").isNotNull()).groupBy(F.concat_ws("/", "series_id", "composition").alias("indicator"), "horizon").agg(F.max_by("reference", "forecast_date").alias("probability"))
    baseline.submission(latest, path, "0001")
    lines = spark.read.option("header", True).schema("indicator string, horizon int, probability double").csv(path)
    place = F.row_number().over(Window.partitionBy(F.input_file_name()).orderBy(F.monotonically_increasing_id()))  # a submission is one file
    manifest = spark.read.schema("rows long, horizons array<int>").json(f"{path}-manifest").select("rows", F.size("horizons").cast("long").alias("horizons"))
    return lines.withColumn("place", place).crossJoin(F.broadcast(manifest))  # one row


@query(given_sql() + f""", {_CHOSEN}, want AS (SELECT series_id, arg_min(states, bic) AS states FROM fits GROUP BY 1) SELECT c.series_id, w.states::INTEGER AS approved, c.states::INTEGER AS found FROM chosen c JOIN want w ON w.series_id = c.series_id WHERE c.states <> w.states""")
def structure_refusals(spark, sf_dir):
    """The series a submission would be refused for: held-out rows choose another number of states than the criterion, by which
    they were approved."""
    found = regimes.choices(stored(given_fits(daily(spark, sf_dir)), "fits"))
    return baseline.structure_differences(found.select("series_id", "states"), found.select("series_id", F.col("by_criterion").alias("states")), "series_id")


@query(comparisons._RUNS + f" SELECT 'baseline' AS name, count(*) AS forecasts, count(DISTINCT forecast_date) AS dates, min(forecast_date) AS first_date, max(forecast_date) AS last_date, sha256('{SETTINGS_TEXT}') AS configuration_hash, 20::BIGINT AS seed, count(realised) AS resolved FROM ra UNION ALL SELECT 'current', count(*), count(DISTINCT forecast_date), min(forecast_date), max(forecast_date), sha256('{SETTINGS_TEXT}'), 21::BIGINT, count(realised) FROM rb")
def captured_runs(spark, sf_dir):
    """Two runs kept as records, and what the list of records and the records themselves say."""
    import hashlib

    path, digest = folder(spark, "records"), hashlib.sha256(SETTINGS_TEXT.encode()).hexdigest()
    for k, (name, run) in enumerate(zip(("baseline", "current"), comparisons.two_runs(spark, sf_dir))):
        baseline.capture(run, path, name, digest, 20 + k)
    resolved = None
    for name in ("baseline", "current"):
        row = baseline.read(spark, path, name).agg(F.count("realised").alias("resolved")).withColumn("name", F.lit(name))
        resolved = row if resolved is None else resolved.unionByName(row)
    return baseline.listed(spark, path).join(resolved, "name")
