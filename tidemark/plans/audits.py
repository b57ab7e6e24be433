"""Audits, records and studies beside the rules: what may be used from when, whether runs agree, and what the parts
of a forecast are worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import probability as pr
from ..operators import diff, outcomes as oc, pointintime, scoring, transforms
from ..sources import register, records, store, tables
from ..sources.scratch import stored
from . import walkforward as wf
from .gates import CELLS, cells, mean_skills, scoreable, sums_of
from .library import _CLAIMS, _OTHER, _POLICY, _VINTAGES, K, W, _both, _claims, _policies, _vintages, as_of_dates, at, grid, query, r, scored, with_horizons
from .regimewalk import PANELS, panel_matrices, panel_states

# ---- what may be used from when


@query(W + f", {_VINTAGES}, {_POLICY} SELECT DISTINCT as_of FROM policy WHERE policy = 'publication_lag_fallback'")
def fallback_dates(spark, sf_dir):
    """Dates whose panel had to read a revised series from its latest state."""
    return pointintime.fallback_dates(_policies(spark, sf_dir))


@query(W + f", {_VINTAGES}, {_POLICY} SELECT min(as_of) AS first_candidate, max(as_of) FILTER (policy = 'publication_lag_fallback') AS last_fallback, coalesce((max(as_of) FILTER (policy = 'publication_lag_fallback') + INTERVAL 1 MONTH)::DATE, min(as_of)) AS honest_start FROM policy")
def honest_start(spark, sf_dir):
    """From when on every input was read as it was then; offences needn't stop at the first sound date."""
    return pointintime.honest_start(_policies(spark, sf_dir))


@query(W + f", {_VINTAGES} SELECT d.as_of, s.series_id FROM (SELECT unnest(generate_series({at(-12)}::TIMESTAMP, (SELECT max(o_orderdate)::TIMESTAMP FROM orders), INTERVAL 6 MONTH))::DATE AS as_of) d CROSS JOIN (SELECT DISTINCT series_id FROM facts) s WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.series_id = s.series_id AND f.known < d.as_of)")
def missing_vintages(spark, sf_dir):
    """The (date, series) asked for of which nothing was known yet."""
    dates = as_of_dates(spark, sf_dir, -12)
    from .library import facts

    known = stored(facts(spark, sf_dir).groupBy(F.col("l_returnflag").alias("series_id")).agg(F.min(F.trunc("known", "MM")).alias("first")), "known")
    wanted = known.select("series_id").crossJoin(F.broadcast(dates))  # a few names with two dates a year
    held = known.join(F.broadcast(dates), F.col("first") < F.col("as_of")).select(F.col("as_of").alias("vintage_date"), "series_id")
    return store.missing(wanted.withColumnRenamed("as_of", "vintage_date"), held).select(F.col("vintage_date").alias("as_of"), "series_id")


@query(W + "SELECT count(*) AS inputs, min(first) AS first_month, ((max(first) + INTERVAL 12 MONTH)::DATE + 45) AS first_usable FROM (SELECT series_id, min(month) AS first FROM measures WHERE value IS NOT NULL GROUP BY 1)")
def first_usable_date(spark, sf_dir):
    """The first date at which every input has a year of published months."""
    first = tables.line_measures(spark, sf_dir).where(F.col("value").isNotNull()).groupBy("series_id").agg(F.min("month").alias("first"))
    return first.agg(F.count("*").alias("inputs"), F.min("first").alias("first_month"), F.date_add(F.add_months(F.max("first"), 12), wf.LAG_DAYS).alias("first_usable"))


_MADE = """made AS (SELECT c.series_id, c.composition, c.horizon, c.month, round(c.climatology, 9) AS climatology FROM clim c)"""


def _audit_sql(shift: int) -> str:
    """The walk forward twice, over the data and over data changed after the cutoff, and what differs by the cutoff."""
    one = with_horizons(wf.HORIZONS)
    head, _, rest = one.partition("grid AS (")
    body, _, tail = rest.partition("\nsparse AS (")
    values = f"CASE WHEN c.month + 45 > {at(62)} THEN v.value * 1.7 + 11 ELSE v.value END"
    changed = body.replace("v.value > 250000", f"{values} > 250000").replace("v.value <= 250000", f"{values} <= 250000")
    late = f"(forecast_date - INTERVAL {shift} MONTH)::DATE" if shift else "forecast_date"
    fields = "predicted, reference, chain, known_month, distance"
    first = f"{one} SELECT series_id, composition, horizon, {late} AS forecast_date, {fields} FROM fore"
    second = f"{head}grid AS ({changed}\nsparse AS ({tail} SELECT series_id, composition, horizon, {late} AS forecast_date, {fields} FROM fore"
    differ = " OR ".join(f"round(a.{c}::DOUBLE, 12) IS DISTINCT FROM round(b.{c}::DOUBLE, 12)" if c != "known_month" else "a.known_month IS DISTINCT FROM b.known_month" for c in fields.split(", "))
    return f"SELECT count(*) FILTER (a.series_id IS NULL OR b.series_id IS NULL OR {differ}) AS differing, count(*) FILTER (a.series_id IS NULL OR b.series_id IS NULL OR {differ}) = 0 AS sound FROM (SELECT * FROM ({first}) WHERE forecast_date <= {at(62)}) a FULL JOIN (SELECT * FROM ({second}) WHERE forecast_date <= {at(62)}) b ON a.series_id = b.series_id AND a.composition = b.composition AND a.horizon = b.horizon AND a.forecast_date = b.forecast_date"


def _audit(spark, sf_dir, shift: int) -> DataFrame:
    """Whole forecasts made by a cutoff, from the data and from data whose later values are changed, field by field.
    With `shift` the forecasts claim to be made that many months before they were: a planted leak."""
    cutoff = F.lit(tables.month_at(spark, sf_dir, 62))
    plain = grid(spark, sf_dir)
    changed = oc.condition(diff.perturbed(plain, F.date_add("month", wf.LAG_DAYS) > cutoff), wf.THRESHOLD)
    fields = ["predicted", "reference", "chain", "known_month", "distance"]
    made = []
    for g in (plain, changed):
        f = wf.forecasts_from(g)
        f = f.withColumn("forecast_date", F.add_months("forecast_date", -shift)).where(F.col("forecast_date") <= cutoff)
        made.append(stored(f.select(*wf.KEYS, "forecast_date", *(F.round(c, 12).alias(c) if c != "known_month" else F.col(c) for c in fields)), "audit"))
    n = diff.differing(*made, [*wf.KEYS, "forecast_date"], fields)
    return n.agg(F.count("*").alias("differing")).withColumn("sound", F.col("differing") == 0)


@query(_audit_sql(0))
def look_ahead_audit(spark, sf_dir):
    return _audit(spark, sf_dir, 0)


@query(_audit_sql(6))
def look_ahead_leak(spark, sf_dir):
    """The audit over forecasts that look half a year ahead: it must find them."""
    return _audit(spark, sf_dir, 6)


# ---- do runs agree


@query(W + f", {_OTHER} SELECT g.series_id, g.month, {r('g.value')} AS before, {r('o.value')} AS after FROM grid g JOIN other o ON g.series_id = o.series_id AND g.month = o.month WHERE abs(g.value - o.value) > 1e-9 ORDER BY g.month, g.series_id LIMIT 40")
def first_moved_rows(spark, sf_dir):
    """The first forty values that moved, by date: a report."""
    moved = diff.banded(*_both(spark, sf_dir), ["series_id", "month"], ["value"]).where("band = 'MOVED'")
    return moved.orderBy("month", "series_id").limit(40).select("series_id", "month", "before", "after")


_RANKS = """ranked AS (SELECT series_id, month, band, before, after, row_number() OVER (PARTITION BY series_id ORDER BY (band IN ('ADDED', 'REMOVED'))::INTEGER DESC, (abs(round(after - before, 6)) IS NULL)::INTEGER DESC, abs(round(after - before, 6)) DESC, month) AS place FROM (
    SELECT coalesce(g.series_id, o.series_id) AS series_id, coalesce(g.month, o.month) AS month, g.value AS before, o.value AS after, CASE WHEN g.series_id IS NULL THEN 'ADDED' WHEN o.series_id IS NULL THEN 'REMOVED' ELSE 'MOVED' END AS band FROM grid g FULL JOIN other o ON g.series_id = o.series_id AND g.month = o.month WHERE g.series_id IS NULL OR o.series_id IS NULL OR abs(g.value - o.value) > 1e-9))"""


@query(W + f", {_OTHER}, {_RANKS} SELECT series_id, month, band, place FROM ranked")
def ordered_differences(spark, sf_dir):
    """Differences in the order they are shown: what is only in one run first, then by size."""
    found = diff.banded(*_both(spark, sf_dir), ["series_id", "month"], ["value"]).where("band IN ('MOVED', 'ADDED', 'REMOVED')")
    return diff.in_order(found, "series_id", "month").select("series_id", "month", "band", "place")


@query(W + ", a AS (SELECT DISTINCT series_id AS name FROM raw), b AS (SELECT DISTINCT series_id AS name FROM sparse), c AS (SELECT DISTINCT series_id AS name FROM measures) SELECT 'orders, dear orders' AS pair, NOT EXISTS (SELECT name FROM a EXCEPT SELECT name FROM b) AND NOT EXISTS (SELECT name FROM b EXCEPT SELECT name FROM a) AS equal UNION ALL SELECT 'orders, lines', NOT EXISTS (SELECT name FROM a EXCEPT SELECT name FROM c) AND NOT EXISTS (SELECT name FROM c EXCEPT SELECT name FROM a)")
def name_sets_equal(spark, sf_dir):
    """Whether two tables speak of the same series: nothing is in one alone."""
    from .library import sparse

    names = [x.select(F.col("series_id").alias("name")).distinct() for x in (tables.order_prices(spark, sf_dir), sparse(spark, sf_dir), tables.line_measures(spark, sf_dir))]
    return diff.sets_equal("orders, dear orders", names[0], names[1]).unionByName(diff.sets_equal("orders, lines", names[0], names[2]))


@query(W + f", {_CLAIMS} SELECT indicator, data_as_of, {r('probability')} AS probability FROM claims WHERE resolves_on <= {at(73)} AND data_as_of >= {at(48)}")
def open_claims(spark, sf_dir):
    """Due claims that aren't resolved yet."""
    claims = _claims(spark, sf_dir)
    none = spark.createDataFrame([], "indicator string, month date, outcome double")
    return register.resolved(claims, none, tables.month_at(spark, sf_dir, 73), claims.where(F.col("data_as_of") < F.lit(tables.month_at(spark, sf_dir, 48)))).select("indicator", "data_as_of", "probability")


@query(W + f", {_CLAIMS} SELECT max(data_as_of) AS last_round, ({at(73)} - max(data_as_of))::INTEGER AS days, {at(73)} - max(data_as_of) > 45 AS overdue FROM claims")
def latest_round(spark, sf_dir):
    """The last round of claims, and whether the next is overdue."""
    return register.staleness(_claims(spark, sf_dir).withColumn("made_on", F.col("data_as_of")), tables.month_at(spark, sf_dir, 73))


@query(
    """WITH texts AS (SELECT doc_id, unnest(regexp_extract_all(text, '[+-]?[0-9]+\\.[0-9]+')) AS shown FROM documents),
    numbers AS (SELECT doc_id, shown, len(split_part(shown, '.', 2)) AS places, starts_with(shown, '-') AS negative, abs(shown::DOUBLE) AS size FROM texts WHERE len(split_part(shown, '.', 2)) <= 2),
    known AS (SELECT places, round(p_retailprice, places) AS size FROM part, (VALUES (1), (2)) q(places) GROUP BY 1, 2)
    SELECT count(*) AS numbers, sum((k.size IS NULL)::INTEGER)::BIGINT AS unsourced FROM numbers n LEFT JOIN known k ON k.places = n.places AND NOT n.negative AND abs(k.size - n.size) < 1e-9"""
)
def number_sourcing(spark, sf_dir):
    """How many decimal numbers of the texts round-match no price of the parts, with the same sign."""
    texts = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    prices = tables.table(spark, sf_dir, "part").select(F.col("p_retailprice").alias("value"))
    numbers = records.numbers_of(texts, "doc_id", "text", 2)
    return numbers.agg(F.count("*").alias("numbers")).crossJoin(records.unsourced(numbers, prices, 2).agg(F.count("*").alias("unsourced")))  # one row each


@query("SELECT event_type, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS k, sha256(string_agg(d || '=' || c, ',' ORDER BY d)) AS digest FROM (SELECT event_type, ts::DATE AS d, count(*) AS c FROM events GROUP BY 1, 2) x JOIN (SELECT event_type AS t, any_value(props) AS props FROM (SELECT event_type, min(props) AS props FROM events GROUP BY 1) GROUP BY 1) y ON x.event_type = y.t GROUP BY 1")
def payload_digests(spark, sf_dir):
    """A digest of each series' values, and a number out of a JSON column."""
    events = tables.table(spark, sf_dir, "events")
    daily = events.groupBy("event_type", F.col("ts").cast("date").alias("d")).agg(F.count("*").alias("c"))
    item = F.concat_ws("=", F.col("d").cast("string"), F.col("c").cast("string"))
    least = events.groupBy("event_type").agg(F.from_json(F.min("props"), "k long")["k"].alias("one"))
    lists = daily.groupBy("event_type").agg(F.count("*").alias("n"), F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(item))), 256).alias("digest"))
    return lists.join(least, "event_type").select("event_type", "n", (F.col("one") * F.col("n")).alias("k"), "digest")


@query(W + "SELECT series_id, rule, contains(rule, 'within') AS any_time, contains(rule, 'below') AS below, CASE WHEN contains(rule, 'within') THEN 'any_time_within_horizon' ELSE 'point_in_time' END AS composition FROM (SELECT DISTINCT series_id, composition || '_' || CASE WHEN threshold > 250000 THEN 'above' ELSE 'below' END AS rule FROM found JOIN (SELECT series_id, median(value) AS threshold FROM raw GROUP BY 1) USING (series_id))")
def rule_strings(spark, sf_dir):
    """What the name of each question's rule says: which way, and when.  A series that is usually above the threshold is asked
    whether it is above, any other whether it is below."""
    usual = tables.order_prices(spark, sf_dir).groupBy("series_id").agg(F.percentile("value", F.lit(0.5)).alias("usual"))
    asked = oc.outcomes(grid(spark, sf_dir), wf.HORIZONS).select("series_id", "composition").distinct().join(usual, "series_id")
    rules = asked.select("series_id", F.concat_ws("_", "composition", F.when(F.col("usual") > wf.THRESHOLD, "above").otherwise("below")).alias("rule"))
    return rules.join(pr.rule_parts(rules.select("rule").distinct()), "rule").select("series_id", "rule", "any_time", "below", "composition")


# ---- what the parts are worth

_MEANS_ALL = f"{CELLS}, us AS (SELECT horizon, unit, sum(e) AS e, sum(f) AS f, sum(g) AS g, sum(y) AS y, count(*) AS n FROM cells GROUP BY 1, 2 HAVING count(*) >= 2 AND sum(y) > 0.5 AND sum(y) < count(*) - 0.5 AND sum(f) > 1e-12), skl AS (SELECT horizon, avg(1 - e / f) AS skill FROM us GROUP BY 1)"


@query(W + f", {_MEANS_ALL}, one AS (SELECT min(series_id || composition) AS i FROM fore), far AS (SELECT horizon, avg(distance) AS distance FROM fore, one WHERE series_id || composition = i GROUP BY 1) SELECT s.horizon::INTEGER AS horizon, {r('skill')} AS skill, {r('distance')} AS distance FROM skl s LEFT JOIN far USING (horizon)")
def skill_with_distance(spark, sf_dir):
    """Mean skill at each horizon with how far one indicator's chain still is from its long run."""
    return _with_distance(spark, sf_dir)


def _with_distance(spark, sf_dir, horizons: list[int] | None = None) -> DataFrame:
    found = cells(scored(spark, sf_dir, horizons))
    skills = mean_skills(sums_of(found, ["horizon"]), scoreable(found), ["horizon"])
    f = wf.forecasts(spark, sf_dir, horizons).withColumn("i", F.concat("series_id", "composition"))
    one = f.agg(F.min("i").alias("i"))
    far = f.join(F.broadcast(one), "i").groupBy("horizon").agg(F.avg("distance").alias("distance"))
    return skills.select("horizon", "skill").join(far, "horizon", "left")


@query(with_horizons(range(1, 25)) + f", one AS (SELECT min(series_id || composition) AS i FROM fore), far AS (SELECT horizon, avg(distance) AS distance FROM fore, one WHERE series_id || composition = i GROUP BY 1) SELECT min(horizon) FILTER (distance <= 0.05)::INTEGER AS first_stationary FROM far")
def first_stationary_horizon(spark, sf_dir):
    """The first horizon at which a forecast is its long run in all but name."""
    return _with_distance(spark, sf_dir, list(range(1, 25))).agg(F.min(F.when(F.col("distance") <= 0.05, F.col("horizon"))).alias("first_stationary"))


@query(
    W + f""", rk AS (SELECT {K}, rank() OVER (PARTITION BY {K} ORDER BY predicted) + (count(*) OVER (PARTITION BY {K}, predicted) - 1) / 2.0 AS rank, realised, e, f FROM scored)
    SELECT series_id || '/' || composition AS question, horizon::INTEGER AS horizon, count(*) AS n, {r('avg(realised)')} AS base_rate, {r('1 - sum(e) / nullif(sum(f), 0)')} AS skill, {r('CASE WHEN sum(realised) > 0 AND sum(realised) < count(*) THEN (sum(realised * rank) - sum(realised) * (sum(realised) + 1) / 2) / (sum(realised) * (count(*) - sum(realised))) END')} AS auc FROM rk GROUP BY series_id, composition, horizon"""
)
def question_metrics(spark, sf_dir):
    """Of each question and horizon: how often it came true, skill, and how well forecasts order it."""
    rows = scored(spark, sf_dir)
    basic = rows.groupBy(*wf.KEYS).agg(F.count("*").alias("n"), F.avg("realised").alias("base_rate"), scoring.skill().alias("skill"))
    return basic.join(scoring.area_under_curve(rows, wf.KEYS), wf.KEYS).select(F.concat_ws("/", "series_id", "composition").alias("question"), "horizon", "n", "base_rate", "skill", "auc")


_GRID = [(name, weight, months) for name, weight, months in (("plain", 1.0, 10), ("plain, firm", 1.0, 40), ("blend", 0.5, 10), ("blend, firm", 0.5, 40))]


def _variant_sql(weight: float, strength: int) -> str:
    base = W.replace("10 * c.s / c.n", f"{strength} * c.s / c.n").replace("(c.n_off + 10)", f"(c.n_off + {strength})").replace("(c.n_on + 10)", f"(c.n_on + {strength})")
    base = base.replace("0.5::DOUBLE * chain + 0.5::DOUBLE * climatology", f"{weight}::DOUBLE * chain + {1 - weight}::DOUBLE * climatology")
    return f"SELECT * FROM ({base}, {_MEANS_ALL} SELECT horizon, skill FROM skl)"


def _variants(spark, sf_dir) -> DataFrame:
    g, out = grid(spark, sf_dir), None
    for name, weight, strength in _GRID:
        f = wf.forecasts_from(g, weight=weight, strength=float(strength)).withColumn("predicted", F.round("predicted", 9)).where(F.col("realised").isNotNull())
        found = cells(stored(f, "variant"))
        one = mean_skills(sums_of(found, ["horizon"]), scoreable(found), ["horizon"]).select(F.lit(name).alias("variant"), "horizon", F.col("skill").alias("mean_skill"))
        out = one if out is None else out.unionByName(one)
    return out


_VARIANTS = " UNION ALL ".join(f"SELECT '{name}' AS variant, horizon, skill FROM ({_variant_sql(weight, strength)})" for name, weight, strength in _GRID)


@query(f"SELECT variant, horizon::INTEGER AS horizon, {r('skill')} AS mean_skill FROM ({_VARIANTS})")
def variant_grid(spark, sf_dir):
    """Two by two variants of the walk forward, blended or not and with firm or loose rates, scored alike."""
    return _variants(spark, sf_dir)


@query(f"SELECT horizon::INTEGER AS horizon, max_by(variant, (round(skill, 9), variant)) AS best FROM ({_VARIANTS}) GROUP BY 1")
def best_variant(spark, sf_dir):
    return _variants(spark, sf_dir).groupBy("horizon").agg(F.max_by("variant", F.struct(F.round("mean_skill", 9), "variant")).alias("best"))


@query(
    PANELS + f""", w2 AS (SELECT z.panel, z.month, z.i AS a, z.x AS b, k.state, CASE WHEN k.state = 0 THEN f.p ELSE 1 - f.p END AS w FROM pz z JOIN pf f USING (panel, month) CROSS JOIN (VALUES (0), (1)) k(state)),
    mu AS (SELECT panel, state, sum(w) AS n, sum(w * a) / sum(w) AS ma, sum(w * b) / sum(w) AS mb FROM w2 GROUP BY 1, 2 HAVING sum(w) >= 5)
    SELECT panel, state, {r('any_value(n)')} AS months, {r('sum(w * (a - ma) * (b - mb)) / sqrt(sum(w * (a - ma) * (a - ma)) * sum(w * (b - mb) * (b - mb)))')} AS correlation FROM w2 JOIN mu USING (panel, state) GROUP BY 1, 2"""
)
def residual_correlation(spark, sf_dir):
    """How two measures of a panel move together within a state, each month weighted by its chance; thin states are left out."""
    z = panel_matrices(spark, sf_dir)
    states = panel_states(spark, z).select("panel", "month", F.posexplode("filtered").alias("state", "w"))
    return scoring.weighted_correlation(z.join(states, ["panel", "month"]), ["panel", "state"], "inflation", "rates", "w", 5.0)


@query(
    W + f""", last AS (SELECT series_id, max_by(z, month) AS z FROM (SELECT series_id, month, CASE WHEN count(value) OVER w >= 36 AND stddev_samp(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_samp(value) OVER w END AS z FROM grid WINDOW w AS (PARTITION BY series_id ORDER BY month ROWS UNBOUNDED PRECEDING)) WHERE z IS NOT NULL GROUP BY 1)
    SELECT series_id, {r('z')} AS z, 'price ' || CASE WHEN z > 0.5 THEN 'high' WHEN z < -0.5 THEN 'low' ELSE 'middling' END AS label FROM last"""
)
def state_words(spark, sf_dir):
    """A state in words, by how far its mean lies from the usual."""
    z = transforms.expanding_scores(grid(spark, sf_dir)).where(F.col("z").isNotNull())
    return z.groupBy("series_id").agg(F.max_by("z", "month").alias("z")).withColumn("label", pr.label(("price", F.col("z"))))


# ---- the gates of each stage

_STAGES = f"""SELECT gate, requirement, passed FROM (
    SELECT 'data' AS gate, 'every series is there' AS requirement, count(DISTINCT series_id) = 5 AS passed FROM raw
    UNION ALL SELECT 'data', 'every series has five years of months', min(n) >= 60 FROM (SELECT count(value) AS n FROM grid GROUP BY series_id)
    UNION ALL SELECT 'data', 'every series ends in the same month', count(DISTINCT last) = 1 FROM (SELECT max(month) AS last FROM raw GROUP BY series_id)
    UNION ALL SELECT 'forecasts', 'every indicator has a forecast at every horizon', count(*) = 5 * 2 * {len(wf.HORIZONS)} FROM (SELECT DISTINCT {K} FROM fore)
    UNION ALL SELECT 'forecasts', 'every probability lies in the unit interval', coalesce(min(predicted) >= 0 AND max(predicted) <= 1, false) FROM fore
    UNION ALL SELECT 'forecasts', 'every forecast has its distance', count(distance) = count(*) FROM fore
    UNION ALL SELECT 'backtest', 'each forecast is there once', count(*) = 0 FROM (SELECT 1 FROM fore GROUP BY {K}, forecast_date HAVING count(*) > 1)
    UNION ALL SELECT 'backtest', 'outcomes have resolved', count(realised) > 0 FROM fore
    UNION ALL SELECT 'backtest', 'nothing later was known', count(*) FILTER (known_month >= forecast_date) = 0 FROM fore
    UNION ALL SELECT 'evaluation', 'a skill is defined at every horizon', count(DISTINCT horizon) = {len(wf.HORIZONS)} FROM (SELECT horizon FROM scored GROUP BY 1 HAVING sum(f) > 0))"""


@query(W + _STAGES)
def stage_gates(spark, sf_dir):
    """What each stage must have shown before the next begins."""
    months = tables.order_prices(spark, sf_dir)
    g, f = grid(spark, sf_dir), stored(wf.forecasts(spark, sf_dir), "forecasts")

    def check(gate: str, requirement: str, df: DataFrame, passed: Column) -> DataFrame:
        return df.agg(F.coalesce(passed, F.lit(False)).alias("passed")).select(F.lit(gate).alias("gate"), F.lit(requirement).alias("requirement"), "passed")

    all_ = [
        check("data", "every series is there", months, F.count_distinct("series_id") == 5),
        check("data", "every series has five years of months", g.groupBy("series_id").agg(F.count("value").alias("n")), F.min("n") >= 60),
        check("data", "every series ends in the same month", months.groupBy("series_id").agg(F.max("month").alias("last")), F.count_distinct("last") == 1),
        check("forecasts", "every indicator has a forecast at every horizon", f, F.count_distinct(*wf.KEYS) == 5 * 2 * len(wf.HORIZONS)),
        check("forecasts", "every probability lies in the unit interval", f, (F.min("predicted") >= 0) & (F.max("predicted") <= 1)),
        check("forecasts", "every forecast has its distance", f, F.count("distance") == F.count("*")),
        check("backtest", "each forecast is there once", f.groupBy(*wf.KEYS, "forecast_date").count().where("count > 1"), F.count("*") == 0),
        check("backtest", "outcomes have resolved", f, F.count("realised") > 0),
        check("backtest", "nothing later was known", f.where("known_month >= forecast_date"), F.count("*") == 0),
        check("evaluation", "a skill is defined at every horizon", f.where(F.col("realised").isNotNull()).groupBy("horizon").agg(F.sum(scoring.squared("reference")).alias("f")).where("f > 0"), F.count("*") == len(wf.HORIZONS)),
    ]
    out = all_[0]
    for part in all_[1:]:
        out = out.unionByName(part)
    return out
