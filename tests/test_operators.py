"""Operators against values worked out by hand."""

import datetime as dt
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from oracle import same
from tidemark.functions import probability as pr
from tidemark.operators import bootstrap, diff, outcomes, pointintime, scoring, timegrid, transforms
from tidemark.plans import library


def month(i, year=2000):
    return dt.date(year + i // 12, i % 12 + 1, 1)


def series(spark, values, key="s"):
    return spark.createDataFrame([(key, month(i), v) for i, v in enumerate(values)], "series_id string, month date, value double")


def column(df, name):
    return [r[name] for r in df.orderBy("month").collect()]


def test_five_percent_a_year(spark):
    grid = series(spark, [100 * 1.05 ** (i / 12) for i in range(30)])
    log = column(transforms.transformed(grid, transforms.LOG_CHANGE), "transformed")
    assert log[:12] == [None] * 12 and log[12] == pytest.approx(math.log(1.05)) and log[-1] == pytest.approx(math.log(1.05))
    percent = column(transforms.transformed(grid, transforms.PERCENT_CHANGE), "transformed")
    assert percent[20] == pytest.approx(5)


def test_no_logarithm_and_no_percentage(spark):
    grid = series(spark, [0.0, -1.0] + [1.0] * 12)
    assert column(transforms.transformed(grid, transforms.LOG_CHANGE), "transformed")[12:] == [None, None]
    percent = column(transforms.transformed(grid, transforms.PERCENT_CHANGE), "transformed")[12:]
    assert percent == [None, -200.0]


def test_an_unknown_transform_fails(spark):
    with pytest.raises(Exception, match="unknown transform"):
        transforms.transformed(series(spark, [1.0]), "square").collect()


def test_grid_gaps_and_bridges(spark):
    rows = [(0, 1.0), (2, 3.0), (5, 6.0), (6, 7.0)]
    df = spark.createDataFrame([("s", month(i), v) for i, v in rows], "series_id string, month date, value double")
    grid = timegrid.complete_grid(df)
    assert column(grid, "value") == [1.0, None, 3.0, None, None, 6.0, 7.0]
    gaps = {(r.first_month, r.last_month, r.months) for r in timegrid.gap_runs(grid).collect()}
    assert gaps == {(month(1), month(1), 1), (month(3), month(4), 2)}
    bridged = timegrid.bridged(grid)
    assert column(bridged, "value") == [1.0, 2.0, 3.0, None, None, 6.0, 7.0] and sum(column(bridged, "is_bridged")) == 1
    assert not timegrid.strictly_monthly(df).first().is_strict and timegrid.strictly_monthly(grid).first().is_strict


def test_last_row_of_a_month_stays(spark):
    df = spark.createDataFrame([("s", dt.date(2000, 1, 5), 1, 1.0), ("s", dt.date(2000, 1, 3), 2, 9.0)], "series_id string, observation_date date, position int, value double")
    assert timegrid.first_of_month_rows(df).first().value == 9.0


def test_expanding_scores_need_values_and_spread(spark):
    z = column(transforms.expanding_scores(series(spark, [1.0, None, 3.0, 5.0]), least=2), "z")
    assert z[0] is None and z[1] is None and z[2] == pytest.approx(1 / math.sqrt(2)) and z[3] == pytest.approx(1.0)
    assert column(transforms.expanding_scores(series(spark, [2.0] * 4), least=2), "z") == [None] * 4


def test_the_window_is_open_now_and_closed_at_the_horizon(spark):
    df = outcomes.condition(series(spark, [9.0, 0.0, 0.0, 9.0, 0.0]), 5.0)
    found = outcomes.outcomes(df, [2, 3]).orderBy("month").collect()
    at = {(r.composition, r.horizon, r.month): r.outcome for r in found}
    assert at["within_horizon", 2, month(0)] == 0.0  # holds now, and in the third month: neither counts
    assert at["within_horizon", 3, month(0)] == 1.0 and at["at_horizon", 3, month(0)] == 1.0
    assert at["within_horizon", 2, month(3)] is None  # not all of it is known, though nothing so far holds


def test_unknown_is_not_zero(spark):
    df = outcomes.condition(series(spark, [1.0, None, 9.0]), 5.0)
    assert column(df, "holds") == [0.0, None, 1.0]
    found = {(r.month, r.composition): r.outcome for r in outcomes.outcomes(df, [2]).collect()}
    assert found[month(0), "within_horizon"] is None and found[month(0), "at_horizon"] == 1.0


def test_a_lag_ends_on_its_day(spark):
    dates = spark.createDataFrame([(dt.date(2000, 2, 14),), (dt.date(2000, 2, 15),)], "as_of date")
    found = pointintime.published_by(series(spark, [1.0]), dates, 45)
    assert [r.as_of for r in found.collect()] == [dt.date(2000, 2, 15)]


def test_climatology_only_counts_what_is_published(spark):
    df = outcomes.condition(series(spark, [9.0, 9.0, 0.0, 0.0, 0.0, 0.0]), 5.0)
    found = outcomes.running_climatology(outcomes.outcomes(df, [1]).where("composition = 'at_horizon'"), ["series_id", "composition", "horizon"], 45)
    # the outcome of January is February's condition, published on 17 March: April is the first month to know it
    assert column(found, "climatology") == [None, None, None, 1.0, 0.5, pytest.approx(1 / 3)]


def test_policies(spark):
    rows = [("a", False, 500), ("b", True, 240), ("c", True, 239), ("d", True, None)]
    df = spark.createDataFrame(rows, "series_id string, is_revised boolean, vintage_values int")
    got = {r.series_id: r.policy for r in pointintime.vintage_policy(df).collect()}
    assert got == {"a": "unrevised", "b": "vintage", "c": "publication_lag_fallback", "d": "publication_lag_fallback"}


def test_announcements_only_delay(spark):
    told = spark.createDataFrame([(dt.date(2000, 2, 1), dt.date(2000, 12, 1))], "turning_point date, announced date")
    got = column(pointintime.published_with_announcements(series(spark, [1.0] * 3).select("series_id", "month"), told, 32), "published")
    assert got == [dt.date(2000, 2, 2), dt.date(2000, 12, 1), dt.date(2000, 12, 1)]


def value_of(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_chains_agree_with_stepping(spark):
    entry, stay = 0.1, 0.7
    p = miss = None
    p, missed = 1.0, 1.0
    state = [0.0, 1.0]
    for h in range(1, 6):
        p = p * stay + (1 - p) * entry
        state = [state[0] * (1 - entry) + state[1] * (1 - stay), 0.0] if h == 1 else [state[0] * (1 - entry), 0.0]
        args = [F.lit(1.0), F.lit(entry), F.lit(stay), F.lit(h)]
        assert value_of(spark, pr.chain_at(*args)) == pytest.approx(p)
        assert value_of(spark, pr.chain_within(*args)) == pytest.approx(1 - sum(state))
    assert missed == 1.0 and miss is None


def test_states_and_distances(spark):
    a = lambda *v: F.array(*map(F.lit, v))
    tm = F.array(a(0.9, 0.1), a(0.25, 0.75))
    assert value_of(spark, pr.stepped(a(1.0, 0.0), tm, F.lit(2))) == pytest.approx([0.835, 0.165])
    assert value_of(spark, pr.stepped(a(1.0, 0.0), tm, F.lit(0))) == [1.0, 0.0]
    assert value_of(spark, pr.total_variation(a(1.0, 0.0), a(0.4, 0.6))) == pytest.approx(0.6)
    assert value_of(spark, pr.within_horizon(a(1.0, 0.0), tm, a(0.0, 1.0), a(0.0, 1.0), F.lit(1))) == pytest.approx(0.1)
    assert value_of(spark, pr.half_life(F.lit(0.5))) == pytest.approx(1) and value_of(spark, pr.half_life(F.lit(1.0))) == math.inf
    assert value_of(spark, pr.shrunk(F.lit(3.0), F.lit(0.0), F.lit(0.2), 0.0)) == 0.2


def test_a_blend_refuses_what_is_no_probability(spark):
    with pytest.raises(Exception, match="not a probability"):
        value_of(spark, pr.blend(F.lit(1.2), F.lit(0.5)))


def test_bins_use_the_exact_edges(spark):
    got = [value_of(spark, scoring.bin_of(F.lit(p))) for p in (0.0, 0.1, 0.3, 0.6, 0.7, 0.95, 1.0)]
    assert got == [0, 1, 2, 5, 6, 9, 9]


def test_scores(spark):
    df = spark.createDataFrame([("k", 0.1, 0.0, 0.5), ("k", 0.4, 0.0, 0.5), ("k", 0.4, 1.0, 0.5), ("k", 0.8, 1.0, 0.5), ("k", 0.3, None, 0.5)], "k string, predicted double, realised double, reference double")
    assert scoring.area_under_curve(df, ["k"]).first().auc == pytest.approx(0.875)
    row = scoring.metric_table(df, ["k"]).first()
    assert row.brier_score == pytest.approx((0.01 + 0.16 + 0.36 + 0.04) / 4) and row.brier_skill == pytest.approx(1 - row.brier_score / 0.25)
    m = scoring.murphy(df, ["k"]).first()
    assert m.reliability - m.resolution + m.uncertainty + m.residual == pytest.approx(m.brier)
    one = df.where("realised = 1")
    assert scoring.area_under_curve(one, ["k"]).first().auc is None


def test_blocks_take_the_remainder_first(spark):
    df = spark.createDataFrame([("k", month(i)) for i in range(11)], "k string, d date")
    got = scoring.chronological_blocks(df, ["k"], "d").groupBy("block").count().orderBy("block").collect()
    assert [r["count"] for r in got] == [3, 3, 3, 2]


def test_resamples_have_all_dates_and_the_right_sums(spark):
    values = [float(v) for v in (3, 1, 4, 1, 5, 9, 2, 6)]
    df = spark.createDataFrame([("k", month(i), v) for i, v in enumerate(values)], "k string, d date, v double")
    got = {r.resample: r.v for r in bootstrap.resampled(df, ["k"], "d", ["v"], 3, 25).collect()}
    for rs in range(25):
        total = 0.0
        for k in range(3):
            a = int(hashlib.md5(f"{bootstrap.SEED}:k:{rs}:{k}".encode()).hexdigest()[:8], 16) % 6
            total += sum(values[a : a + min(3, 8 - 3 * k)])
        assert got[rs] == pytest.approx(total)
    two = df.withColumn("u", F.lit("a")).unionByName(df.where("v > 2").withColumn("u", F.lit("b")))  # b lacks some dates
    both = {(r.u, r.resample): r.v for r in bootstrap.resampled(two, ["k"], "d", ["v"], F.lit(3), 25, "u").collect()}
    assert all(both["a", rs] == pytest.approx(got[rs]) for rs in range(25)) and len(both) == 50
    one = bootstrap.interval(bootstrap.resampled(df, ["k"], "d", ["v"], 100, 30), ["k"], F.col("v")).first()
    assert one.lower == one.upper == sum(values)


def test_starts_are_uniform_and_resamples_differ(spark):
    df = spark.range(2000).select(F.col("id").alias("rs"), F.explode(F.array(*map(F.lit, range(8)))).alias("k"))
    rows = df.withColumn("a", bootstrap.start_of(F.lit(60), F.lit(1), F.lit("x"), F.col("rs"), F.col("k"))).collect()
    counts = [0] * 60
    for row in rows:
        counts[row.a] += 1
    expected = len(rows) / 60
    assert sum((c - expected) ** 2 / expected for c in counts) < 110  # chi-squared of 59 degrees
    draws = {}
    for row in rows:
        draws.setdefault(row.rs, {})[row.k] = row.a
    assert len({tuple(sorted(d.items())) for d in draws.values()}) == 2000


def test_many_horizons_give_what_a_few_give(spark):
    from tidemark.operators import outcomes as oc

    grid = oc.condition(series(spark, [float((i * 37) % 50) if i % 7 else None for i in range(40)]), 20.0)
    key = lambda df: {(r.series_id, r.month, r.composition, r.horizon): r.outcome for r in df.where("horizon <= 12").collect()}
    assert key(oc.outcomes(grid, list(range(1, 13)))) == key(oc.outcomes(grid, list(range(1, 21))))


def test_skill_takes_rows_that_have_all(spark):
    df = spark.createDataFrame([("k", 0.1, 0.0, 0.5), ("k", 0.9, 1.0, None), ("k", None, 1.0, 0.5), ("k", 0.5, None, 0.5)], "k string, predicted double, realised double, reference double")
    assert df.groupBy("k").agg(scoring.skill().alias("s")).first().s == pytest.approx(1 - 0.01 / 0.25)


def test_effective_counts_forgive_reversals(spark):
    rows = [(1, 0.15, float(i % 2)) for i in range(200)] + [(1, 0.85, float(i % 4 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "horizon int, predicted double, realised double")
    wide = spark.createDataFrame([(1, 50.0)], "horizon int, inflation double")
    assert scoring.reversals(df, ["horizon"]).first().reversals == 1
    assert scoring.reversals(df, ["horizon"], inflation=wide).first().reversals == 0


def test_bands(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 1.0), (4, None), (5, 1.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0), (2, 1.0 + 1e-10), (3, 2.0), (4, None), (6, 1.0)], "k int, v double")
    got = {r.k: r.band for r in diff.banded(a, b, ["k"], ["v"]).collect()}
    assert got == {1: "IDENTICAL", 2: "NUMERICAL", 3: "MOVED", 4: "IDENTICAL", 5: "REMOVED", 6: "ADDED"}
    assert {r.side: r.n for r in diff.key_split(a, b, ["k"]).collect()} == {"both": 4, "only_first": 1, "only_second": 1}


def test_sums_in_another_order_are_no_difference(spark, sf_dir, monkeypatch):
    made, real = [], library.grid

    def grid(*args):  # every aggregate after the first adds in another order
        made.append(real(*args))
        return made[-1].withColumn("value", F.col("value") * (1 + 1e-15 * (len(made) - 1)))

    monkeypatch.setattr(library, "grid", grid)
    assert same(spark, sf_dir, library.QUERIES["banded_field_diff"], library.SQL["banded_field_diff"]) and len(made) == 1


def test_the_audit_finds_a_leak(spark):
    from tidemark.operators import outcomes as oc
    from tidemark.plans import walkforward as wf

    grid = oc.condition(series(spark, [float(100 + (i * 37) % 50) for i in range(40)]), 120.0)
    cutoff = F.lit(month(20))
    changed = oc.condition(diff.perturbed(grid, F.date_add("month", wf.LAG_DAYS) > cutoff), 120.0)

    def made(g, leak):
        rates = wf.known_rates(g.withColumn("month", F.add_months("month", -leak)) if leak else g)
        return rates.where(F.col("month") <= F.add_months(cutoff, -leak)) if not leak else rates.where(F.col("month") <= cutoff)

    fields = ["known_month", "now", "entry", "stay"]
    assert diff.differing(made(grid, 0), made(changed, 0), ["series_id", "month"], fields).count() == 0
    assert diff.differing(made(grid, 6), made(changed, 6), ["series_id", "month"], fields).count() > 0
