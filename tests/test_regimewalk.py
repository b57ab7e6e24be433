"""The regime walk forward's parts against plain loops, and its fits."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import probability as pr
from tidemark.operators import rates, regimes
from tidemark.plans import gates, regimewalk
from tidemark.sources import records



def plain_chain(d, tm, entry, stay, now, gap, horizon, at):
    off, on = (np.zeros_like(d), d) if now else (d, np.zeros_like(d))
    move = lambda o, n: ((o @ tm) * (1 - entry) + (n @ tm) * (1 - stay), (o @ tm) * entry + (n @ tm) * stay)
    for _ in range(gap):
        off, on = move(off, on)
    if at:
        for _ in range(horizon):
            off, on = move(off, on)
        return on.sum()
    left, _ = move(off, on)
    for _ in range(horizon - 1):
        left = (left @ tm) * (1 - entry)
    return 1 - left.sum()


def test_joint_chain_is_the_plain_loop(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for i in range(40):
        k = int(rng.integers(1, 5))
        d, tm = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k)
        entry, stay = rng.random(k), rng.random(k)
        now, gap, horizon, at = int(rng.integers(2)), int(rng.integers(0, 4)), int(rng.integers(1, 14)), bool(rng.integers(2))
        rows.append((i, d.tolist(), tm.tolist(), entry.tolist(), stay.tolist(), float(now), gap, horizon, at))
        want[i] = plain_chain(d, tm, entry, stay, now, gap, horizon, at)
    df = spark.createDataFrame(rows, "i int, d array<double>, tm array<array<double>>, entry array<double>, stay array<double>, now double, gap int, horizon int, at boolean")
    got = df.select("i", pr.joint_chain(*(F.col(c) for c in ("d", "tm", "entry", "stay", "now", "gap", "horizon", "at"))).alias("p")).collect()
    assert {r.i: r.p for r in got} == {i: pytest.approx(p) for i, p in want.items()}


def test_shrunk_rates_are_the_plain_sums(spark):
    rng = np.random.default_rng(5)
    y, w = (rng.random(40) < 0.4).astype(float), rng.dirichlet(np.ones(3), 40)
    rows = [("k", dt.date(2000 + i // 12, i % 12 + 1, 1), float(y[i]), w[i].tolist()) for i in range(40)]
    got = rates.shrunk_rates(spark.createDataFrame(rows, "k string, month date, holds double, weights array<double>"), ["k"], 10.0).first()
    before, now, later = y[:-1], y[1:], w[1:]
    shrink = lambda s, n, pool: (s + 10 * pool) / (n + 10)
    assert got.occupancy == pytest.approx(shrink(w.T @ y, w.sum(axis=0), y.mean()).tolist())
    for name, rows_ in (("entry", before == 0), ("stay", before == 1)):
        n, s = later[rows_].sum(axis=0), later[rows_].T @ now[rows_]
        assert getattr(got, name) == pytest.approx(shrink(s, n, now[rows_].mean()).tolist())
    assert got.counts == pytest.approx(w.sum(axis=0).tolist())


def test_rates_without_transitions(spark):
    rows = [("k", dt.date(2000, 1, 1), 1.0, [0.5, 0.5])]
    got = rates.shrunk_rates(spark.createDataFrame(rows, "k string, month date, holds double, weights array<double>"), ["k"]).first()
    assert got.entry == [0.0, 0.0] and got.stay == [1.0, 1.0] and got.occupancy == [1.0, 1.0]


def test_chains_fitted_together_are_those_fitted_apart_when_all_settle():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(m, 0.3, (60, 2)) for m in (0, 3, 0)])
    blocks = [x[:, :1], x[:, 1:]]
    (a, b), total = regimes.fit_together(blocks, regimes.starts_of(blocks, [2, 2], [1, 2], 1))
    assert total == pytest.approx(a.log_likelihood(x[:, :1]) + b.log_likelihood(x[:, 1:]))
    assert a.times(b).log_likelihood(x) == pytest.approx(total)
    assert a.means[0, 0] < a.means[1, 0] and abs(a.means[1, 0] - 3) < 0.2


def test_best_restart_is_kept(spark):
    rng = np.random.default_rng(7)
    months = [dt.date(2000 + i // 12, i % 12 + 1, 1) for i in range(90)]
    x = np.concatenate([rng.normal(m, 0.5, (30, 3)) for m in (0, 2, 0)])
    found = spark.createDataFrame([(dt.date(2008, 1, 1), m, *map(float, v)) for m, v in zip(months, x)], "as_of date, month date, growth double, inflation double, rates double")
    dates = spark.createDataFrame([(dt.date(2008, 1, 1), dt.date(2008, 1, 1))], "month date, refit date")
    model = regimewalk.fitted_models(found, dates, restarts=3).first()
    own = 20 + 2008 * 100 + 1
    blocks = [x[:, :1], x[:, 1:]]
    totals = [regimes.fit_together(blocks, [start])[1] for start in regimes.starts_of(blocks, [2, 2], [own, own + 1], 3)]
    assert model.log_likelihood == pytest.approx(max(totals)) and len(model.start) == 4 and sum(model.stationary) == pytest.approx(1)


def test_a_fitted_walk_forward_has_sound_rows(spark, sf_dir):
    rows = regimewalk.fitted_regime_walk_forward(spark, sf_dir).collect()
    assert rows and all(0 <= r.model <= 1 and 0 <= r.joint <= 1 and 0 <= r.distance <= 1 and r.effective_sample > 0 and r.refit <= r.forecast_date for r in rows)
    assert len({(r.series_id, r.composition, r.horizon, r.forecast_date) for r in rows}) == len(rows)


def test_means_over_a_fixed_set_need_all_of_it(spark):
    rows = [(1, "a", 1.0, 2.0, 1.0, 3.0, 10.0), (1, "b", 1.0, 2.0, 1.0, 0.0, 10.0), (2, "a", 1.0, 4.0, 2.0, 3.0, 10.0), (2, "b", 1.0, 2.0, 1.0, 5.0, 10.0)]
    sums = spark.createDataFrame([(3, *r) for r in rows], "horizon int, resample int, unit string, e double, f double, g double, y double, n double")
    units = spark.createDataFrame([(3, "a"), (3, "b")], "horizon int, unit string")
    got = {r.resample: r.skill for r in gates.mean_skills(sums, units, ["horizon", "resample"]).collect()}
    assert got == {1: None, 2: pytest.approx((0.75 + 0.5) / 2)}
    loose = {r.resample: r.skill for r in gates.mean_skills(sums, units, ["horizon", "resample"], whole=False).collect()}
    assert loose[1] == pytest.approx(0.5)


def test_the_audit_sees_a_planted_leak(spark, sf_dir):
    from tidemark.plans import audits

    assert audits.look_ahead_audit(spark, sf_dir).first().differing == 0
    assert audits.look_ahead_leak(spark, sf_dir).first().differing > 0


def test_records_and_rules(spark, tmp_path):
    (tmp_path / "r.csv").write_text("k,value\na,0.5\nb,0.25\nc,1\n")
    (tmp_path / "rule.json").write_text('{"least": 0.02,\n "most": 0.1}')
    recorded = records.read_records(spark, str(tmp_path / "r.csv"), "k string, value double")
    now = spark.createDataFrame([("a", 0.5), ("b", 0.2501)], "k string, value double")
    assert records.checked(recorded, now, ["k"]).first().asDict() == {"records": 3, "unknown": 1, "off": 1}
    assert records.read_rule(spark, str(tmp_path / "rule.json"), "least double, most double").first().most == 0.1
    with pytest.raises(ValueError):
        records.read_rule(spark, str(tmp_path / "rule.json"), "least double, other double")
    texts = spark.createDataFrame([(1, "up 1.25 and -1.25, then 3.1 and 9.999")], "k int, t string")
    numbers = records.numbers_of(texts, "k", "t", 2)
    known = spark.createDataFrame([(1.2512,), (-7.0,), (3.14,)], "value double")
    assert [r.shown for r in records.unsourced(numbers, known, 2).collect()] == ["-1.25"]


def test_a_forced_record_replaces_the_old_one_whole(spark, tmp_path):
    from tidemark.sources import baseline

    f = spark.createDataFrame([(dt.date(2000, 1, 1), 0.5)], "forecast_date date, predicted double")
    baseline.capture(f, str(tmp_path), "one", "h", 1)
    with pytest.raises(FileExistsError):
        baseline.capture(f, str(tmp_path), "one", "h", 2)
    bad = f.withColumn("predicted", F.raise_error(F.lit("no")))
    with pytest.raises(Exception):
        baseline.capture(bad, str(tmp_path), "one", "h", 3, force=True)
    assert [r.seed for r in baseline.listed(spark, str(tmp_path)).collect()] == [1]
    baseline.capture(f, str(tmp_path), "one", "h", 4, force=True)
    assert [r.seed for r in baseline.listed(spark, str(tmp_path)).collect()] == [4] and baseline.read(spark, str(tmp_path), "one").count() == 1
