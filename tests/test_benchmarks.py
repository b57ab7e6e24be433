"""Recalibration on held-out blocks, outcomes drawn by chance, quarters carried to months, and strengths, by plain loops."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import probability as pr
from tidemark.operators import calibration, crossfit, mixed, rates
from tidemark.plans import benchmarks, sweeps


def test_pools_are_the_nearest_rates_that_do_not_fall():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = rng.integers(1, 6, 12).astype(float)
        y = np.floor(rng.random(12) * (n + 1)).clip(0, n)
        got = crossfit.pooled(n, y)
        mean = lambda a, b: y[a : b + 1].sum() / n[a : b + 1].sum()
        want = [max(min(mean(a, b) for b in range(i, 12)) for a in range(i + 1)) for i in range(12)]
        assert got == pytest.approx(want) and (np.diff(got) >= -1e-12).all()


def test_ridge_line_is_where_the_penalised_likelihood_is_highest():
    rng = np.random.default_rng(2)
    x, n = rng.standard_normal(30), rng.integers(1, 9, 30).astype(float)
    y = np.floor(rng.random(30) * (n + 1)).clip(0, n)
    loss = lambda w: -(y * (w[0] + w[1] * x) - n * np.logaddexp(0, w[0] + w[1] * x)).sum() + 0.5 * crossfit.RIDGE * (w[0] ** 2 + (w[1] - 1) ** 2)
    line = crossfit.ridge_line(x, n, y)
    assert all(loss(line) <= loss(line + step) for step in 0.01 * rng.standard_normal((300, 2)))
    assert np.allclose(crossfit.ridge_line(x[:2], n[:2], n[:2]), crossfit.ridge_line(x[:2], n[:2], n[:2], steps=500)) and np.isfinite(crossfit.ridge_line(x[:2], n[:2], n[:2])).all()  # separable, yet held


def test_maps_are_fitted_on_the_other_blocks_alone(spark):
    rng = np.random.default_rng(3)
    rows = [(h, dt.date(2000, 1, 1) + dt.timedelta(days=31 * d), round(float(rng.random()), 3), float(rng.random() < 0.4)) for h in (1, 2) for d in range(22) for _ in range(4)]
    df = spark.createDataFrame(rows, "h int, d date, predicted double, realised double")
    got = {r.h: r for r in crossfit.crossfitted(df, "h", "d").collect()}
    for h in (1, 2):
        mine = pd.DataFrame([r for r in rows if r[0] == h], columns=["h", "d", "p", "y"])
        dates = sorted(mine["d"].unique())
        parts = np.array_split(np.arange(22), 4)  # earlier blocks take the remainder
        total = {"raw": 0.0, "ridge": 0.0, "monotone": 0.0}
        for part in parts:
            held = mine["d"].isin([dates[i] for i in part])
            fit, out = mine[~held], mine[held]
            logit = lambda p: np.log(np.clip(p, 0.005, 0.995) / (1 - np.clip(p, 0.005, 0.995)))
            a, b = crossfit.ridge_line(logit(fit["p"].to_numpy()), np.ones(len(fit)), fit["y"].to_numpy())
            bins = fit.groupby("p")["y"].agg(["count", "sum"]).sort_index()
            level = crossfit.pooled(bins["count"].to_numpy(float), bins["sum"].to_numpy(float))
            for p, y in zip(out["p"], out["y"]):
                below = np.flatnonzero(bins.index.to_numpy() <= p + 1e-12)
                total["raw"] += (p - y) ** 2
                total["ridge"] += (1 / (1 + math.exp(-(a + b * logit(np.array(p))))) - y) ** 2
                total["monotone"] += (level[below[-1] if len(below) else 0] - y) ** 2
        assert got[h].n == 88 and all(got[h][k] == pytest.approx(v / 88) for k, v in total.items())
    assert crossfit.crossfitted(df.where("false"), "h", "d").count() == 0


def test_outcomes_of_their_own_lines():
    rng = np.random.default_rng(4)
    x = rng.standard_normal(200)
    y = (rng.random((5, 200)) < 1 / (1 + np.exp(-x))).astype(float)
    together = calibration.logistic_lines(x, y, np.ones((5, 200)))
    for line, own in zip(together, y):
        assert line == pytest.approx(calibration.logistic_lines(x, own, np.ones((1, 200)))[0])


def test_right_forecasts_are_accepted_about_as_often_as_they_should(spark):
    rng = np.random.default_rng(5)
    rows = [("s", "at", 1, dt.date(1990, 1, 1) + dt.timedelta(days=i), float(p), 0.0) for i, p in enumerate(rng.uniform(0.05, 0.95, 400))]
    df = spark.createDataFrame(rows, "series_id string, composition string, horizon int, forecast_date date, predicted double, realised double")
    r = benchmarks.accepted_shares(df, 200).first()
    assert r.runs == r.fitted == 200 and 0.9 <= r.accepted <= 0.99 and abs(r.mean_slope - 1) < 0.05
    drawn = benchmarks.drawn_outcomes(df, 50).groupBy().agg(F.avg("realised").alias("y"), F.avg("predicted").alias("p")).first()
    assert abs(drawn.y - drawn.p) < 0.02


def test_normal_share_is_the_error_function(spark):
    x = [-40.0, -6.0, -3.3, -1.0, -1e-9, 0.0, 0.5, 1.96, 4.0, 6.0, 40.0]
    got = spark.createDataFrame([(v,) for v in x], "x double").select("x", pr.normal_share(F.col("x")).alias("p")).collect()
    assert all(r.p == pytest.approx(0.5 * math.erfc(-r.x / math.sqrt(2)), abs=1e-9) for r in got)


def test_quarters_are_carried_as_told(spark):
    q = [(1, 10.0), (4, 8.0), (7, 9.0), (13, 3.0), (16, 2.0)]  # a quarter is missing before the thirteenth month
    at = lambda m: dt.date(2000 + (m - 1) // 12, (m - 1) % 12 + 1, 1)
    df = spark.createDataFrame([("a", at(m), v) for m, v in q] + [("b", at(1), 1.0)], "series_id string, quarter date, value double")
    rows = mixed.falls(df, 30)
    got = {(r.series_id, r.quarter): (r.fell, r.told, r.known_share) for r in rows.collect()}
    assert [got["a", at(m)][0] for m, _ in q] == [None, 1.0, 0.0, None, 1.0] and got["b", at(1)][0] is None
    assert got["a", at(4)][1] == dt.date(2000, 7, 31) and got["a", at(16)][2] == pytest.approx(2 / 3)
    months = spark.createDataFrame([(s, at(m)) for s in "ab" for m in range(1, 25)], "series_id string, month date")
    known = {(r.series_id, r.month): r.quarter for r in mixed.carried(months, rows, "told", ["quarter", "fell"]).collect()}
    for s in "ab":
        for m in range(1, 25):
            told = [k[1] for k, v in got.items() if k[0] == s and v[1] <= at(m)]
            assert known[s, at(m)] == max(told, default=None)


def test_strengths_are_rates_from_the_same_counts(spark):
    rng = np.random.default_rng(6)
    rows = [("k", dt.date(2000 + i // 12, i % 12 + 1, 1), float(rng.random() < 0.4), rng.dirichlet(np.ones(2)).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, month date, holds double, weights array<double>")
    sums = rates.state_sums(df, ["k"]).withColumn("strength", F.explode(F.array(F.lit(2.0), F.lit(40.0))))
    many = {r.strength: r for r in rates.drawn_rates(sums, ["k", "strength"], F.col("strength")).collect()}
    for k in (2.0, 40.0):
        one = rates.shrunk_rates(df, ["k"], k).first()
        assert all(many[k][c] == one[c] for c in ("occupancy", "entry", "stay", "counts"))


def test_sweep_filters_the_states_once(spark, sf_dir, monkeypatch):
    from tidemark.plans import regimewalk

    calls, real = [], regimewalk.filtered
    monkeypatch.setattr(regimewalk, "filtered", lambda *a: calls.append(1) or real(*a))
    found = sweeps.shrinkage_sweep(spark, sf_dir)
    assert len(calls) == 1 and {r.strength for r in found.select("strength").distinct().collect()} == set(sweeps.STRENGTHS)


def test_burn_in_reads_the_first_months_alone(spark, sf_dir):
    rows = sweeps.burn_in_choice(spark, sf_dir).collect()
    assert len(rows) == len({r.panel for r in rows}) > 0 and all(r.months <= sweeps.BURN_IN for r in rows)
