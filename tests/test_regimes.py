"""Hidden Markov models against enumeration of all paths, and the stream that carries their state."""

import itertools

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import regimes
from tidemark.operators.regimes import Model
from tidemark.streaming import streams


@pytest.fixture
def model():
    return Model(np.array([0.6, 0.4]), np.array([[0.9, 0.1], [0.3, 0.7]]), np.array([[0.0], [2.0]]), np.array([[[1.0]], [[0.5]]]))


def paths(model, x):
    e = np.exp(model.emissions(x))
    for path in itertools.product(range(2), repeat=len(x)):
        p = model.start[path[0]] * e[0, path[0]]
        for t in range(1, len(x)):
            p *= model.transition[path[t - 1], path[t]] * e[t, path[t]]
        yield path, p


def test_against_all_paths(model):
    x = np.array([[0.1], [1.9], [2.2], [-0.3], [0.8]])
    found = list(paths(model, x))
    total = sum(p for _, p in found)
    assert model.log_likelihood(x) == pytest.approx(np.log(total))
    assert model.viterbi(x).tolist() == list(max(found, key=lambda f: f[1])[0])
    smooth = np.zeros((5, 2))
    for path, p in found:
        for t, k in enumerate(path):
            smooth[t, k] += p / total
    assert model.smoothed(x) == pytest.approx(smooth)
    assert model.filtered(x)[-1] == pytest.approx(smooth[-1])
    assert model.filtered(x)[:3] == pytest.approx(model.filtered(x[:3]))  # what comes later changes nothing


def test_long_run_and_projection(model):
    rest = model.stationary()
    assert rest @ model.transition == pytest.approx(rest) and rest.sum() == pytest.approx(1)
    assert model.second_modulus() == pytest.approx(0.6)
    assert model.projected(np.array([1.0, 0.0]), 500) == pytest.approx(rest)
    with pytest.raises(ValueError):
        model.projected(rest, -1)


def test_a_fit_finds_its_states():
    rng = np.random.default_rng(0)
    states = [0]
    for _ in range(599):
        states.append(states[-1] if rng.random() < 0.95 else 1 - states[-1])
    x = np.where(np.array(states)[:, None] == 0, -2.0, 2.0) + rng.standard_normal((600, 1))
    found, total = regimes.fit(x, 2, seed=1)
    assert found.means[:, 0] == pytest.approx([-2, 2], abs=0.3) and np.diag(found.transition) == pytest.approx([0.95, 0.95], abs=0.04)
    again, same = regimes.fit(x, 2, seed=1)
    assert same == total and (again.means == found.means).all()
    assert regimes.fit(x, 1, seed=1)[1] < total
    assert (found.viterbi(x) == np.array(states)).mean() > 0.97


def plain_em(x, model, iterations, tolerance, ridge):
    """EM from one start, a row and a state at a time."""
    last = -np.inf
    for _ in range(iterations):
        e = np.exp(model.emissions(x))
        k, n = e.shape[1], len(x)
        a, b, total = np.zeros((n, k)), np.ones((n, k)), 0.0
        for t in range(n):  # scaled, not in logarithms
            for j in range(k):
                a[t, j] = e[t, j] * (model.start[j] if t == 0 else sum(a[t - 1, i] * model.transition[i, j] for i in range(k)))
            total += np.log(a[t].sum())
            a[t] /= a[t].sum()
        for t in range(n - 2, -1, -1):
            for i in range(k):
                b[t, i] = sum(model.transition[i, j] * e[t + 1, j] * b[t + 1, j] for j in range(k))
            b[t] /= b[t].sum()
        if abs(total - last) <= tolerance * max(1.0, abs(total)):
            break
        last = total
        gamma = a * b / (a * b).sum(axis=1, keepdims=True)
        pairs = np.zeros((k, k))
        for t in range(n - 1):
            p = a[t][:, None] * model.transition * (e[t + 1] * b[t + 1])[None, :]
            pairs += p / p.sum()
        means = (gamma.T @ x) / gamma.sum(axis=0)[:, None]
        cov = np.array([((gamma[:, i, None] * (x - means[i])).T @ (x - means[i])) / gamma[:, i].sum() + np.eye(x.shape[1]) * ridge for i in range(k)])
        model = regimes.Model(gamma[0], pairs / pairs.sum(axis=1, keepdims=True), means, cov)
    return model


def test_starts_that_step_together_are_those_that_step_alone():
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(m, 0.7, (25, 2)) for m in (0, 2, 0)])
    starts = [[regimes.start_point(x, 2, np.random.default_rng(i))] for i in range(4)]
    ridge = max(regimes.RIDGE * np.trace(regimes.pooled_covariance(x)) / 2, 1e-12)
    totals = []
    for start in starts:
        (mine,), total = regimes.fit_together([x], [start], 40)
        plain = plain_em(x, start[0], 40, regimes.TOLERANCE, ridge).ordered()
        assert np.allclose(mine.means, plain.means, atol=1e-6) and np.allclose(mine.transition, plain.transition, atol=1e-6) and np.allclose(mine.covariances, plain.covariances, atol=1e-6)
        assert total == pytest.approx(mine.log_likelihood(x))
        totals.append(total)
    assert regimes.fit_together([x], starts, 40)[1] == pytest.approx(max(totals))


def test_products(model):
    joint = model.times(model)
    x = np.array([[0.1, 1.0], [1.9, 0.2], [2.2, 2.0]])
    assert joint.log_likelihood(x) == pytest.approx(model.log_likelihood(x[:, :1]) + model.log_likelihood(x[:, 1:]))
    assert joint.transition.sum(axis=1) == pytest.approx(np.ones(4))
    assert joint.second_modulus() == pytest.approx(model.second_modulus())


def test_labels():
    assert regimes.regime_label(("growth", 0.7), ("rates", -0.6), ("prices", 0.5)) == "growth high, rates low, prices middling"


def stream_rows(spark, n, keys, shuffle):
    """(series_id, at, x): rows of several series a minute apart, moved about by up to `shuffle` places."""
    rng = np.random.default_rng(9)
    rows = [(f"s{i % keys}", int(i) * 60_000_000 + int(rng.integers(1000)), float(x)) for i, x in enumerate(rng.standard_normal(n))]
    rows = [rows[i] for i in np.argsort(np.arange(n) + rng.uniform(0, shuffle, n), kind="stable")]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["series_id", "us", "x"])).select("series_id", F.timestamp_micros("us").alias("at"), "x")
    return rows, df


def told_in_batch(rows, model):
    want = {}
    for key in {r[0] for r in rows}:
        mine = sorted(r[1:] for r in rows if r[0] == key)
        for (us, _), f in zip(mine, model.filtered(np.array([x for _, x in mine])[:, None])):
            want[key, us] = f
    return want


def test_stream_of_fifty_thousand_shuffled_rows_in_several_files_is_the_batch_filter(spark, model, tmp_path):
    rows, df = stream_rows(spark, 50_000, 4, 50_000)
    late = "40 days"  # the whole span: every order is possible
    source = streams.closed(df, late, str(tmp_path / "in"), files=6, files_a_trigger=2)
    got = streams.run_once(streams.filtered(source, model, ["x"], late), "append").select("series_id", F.unix_micros("at").alias("us"), "filtered").toPandas()
    want = told_in_batch(rows, model)
    assert len(got) == len(want) == 50_000
    mine = np.stack([want[k, us] for k, us in zip(got["series_id"], got["us"])])
    assert np.abs(np.stack(got["filtered"]) - mine).max() < 1e-9


def test_stream_tells_rows_as_the_watermark_passes_and_leaves_late_ones_out(spark, model, tmp_path):
    rows, df = stream_rows(spark, 600, 2, 30)  # out of order by half an hour at most
    parts = np.array_split(np.arange(600), 4)
    numbered = spark.createDataFrame(pd.DataFrame(rows, columns=["series_id", "us", "x"]).assign(part=np.concatenate([[k] * len(p) for k, p in enumerate(parts)]))).select("part", "series_id", F.timestamp_micros("us").alias("at"), "x")
    late_row = spark.createDataFrame([("s0", 5, 99.0)], "series_id string, us long, x double").select("series_id", F.timestamp_micros("us").alias("at"), "x")
    stamp = 1_000_000_000
    path = tmp_path / "in"
    for k in range(4):
        part = numbered.where(f"part = {k}").drop("part")
        (part if k < 3 else part.union(late_row)).coalesce(1).write.mode("append").parquet(str(path))
        for file in path.glob("*.parquet"):
            if file.stat().st_mtime > stamp + 1000:  # the new one
                os.utime(file, (stamp + k, stamp + k))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))
    out = streams.run_once(streams.filtered(source, model, ["x"], "1 hour"), "append")
    got = out.select("series_id", F.unix_micros("at").alias("us"), "filtered").collect()
    want = told_in_batch(rows, model)
    reached = max(r[1] for r in rows) - 3_600_000_000
    assert {(r.series_id, r.us) for r in got} == {k for k in want if k[1] <= reached // 1000 * 1000}  # what the watermark passed, without the late row
    assert all(np.abs(np.array(r.filtered) - want[r.series_id, r.us]).max() < 1e-9 for r in got)


def test_stream_tells_each_row_once(spark, model, tmp_path):
    _, df = stream_rows(spark, 300, 3, 300)
    source = streams.closed(df, "1 day", str(tmp_path / "in"), files=4, files_a_trigger=1)
    out = streams.run_once(streams.filtered(source, model, ["x"], "1 day"), "append")
    assert out.count() == 300 == out.select("series_id", "at").distinct().count()


def test_stream_drops_repeated_claims(spark, tmp_path):
    rows = [(i % 3, "2000-01-01 00:00:00") for i in range(9)]
    spark.createDataFrame(rows, "k int, at string").select("k", F.col("at").cast("timestamp").alias("at")).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("k int, at timestamp").parquet(str(tmp_path / "in"))
    assert streams.run_once(streams.first_claims(source, ["k"], "at"), "append").count() == 3
