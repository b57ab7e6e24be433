"""The forward recursion in column expressions against the same in numpy, and by enumeration."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import filtering
from tidemark.operators import rates, regimes

MODEL = "start array<double>, transition array<array<double>>, means array<array<double>>, covariances array<array<array<double>>>"


def model_of(rng, k, d, holes=False):
    a = rng.standard_normal((k, d, d))
    t = rng.dirichlet(np.ones(k), k)
    if holes and k > 2:
        t[0, 1] = 0
        t /= t.sum(axis=1, keepdims=True)
    start = np.eye(k)[0] if holes else rng.dirichlet(np.ones(k))
    return regimes.Model(start, t, rng.standard_normal((k, d)), np.einsum("kij,klj->kil", a, a) + np.eye(d))


@pytest.mark.parametrize("k, d, holes", [(1, 1, False), (2, 1, False), (3, 2, True), (4, 3, False)])
def test_filter_is_the_one_in_numpy(spark, k, d, holes):
    rng = np.random.default_rng(k * 10 + d)
    names, rows, want, models = [f"x{i}" for i in range(d)], [], {}, []
    for key in range(3):
        m, x = model_of(rng, k, d, holes), 3 * rng.standard_normal((17 + key, d))
        models.append((key, *m.flat().values()))
        rows += [(key, t, *map(float, v)) for t, v in enumerate(x)]
        want[key] = (m.filtered(x), m.log_likelihood(x))
    rows += [(0, 99, *[None] * d), (7, 0, *[1.0] * d)]  # a row without values; a group without a model
    rng.shuffle(rows)
    df = spark.createDataFrame([tuple(r) for r in rows], "key int, t int, " + ", ".join(f"{n} double" for n in names))
    got = regimes.filtered_states(df, spark.createDataFrame(models, "key int, " + MODEL), ["key"], ["key"], "t", names).orderBy("key", "t").collect()
    for key, (f, total) in want.items():
        mine = [r for r in got if r.key == key]
        assert np.allclose([r.filtered for r in mine], f, atol=1e-12) and mine[-1].log_likelihood == pytest.approx(total)
    assert {r.key for r in got} == {0, 1, 2}


def test_likelihood_is_the_sum_over_all_paths(spark):
    rng = np.random.default_rng(3)
    m, x = model_of(rng, 2, 1), rng.standard_normal((5, 1))
    e = np.exp(m.emissions(x))
    total = sum(m.start[p[0]] * np.prod([m.transition[a, b] for a, b in zip(p, p[1:])]) * np.prod([e[t, s] for t, s in enumerate(p)]) for p in itertools.product(range(2), repeat=5))
    df = spark.createDataFrame([("a", t, float(v[0])) for t, v in enumerate(x)], "key string, t int, x double")
    models = spark.createDataFrame([("a", *m.flat().values())], "key string, " + MODEL)
    last = regimes.filtered_states(df, models, ["key"], ["key"], "t", ["x"]).orderBy(F.desc("t")).first()
    assert last.log_likelihood == pytest.approx(np.log(total))


def test_what_comes_later_changes_nothing_and_far_rows_do_not_underflow(spark):
    rng = np.random.default_rng(4)
    m = model_of(rng, 2, 1)
    x = [0.1, -0.3, 900.0, -900.0, 0.2]
    models = spark.createDataFrame([("a", *m.flat().values())], "key string, " + MODEL)
    read = lambda n: [r.filtered for r in regimes.filtered_states(spark.createDataFrame([("a", t, v) for t, v in enumerate(x[:n])], "key string, t int, x double"), models, ["key"], ["key"], "t", ["x"]).orderBy("t").collect()]
    assert read(5)[:3] == read(3) and np.allclose(read(5), m.filtered(np.array(x)[:, None])) and np.allclose(np.sum(read(5), axis=1), 1)


def test_the_filter_needs_no_python_worker(spark):
    df = spark.createDataFrame([("a", 1, 0.5)], "key string, t int, x double")
    models = spark.createDataFrame([("a", [0.5, 0.5], [[0.9, 0.1], [0.2, 0.8]], [[0.0], [1.0]], [[[1.0]], [[1.0]]])], "key string, " + MODEL)
    plan = regimes.filtered_states(df, models, ["key"], ["key"], "t", ["x"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_log_sum_exp_and_logs_of_nothing(spark):
    row = spark.sql("SELECT array(double('-Infinity'), double('-Infinity')) AS a, array(1000D, 1000D) AS b, 0D AS z").select(
        filtering.log_sum_exp(F.col("a")).alias("a"), filtering.log_sum_exp(F.col("b")).alias("b"), filtering.safe_ln(F.col("z")).alias("z")
    ).first()
    assert row.a == -np.inf and row.b == pytest.approx(1000 + np.log(2)) and row.z == -np.inf


def test_exact_sums_do_not_depend_on_the_order(spark):
    rng = np.random.default_rng(5)
    x = rng.random(2000) * 10.0 ** rng.integers(-9, 3, 2000)
    sums = set()
    for seed in range(4):
        df = spark.createDataFrame([(float(v),) for v in np.random.default_rng(seed).permutation(x)], "x double").repartition(seed + 1)
        sums.add(df.agg(rates.exact_sum(F.col("x"))).first()[0])
    assert len(sums) == 1 and sums.pop() == pytest.approx(x.sum())
