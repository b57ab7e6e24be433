"""Models as documents, products of chains, smoothing and descriptions against numpy."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import algebra
from tidemark.operators import regimes
from tidemark.plans import documents
from tidemark.sources import models
from tidemark.sources.scratch import folder

MODEL = "start array<double>, transition array<array<double>>, means array<array<double>>, covariances array<array<array<double>>>"


def model_of(rng, k, d):
    a = rng.standard_normal((k, d, d))
    return regimes.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.standard_normal((k, d)) * 10.0 ** rng.integers(-200, 3), np.einsum("kij,klj->kil", a, a) + np.eye(d))


def frame(spark, found):
    return spark.createDataFrame([(i, *m.flat().values()) for i, m in enumerate(found)], "key int, " + MODEL)


def test_documents_read_back_to_the_last_bit(spark):
    rng = np.random.default_rng(1)
    found = [model_of(rng, k, d) for k in (1, 2, 4) for d in (1, 3)]
    found[0].means[0, 0] = 5e-324
    found[1].means[0] = [np.pi, -0.0, 1.7976931348623157e308]
    df = frame(spark, found).select("key", models.document(models.chain(["x"], *(F.col(p) for p in models.PARTS))).alias("document"))
    path = folder(spark, "test-models")
    models.write(df, path)
    for r in models.read(spark, path, "key int").collect():
        assert r.model_class == "single_chain" and r["columns"] == ["x"]
        for part in models.PARTS:
            want = getattr(found[r.key], part)
            assert np.array(r[part]).tobytes() == want.tobytes()


def test_two_chains_are_read_as_their_product(spark):
    rng = np.random.default_rng(2)
    a, b = model_of(rng, 2, 1), model_of(rng, 3, 2)
    both = frame(spark, [a]).join(frame(spark, [b]).toDF("key", *(f"b_{p}" for p in models.PARTS)), "key")
    doc = models.document(models.chain(["g"], *(F.col(p) for p in models.PARTS)), models.chain(["i", "r"], *(F.col(f"b_{p}") for p in models.PARTS)))
    r, want = models.parsed(both.select("key", doc.alias("document"))).first(), a.times(b)
    assert r.model_class == "two_chains" and r["columns"] == ["g", "i", "r"]
    assert all(np.array_equal(np.array(r[p]), getattr(want, p)) for p in models.PARTS)


def test_first_version_is_read_and_unknown_ones_are_refused(spark):
    parts = {"columns": ["x"], "start": [1.0], "transition": [[1.0]], "means": [[0.5]], "covariances": [[[2.0]]]}
    chain = dict(parts)
    read = lambda *texts: models.parsed(spark.createDataFrame([(t,) for t in texts], "document string")).collect()
    old, new = read(json.dumps(parts), json.dumps({"version": 2, "model_class": "single_chain", "chains": [chain]}))
    assert old == new and old.covariances == [[[2.0]]]
    for bad in (
        json.dumps({"version": 2, "model_class": "three_chains", "chains": [chain]}), json.dumps({"version": 3, "model_class": "single_chain", "chains": [chain]}),
        json.dumps({"version": 2, "model_class": "two_chains", "chains": [chain]}), json.dumps({"version": 2, "model_class": "single_chain"}), "no document", "{}",
    ):
        with pytest.raises(Exception, match="known class"):
            read(bad)
    with pytest.raises(ValueError):
        models.document()


def test_products_are_kroneckers(spark):
    rng = np.random.default_rng(3)
    a, b = rng.standard_normal((2, 3)), rng.standard_normal((4, 2))
    row = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<array<double>>, b array<array<double>>").select(algebra.kron_matrix(F.col("a"), F.col("b")).alias("k")).first()
    assert np.array_equal(np.array(row.k), np.kron(a, b))
    states = spark.range(1, 6).select(F.col("id").cast("int").alias("k"))
    assert [r.n for r in states.select(algebra.free_parameters(F.col("k"), F.lit(3)).alias("n")).collect()] == [regimes.Model(np.zeros(k), np.zeros((k, k)), np.zeros((k, 3)), np.zeros((k, 3, 3))).free_parameters() for k in range(1, 6)]
    assert spark.range(1).select(algebra.row_error(F.array(F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(0.25), F.lit(0.5)))).alias("e")).first().e == 0.25


def test_second_moduli_of_matrices_of_several_sizes(spark):
    rng = np.random.default_rng(4)
    found = [rng.dirichlet(np.ones(k), k) for k in (1, 2, 5, 2, 3, 5)]
    df = spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(found)] + [(9, None)], "i int, m array<array<double>>")
    got = {r.i: r.second for r in documents.second_moduli(df, {"second": "m"}).collect()}
    assert got[9] is None and got[0] == 0
    assert all(got[i] == pytest.approx(np.sort(np.abs(np.linalg.eigvals(m)))[-2]) for i, m in enumerate(found) if len(m) > 1)
    pairs = [(a, b) for a in found for b in found]  # the identity, on any two chains
    joint = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(pairs)], "i int, a array<array<double>>, b array<array<double>>").withColumn("j", algebra.kron_matrix(F.col("a"), F.col("b")))
    for r in documents.second_moduli(joint, {"x": "a", "y": "b", "z": "j"}).collect():
        assert r.z == pytest.approx(max(r.x, r.y), abs=1e-9)


@pytest.mark.parametrize("k, d", [(1, 1), (2, 1), (3, 2)])
def test_smoothing_and_descriptions_are_those_in_numpy(spark, k, d):
    rng = np.random.default_rng(10 * k + d)
    names = [f"x{i}" for i in range(d)]
    m = model_of(rng, k, d)
    m.means = rng.standard_normal((k, d))
    if k > 2:
        m.transition[0] = [0.5, 0.5, 0.0]
    x, natural = rng.standard_normal((25, d)), rng.standard_normal((25, d)) * 100
    df = spark.createDataFrame([(0, t, *map(float, v)) for t, v in enumerate(x)], "key int, t int, " + ", ".join(f"{n} double" for n in names))
    told = spark.createDataFrame([(0, t, *map(float, v)) for t, v in enumerate(natural)], df.schema)
    states = regimes.smoothed_states(df, frame(spark, [m]), ["key"], ["key"], "t", names)
    want = m.smoothed(x)
    assert np.allclose([r.smoothed for r in states.orderBy("t").collect()], want, atol=1e-10)
    for r in regimes.described(states, told, frame(spark, [m]), ["key"], ["key"], "t", names).collect():
        w = want[:, r.state]
        assert r.share == pytest.approx(w.mean()) and r.duration == pytest.approx(1 / (1 - min(m.transition[r.state, r.state], 1 - 1e-12)))
        assert [r[f"mean_{n}"] for n in names] == pytest.approx((w @ natural / w.sum()).tolist())
        assert r.label == regimes.regime_label(*zip(names, m.means[r.state])) and r.means == m.means[r.state].tolist()
