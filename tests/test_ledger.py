"""Rules as documents, identities of runs, long runs and paths against plain computations."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import regimes, timegrid
from tidemark.plans import gates, ledger, sweeps
from tidemark.sources import baseline, models, records


def test_rules_are_read_from_their_document(tmp_path):
    assert gates.LEAST_SKILL == gates.RULES["rule_0001"]["least_skill"] and set(gates.RULES) >= {"rule_0001", "skill_curve", "regime_model"}
    path = tmp_path / "rules.json"
    path.write_text('{"schema_version": 1, "a": {"x": 0.5, "y": 2}}')
    assert records.rule_file(str(path)) == {"a": {"x": 0.5, "y": 2}}
    for bad in ('{"a": {"x": 1}}', '{"schema_version": 2, "a": {"x": 1}}', '{"schema_version": 1, "a": {"x": "1"}}', '{"schema_version": 1, "a": {"x": true}}', '{"schema_version": 1, "a": 3}', "[1]"):
        path.write_text(bad)
        with pytest.raises(ValueError):
            records.rule_file(str(path))
    with pytest.raises(FileNotFoundError):
        records.rule_file(str(tmp_path / "none.json"))


def test_a_run_of_two_configurations_is_refused(spark):
    rows = spark.sql("SELECT date'2000-01-01' AS forecast_date, date'2000-01-01' AS refit, double(1) AS realised UNION ALL SELECT date'2000-02-01', date'2000-01-01', null")
    one = ledger.identity(ledger.stamped(rows)).first()
    assert (one.dates, one.refits, one.forecasts, one.resolved, one.seed, one.state_count) == (2, 1, 2, 1, 20, 2)
    for column in ("configuration_hash", "seed", "state_count"):
        mixed = ledger.stamped(rows).withColumn(column, F.when(F.month("forecast_date") == 1, F.col(column)).otherwise(F.concat(F.col(column).cast("string"), F.lit("1")).cast(dict(ledger.stamped(rows).dtypes)[column])))
        with pytest.raises(Exception, match=f"{column} has 2 values"):
            ledger.identity(mixed).collect()


def test_long_runs_stay_as_they_are(spark):
    rng = np.random.default_rng(1)
    found = [rng.dirichlet(np.ones(k), k) for k in (1, 2, 4)] + [np.eye(2)[[1, 0]]]
    df = spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(found)], "i int, m array<array<double>>")
    for r in regimes.long_runs(df, "m").collect():
        d = np.array(r.long_run)
        assert d.sum() == pytest.approx(1) and np.allclose(d @ found[r.i], d, atol=1e-9)


def test_given_models_are_scored_as_in_numpy(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(m, 0.4, 15) for m in (0, 3, 0)])
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "series_id string, month int, x double")
    for r in sweeps.given_fits(df).collect():
        start, transition, z = sweeps._CHAINS[r.states]
        sd = x.std()
        m = regimes.Model(np.array(start), np.array(transition), (x.mean() + np.array(z) * sd)[:, None], np.full((r.states, 1, 1), sd * sd))
        out = int(45 * sweeps.HELD_OUT)
        assert r.log_likelihood == pytest.approx(m.log_likelihood(x[:, None])) and r.information_criterion == pytest.approx(m.information_criterion(x[:, None]))
        assert r.held_out_per_month == pytest.approx((m.log_likelihood(x[:, None]) - m.log_likelihood(x[:-out, None])) / out) and r.free_parameters == m.free_parameters()
        assert r.smallest_share == pytest.approx(m.filtered(x[:, None]).mean(axis=0).min())
    switched = ledger.flicker(df, spark.createDataFrame([("s", 2)], "series_id string, states int")).first()
    path = (m2 := regimes.Model(np.array([0.5, 0.5]), np.array(sweeps._CHAINS[2][1]), (x.mean() + np.array([-0.5, 0.5]) * x.std())[:, None], np.full((2, 1, 1), x.var()))).filtered(x[:, None]).argmax(axis=1)
    assert (switched.switches, switched.months) == (int((np.diff(path) != 0).sum()), 45) and len(m2.start) == 2


def test_path_is_the_best_of_all(spark):
    rng = np.random.default_rng(3)
    model = regimes.Model(np.array([0.5, 0.5]), np.array([[0.95, 0.05], [0.1, 0.9]]), np.array([[-0.5], [0.5]]), np.ones((2, 1, 1)))
    x = rng.normal(0, 1.5, (9, 1))
    e = model.emissions(x)
    score = lambda p: np.log(0.5) + sum(e[t, s] for t, s in enumerate(p)) + sum(np.log(model.transition[a, b]) for a, b in zip(p, p[1:]))
    assert tuple(model.viterbi(x)) == max(itertools.product(range(2), repeat=9), key=score)


def test_a_submission_of_another_structure_is_refused(spark, tmp_path):
    frame = lambda *rows: spark.createDataFrame(list(rows), "name string, states int")
    approved = frame(("growth", 4), ("levels", 4))
    assert baseline.structure_differences(frame(("levels", 4), ("growth", 4)), approved).isEmpty()
    wrong = baseline.structure_differences(frame(("growth", 3), ("rates", 2)), approved)
    assert {tuple(r) for r in wrong.collect()} == {("growth", 4, 3), ("levels", 4, None), ("rates", None, 2)}
    rows = spark.createDataFrame([("i", 1, 0.5)], "indicator string, horizon int, probability double")
    with pytest.raises(PermissionError, match="growth has 3 states for 4"):
        baseline.submission(rows, str(tmp_path / "s"), "0001", differences=wrong.where("name = 'growth'"))
    assert not (tmp_path / "s").exists()
    baseline.submission(rows, str(tmp_path / "s"), "0001", differences=wrong.limit(0))
    assert (tmp_path / "s").exists()


def test_fits_are_kept_by_what_they_were_fitted_on(spark, tmp_path):
    path, asked = str(tmp_path / "fits"), []

    def fit(lacking):
        asked.append(sorted(r.key for r in lacking.collect()))
        return lacking.select("digest", models.document(models.chain(["x"], F.array(F.lit(1.0)), F.array(F.array(F.lit(1.0))), F.array(F.array(F.element_at("rows", 1)["x"])), F.array(F.array(F.array(F.lit(1.0)))))).alias("document"))

    panels = lambda *rows: spark.createDataFrame([(k, [(1, x)]) for k, x in rows], "key string, rows array<struct<t: int, x: double>>")
    read = lambda df: {r.key: r.means[0][0] for r in models.parsed(df.select("key", "document")).collect()}
    held, told = models.get_or_fit(panels(("a", 1.0), ("b", 2.0), ("c", 1.0)), "s", path, fit)
    assert read(held) == {"a": 1.0, "b": 2.0, "c": 1.0} and told.first()[:2] == (3, 0) and len(asked[0]) == 2  # equal panels are fitted once
    held, told = models.get_or_fit(panels(("a", 1.0), ("b", 5.0)), "s", path, fit)  # b was revised
    assert read(held) == {"a": 1.0, "b": 5.0} and told.first()[:2] == (2, 1) and asked[1] == ["b"]
    assert models.get_or_fit(panels(("a", 1.0)), "other settings", path, fit)[1].first().hits == 0
    assert models.get_or_fit(panels(("a", 1.0), ("b", 5.0)), "s", path, fit)[1].first().hit_rate == 1.0 and len(asked) == 3


def test_months_one_after_another(spark):
    rows = [("a", "2000-01-01"), ("a", "2000-02-01"), ("a", "2000-03-01"), ("b", "2001-05-01")]
    frame = lambda rows: spark.createDataFrame(rows, "series_id string, month string").withColumn("month", F.col("month").cast("date"))
    assert timegrid.asserted_monthly(frame(rows)).count() == 4 and len(timegrid.asserted_monthly(frame(rows)).collect()) == 4
    for more in (("a", "2000-05-01"), ("b", "2001-05-01")):
        with pytest.raises(Exception, match="one after another"):
            timegrid.asserted_monthly(frame([*rows, more])).collect()
