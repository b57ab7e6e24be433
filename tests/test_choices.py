"""Choices among models, probits, pooled ties, and the store's copies and fetches, against values worked out by hand."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import calibration, regimes
from tidemark.sources import baseline, service, store

FITS = "series_id string, states int, held_out_per_month double, information_criterion double, shortest_duration double, smallest_share double"


def test_existence_and_choices(spark):
    rows = [("a", 1, -1.0, 100.0, 1.0, 1.0), ("a", 2, -0.9, 90.0, 5.0, 0.4), ("a", 3, -0.8, 80.0, 2.0, 0.3), ("a", 4, -0.85, 95.0, 4.0, 0.1), ("b", 1, -1.0, 50.0, 1.0, 1.0), ("b", 2, -0.5, 60.0, 1.0, 0.01)]
    df = spark.createDataFrame(rows, FITS)
    got = {r.series_id: (r.on_holdout, r.on_criterion, r.exist) for r in regimes.existence(df).collect()}
    assert got == {"a": (True, True, True), "b": (True, False, False)}
    found = {r.series_id: (r.states, r.runner_up, r.by_criterion) for r in regimes.choices(df).collect()}
    assert found == {"a": (4, 2, 3), "b": (1, None, 1)}  # three states of a flicker, two of b are hardly there


def test_ties_are_pooled_before_neighbours():
    xs, ys = calibration.pooled_monotone(np.array([0.1, 0.1, 0.1, 0.5, 0.5]), np.array([1.0, 0.0, 0.0, 0.0, 1.0]))
    assert np.interp([0.1, 0.5], xs, ys) == pytest.approx([1 / 3, 0.5])


def test_probit_finds_the_line_it_was_drawn_from():
    rng = np.random.default_rng(1)
    x = rng.normal(3, 2, 4000)
    y = (rng.random(4000) < calibration.normal_share(-1 + 0.5 * x)).astype(float)
    a, b = calibration.probit_line(x, y)
    assert a == pytest.approx(-1, abs=0.15) and b == pytest.approx(0.5, abs=0.05)
    assert calibration.probit_line(x, np.ones(4000)) is None and calibration.probit_line(np.ones(5), np.array([0.0, 1, 0, 1, 0])) is None


def test_expanding_probit_knows_only_what_was_told(spark):
    months = [dt.date(2000 + i // 12, i % 12 + 1, 1) for i in range(60)]
    rng = np.random.default_rng(2)
    v, h = rng.normal(0, 1, 60), (rng.random(60) < 0.5).astype(float)
    frame = lambda h: spark.createDataFrame([("a", m, float(x), float(y)) for m, x, y in zip(months, v, h)], "series_id string, month date, value double, holds double")
    told = lambda h: {r.month: r.predicted for r in calibration.expanding_probit(frame(h), 3, 45, 20).collect()}
    changed = h.copy()
    changed[50:] = 1 - changed[50:]
    one, two = told(h), told(changed)
    assert all(one[m] == two[m] for m in months[:51]) and one[months[10]] is None and one[months[40]] is not None


def test_requests_are_paced():
    now, waits = [0.0], []

    def pause(s):
        waits.append(s)
        now[0] += s

    open_ = service.Paced(lambda url: url, pause, lambda: now[0])
    assert [open_(x) for x in "abc"] == ["a", "b", "c"]
    assert waits == [pytest.approx(service.BETWEEN)] * 2


def test_lanes_keep_the_pace_together():
    asked = []
    for lane in range(3):
        now = [0.0]

        def pause(s, now=now):
            now[0] += s

        open_ = service.Paced(lambda url, now=now: asked.append(now[0]), pause, lambda now=now: now[0], lanes=3, lane=lane)
        for _ in range(10):
            open_("url")
    gaps = np.diff(sorted(asked))
    assert len(asked) == 30 and gaps.min() == pytest.approx(service.BETWEEN)


def test_the_store_fetches_what_it_lacks_and_copies(spark, tmp_path):
    def rows(name, *values):
        return spark.createDataFrame([(name, None, dt.date(2000, k + 1, 1), v) for k, v in enumerate(values)], store.OBSERVATIONS)

    path, asked = str(tmp_path / "s"), []
    store.write(rows("a", 1.0, None), path)
    wanted = spark.createDataFrame([("a", None), ("b", None)], "series_id string, vintage_date date")

    def fetch(lacking):
        asked.append(sorted(r.series_id for r in lacking.collect()))
        return rows("b", 5.0)

    held, told = store.get_or_fetch(wanted, path, fetch)
    assert held.count() == 3 and told.first().asDict() == {"lookups": 2, "hits": 1, "hit_rate": 0.5} and asked == [["b"]]
    _, told = store.get_or_fetch(wanted, path, fetch)
    assert told.first().hit_rate == 1.0 and asked == [["b"]]
    store.copy(spark, path, str(tmp_path / "t"), F.col("observation_date") > dt.date(2000, 1, 15))
    store.copy(spark, path, str(tmp_path / "u"))
    values = lambda p: sorted(((r.series_id, r.observation_date.month, r.value) for r in store.read(spark, str(p)).collect()), key=str)
    assert values(tmp_path / "u") == values(path) == values(tmp_path / "t") == [("a", 1, 1.0), ("a", 2, None), ("b", 1, 5.0)]
    assert store.verified(spark, str(tmp_path / "t")).count() == 0


def test_submissions_have_a_manifest_and_need_approval(spark, tmp_path):
    df = spark.createDataFrame([("i", 12, 0.5), ("j", 6, 0.25)], "indicator string, horizon int, probability double")
    with pytest.raises(PermissionError):
        baseline.submission(df, str(tmp_path / "no"), approved=False)
    baseline.submission(df, str(tmp_path / "yes"), "rule one")
    found = json.loads(next((tmp_path / "yes-manifest").glob("*.json")).read_text())
    assert found == {"rule": "rule one", "rows": 2, "indicators": 2, "horizons": [6, 12]} and not (tmp_path / "no").exists()
