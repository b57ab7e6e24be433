"""Recalibration, run records and the series service."""

import io
import urllib.error

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import calibration
from tidemark.sources import baseline, service, store


def test_a_calibrated_forecast_has_slope_one():
    rng = np.random.default_rng(0)
    p = rng.uniform(0.05, 0.95, 20_000)
    intercept, slope = calibration.logistic_line(p, (rng.random(20_000) < p).astype(float))
    assert intercept == pytest.approx(0, abs=0.06) and slope == pytest.approx(1, abs=0.06)
    assert calibration.logistic_line(np.full(5, 0.5), np.array([0.0, 1, 0, 1, 1])) is None
    assert calibration.logistic_line(np.array([0.2, 0.8]), np.array([1.0, 1.0])) is None
    assert calibration.logistic_line(np.array([0.2, 0.3, 0.8]), np.array([0.0, 0.0, 1.0])) is None  # separable


def test_pooling_neighbours():
    xs, ys = calibration.pooled_monotone(np.array([0.1, 0.2, 0.3, 0.4, 0.4]), np.array([0.0, 1.0, 0.0, 1.0, 1.0]))
    assert np.interp([0.1, 0.25, 0.4], xs, ys).tolist() == [0.0, 0.5, 1.0]
    assert (np.diff(ys) >= 0).all()


def test_recalibration_of_groups(spark):
    rows = [(h, f"2000-{m:02d}-01", 0.1 + 0.8 * ((m * h) % 7) / 7, float((m * 5 + h) % 3 == 0)) for h in (1, 2) for m in range(1, 13)] + [(3, "2000-01-01", 0.5, 1.0), (3, "2000-02-01", 0.5, None)]
    df = spark.createDataFrame(rows, "h int, d string, predicted double, realised double")
    got = {r.h: r for r in calibration.recalibrated(df, ["h"]).collect()}
    assert got[1].n == 12 and got[3].n == 1 and got[3].slope is None
    found = {r.h: r for r in calibration.slope_interval(df, ["h"], "h int", "d", 3, 50).collect()}
    assert found[1].lower <= found[1].upper and found[3].usable == 0 and found[3].lower is None
    better = calibration.monotone(df, ["h"], "h int").agg(F.avg((F.col("predicted") - F.col("realised")) ** 2).alias("a"), F.avg((F.col("recalibrated") - F.col("realised")) ** 2).alias("b")).first()
    assert better.b <= better.a


def test_run_records(spark, tmp_path):
    df = spark.createDataFrame([("i", "2000-01-01", 1, 0.12345), ("i", "2000-02-01", 1, 0.12335)], "indicator string, forecast_date string, horizon int, probability double").withColumn("forecast_date", F.col("forecast_date").cast("date"))
    path = str(tmp_path)
    baseline.capture(df, path, "one", "h1", 7)
    with pytest.raises(FileExistsError):
        baseline.capture(df, path, "one", "h1", 7)
    baseline.capture(df.limit(1), path, "one", "h2", 7, force=True)
    baseline.capture(df, path, "two", "h1", 7)
    assert {(r.name, r.forecasts, r.configuration_hash, r.seed) for r in baseline.listed(spark, path).collect()} == {("one", 1, "h2", 7), ("two", 2, "h1", 7)}
    assert baseline.read(spark, path, "two").count() == 2
    with pytest.raises(Exception):  # noqa: B017  a frame without the dates it is known by
        baseline.capture(df.drop("forecast_date"), path, "three", "h1", 7)
    assert not (tmp_path / "three").exists()
    baseline.submission(df, f"{path}/csv")
    text = next((tmp_path / "csv").glob("*.csv")).read_text().splitlines()
    assert text[1:] == ["i,2000-01-01,1,0.1234", "i,2000-02-01,1,0.1234"]


def answers(*given):
    left = list(given)

    def open_(url):
        x = left.pop(0)
        if isinstance(x, int):
            raise urllib.error.HTTPError(url, x, "", None, None)
        if isinstance(x, Exception):
            raise x
        return io.BytesIO(x)

    return open_


def test_patience():
    waits = []
    assert service.fetch("u", waits.append, answers(500, OSError(), b"ok")) == "ok" and waits == [1, 3]
    waits.clear()
    assert service.fetch("u", waits.append, answers(500, 429, 503, b"ok")) == "ok" and waits == [1, 5, 15]
    assert service.fetch("u", waits.append, answers(404)) is None
    with pytest.raises(urllib.error.HTTPError):
        service.fetch("u", waits.append, answers(500, 500, 500, 500))


def test_series_service(spark, tmp_path):
    (tmp_path / "A_.csv").write_text("observation_date,A\n2000-01-01,1.5\n2000-02-01,.\n")
    (tmp_path / "A_2000-03-01.csv").write_text("observation_date,A_20000301\n2000-01-01,1.4\n")
    (tmp_path / "A_1990-01-01.csv").write_text("observation_date\n")
    spark.dataSource.register(service.SeriesService)
    raw = spark.read.format("series_service").option("url", f"file://{tmp_path}/{{series_id}}_{{vintage_date}}.csv").option("requests", "A:,A:2000-03-01,A:1990-01-01").load()
    got = {(str(r.vintage_date), str(r.observation_date), r.value) for r in store.parse_delivered(raw).collect()}
    assert got == {("None", "2000-01-01", 1.5), ("None", "2000-02-01", None), ("2000-03-01", "2000-01-01", 1.4)}
    with pytest.raises(ValueError):
        list(service.parse("observation_date\n", "A", None))


def test_lines_side_by_side_are_those_one_by_one():
    rng = np.random.default_rng(8)
    p = np.clip(rng.random(60), 0.005, 0.995)
    x = np.log(p / (1 - p))
    for share in (0.5, 0.04):
        y = (rng.random(60) < share).astype(float)
        weights = np.stack([np.bincount(rng.integers(0, 60, 60), minlength=60) for _ in range(80)] + [np.zeros(60, int), np.eye(60, dtype=int)[0]]).astype(float)
        got, seen = calibration.logistic_lines(x, y, weights), 0
        for line, w in zip(got, weights.astype(int)):
            want = calibration.logistic_line(np.repeat(p, w), np.repeat(y, w)) if w.sum() else None
            assert np.isnan(line).all() if want is None else line == pytest.approx(want, abs=1e-8)
            seen += want is not None
        assert seen > 20


def test_a_line_far_from_the_forecasts_is_found(spark):
    rows = [(h, p, 1.0 if h == 2 else float(i < n)) for h in (1, 2) for p, n in ((0.006, 40), (0.01, 45)) for i in range(100)]
    df = spark.createDataFrame(rows, "horizon int, predicted double, realised double")
    logit = lambda p: np.log(p / (1 - p))
    one, none = sorted(calibration.recalibrated(df, ["horizon"]).collect())
    slope = (logit(0.45) - logit(0.40)) / (logit(0.01) - logit(0.006))
    assert one.slope == pytest.approx(slope) and one.intercept == pytest.approx(logit(0.45) - slope * logit(0.01))
    assert none.n == 200 and none.slope is None and none.intercept is None  # all outcomes alike
    one, all_alike = sorted(calibration.recalibrated(df, ["horizon"], steps=15, settled=False).collect())
    assert one.slope == pytest.approx(slope) and np.isfinite(all_alike.slope)
