"""Resampled means and runs against runs, by plain loops."""

import datetime as dt
import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bootstrap, runs


def made(seed, horizons=(1, 4), dates=23, units=5, holes=0.15):
    rng, rows = np.random.default_rng(seed), []
    for h in horizons:
        for d in range(dates):
            for u in range(units):
                if rng.random() > holes:
                    y = float(rng.random() < (0.0 if u == 0 else 0.4))  # the first unit never comes true: no skill is defined for it
                    rows.append((h, dt.date(2000, 1, 1) + dt.timedelta(days=31 * d), f"u{u}", y, *rng.random(3)))
    rng.shuffle(rows)
    return pd.DataFrame([tuple(r) for r in rows], columns=["horizon", "d", "unit", "y", "e", "f", "g"]).astype({"horizon": int, "y": float, "e": float, "f": float, "g": float})


def means_by_hand(df, keys, ratios, length, resamples):
    """{(key, resample): {name: mean or None}} with every block drawn, laid end to end and cut."""
    out = {}
    for key, rows in df.groupby(keys):
        dates = sorted(rows["d"].unique())
        n, size = len(dates), min(length(key), len(dates))
        ok = lambda r, f: len(r) >= 2 and 0.5 < r["y"].sum() < len(r) - 0.5 and r[f].sum() > 1e-12
        fixed = {name: [u for u, r in rows.groupby("unit") if ok(r, f)] for name, (_, f) in ratios.items()}
        by_date = {d: r for d, r in rows.groupby("d")}
        for rs in range(resamples):
            drawn = []
            for k in range(-(-n // size)):
                text = ":".join(map(str, (bootstrap.SEED, *key, rs, k)))
                a = int(hashlib.md5(text.encode()).hexdigest()[:8], 16) % (n - size + 1)
                drawn += dates[a : a + size]
            sample = pd.concat([by_date[d] for d in drawn[:n]])
            found = {}
            for name, (e, f) in ratios.items():
                parts = [sample[sample["unit"] == u] for u in fixed[name]]
                found[name] = float(np.mean([1 - p[e].sum() / p[f].sum() for p in parts])) if parts and all(ok(p, f) for p in parts) else None
            out[(*key, rs)] = found
    return out


@pytest.mark.parametrize("units, held", [(64, 4_000_000), (2, 50)])
def test_resampled_means_are_those_of_laying_blocks_end_to_end(spark, monkeypatch, units, held):
    monkeypatch.setattr(bootstrap, "UNITS", units)
    monkeypatch.setattr(bootstrap, "HELD", held)
    df, ratios = made(1), {"skill": ("e", "f"), "other": ("g", "f")}
    got = bootstrap.mean_ratios(spark.createDataFrame(df), ["horizon"], "d", "unit", ratios, F.col("horizon") + 1, 30).collect()
    want = means_by_hand(df, ["horizon"], ratios, lambda key: key[0] + 1, 30)
    assert len(got) == len(want) == 60
    for r in got:
        for name in ratios:
            assert getattr(r, name) == (None if want[r.horizon, r.resample][name] is None else pytest.approx(want[r.horizon, r.resample][name]))
    assert any(w["skill"] is not None for w in want.values())


def test_draws_of_the_task_are_those_of_the_column(spark):
    df = spark.range(40).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    got = {(r.id, r.k): r.a for r in df.withColumn("a", bootstrap.start_of(F.lit(17), F.lit(20), F.lit("b"), F.lit(6), F.col("id"), F.col("k"))).collect()}
    mine = bootstrap.starts(20, ("b", 6), range(40), 3, 17)
    assert all(mine[i, k] == a for (i, k), a in got.items())


def test_nothing_resampled(spark):
    empty = spark.createDataFrame(made(1)).where("false")
    assert bootstrap.mean_ratios(empty, ["horizon"], "d", "unit", {"skill": ("e", "f")}, F.lit(3), 10).count() == 0


RUN = "series_id string, composition string, horizon int, forecast_date date, predicted double, reference double, realised double"
KEYS = ["series_id", "composition", "horizon", "forecast_date"]


def run_of(seed, skip, perfect=None):
    """A run without the first `skip` dates; `perfect`: a series whose reference never errs, so that it has no skill."""
    rng, truth, rows = np.random.default_rng(seed), np.random.default_rng(99), []
    for h in (1, 3):
        for d in range(20):
            for s in "abc":
                y = float(truth.random() < 0.5)
                p, q = rng.random(2)
                q = y if s == perfect else q
                if d >= skip:
                    rows.append((s, "at", h, dt.date(2001, 1, 1) + dt.timedelta(days=31 * d), float(p), float(q), None if d == 19 else y))
    return rows


def test_two_runs_are_compared_on_what_they_share_each_by_its_own_indicators(spark):
    a, b = run_of(1, 0), run_of(2, 6, "b")
    first, second = (spark.createDataFrame(x, RUN).repartition(3) for x in (a, b))
    cells = runs.shared_cells(first, second, KEYS, F.concat("series_id", "composition"))
    got = {r.horizon: r for r in runs.paired(cells, F.col("horizon"), 300).collect()}
    left, right = ({x[:4]: x for x in rows if x[6] is not None} for rows in (a, b))
    rows = [(k[2], k[3], k[0] + k[1], left[k][6], (left[k][4] - left[k][6]) ** 2, (left[k][5] - left[k][6]) ** 2, (right[k][4] - right[k][6]) ** 2, (right[k][5] - right[k][6]) ** 2) for k in left.keys() & right.keys()]
    df = pd.DataFrame(rows, columns=["horizon", "d", "unit", "y", "ea", "fa", "eb", "fb"])
    want = means_by_hand(df, ["horizon"], runs.RATIOS, lambda key: key[0], 300)
    for h, r in got.items():
        mine = df[df["horizon"] == h]
        skill = lambda e, f, units: np.mean([1 - g[e].sum() / g[f].sum() for u, g in mine.groupby("unit") if u in units])
        assert (r.shared, r.baseline_units, r.current_units) == (39, 3, 2)
        assert r.baseline_skill == pytest.approx(skill("ea", "fa", {"aat", "bat", "cat"})) and r.current_skill == pytest.approx(skill("eb", "fb", {"aat", "cat"}))
        found = [w["current"] - w["baseline"] for (k, _), w in want.items() if k == h and None not in w.values()]
        assert r.usable == len(found) and r.difference == pytest.approx(r.current_skill - r.baseline_skill)
        assert [r.lower, r.upper] == pytest.approx(np.quantile(found, [0.05, 0.95]).tolist())
    told = {r.horizon: tuple(r)[1:] for r in runs.sides(first, second, KEYS, "horizon").collect()}
    assert told == {1: (39, 18, 0, 0), 3: (39, 18, 0, 0)}


def test_a_run_against_itself_differs_by_nothing(spark):
    a = spark.createDataFrame(run_of(1, 0), RUN)
    r = runs.paired(runs.shared_cells(a, a, KEYS, F.col("series_id")), F.lit(2), 100).first()
    assert r.difference == r.lower == r.upper == 0
    other = a.withColumn("realised", F.when(F.col("series_id") == "a", 1 - F.col("realised")).otherwise(F.col("realised")))
    assert all(x.unequal == 19 for x in runs.sides(a, other, KEYS, "horizon").collect())
