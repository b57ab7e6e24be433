"""Recalibration of probabilities: logistic lines and monotone maps, fitted for each key.

A key's line is fitted by aggregates, a step at a time.  Resampled lines and monotone maps see all forecasts of their key, one
for each date, indicator and horizon it covers, so they are grouped pandas functions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import forget, stored
from .bootstrap import SEED, starts

LOW, HIGH = 0.005, 0.995


def logistic_line(p: np.ndarray, y: np.ndarray, steps: int = 100, tolerance: float = 1e-10) -> tuple[float, float] | None:
    """(intercept, slope) of the log odds of y on those of p; none where either doesn't vary or nothing converges."""
    p = np.clip(p, LOW, HIGH)
    x = np.log(p / (1 - p))
    if len(y) < 2 or y.min() == y.max() or x.std() < 1e-12:
        return None
    design, w = np.stack([np.ones_like(x), x], axis=1), np.array([0.0, 1.0])
    for _ in range(steps):
        q = 0.5 + 0.5 * np.tanh(0.5 * (design @ w))
        h = (design * (q * (1 - q))[:, None]).T @ design
        if not np.isfinite(w).all() or np.linalg.cond(h) > 1e14:
            return None
        step = np.linalg.solve(h, design.T @ (y - q))
        w = w + step
        if np.abs(step).max() < tolerance:
            return float(w[0]), float(w[1])
    return None


def pooled_monotone(p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forecasts and the non-decreasing rates nearest to their outcomes, by pooling neighbours that fall."""
    own, of = np.unique(p, return_inverse=True)  # equal forecasts are one, whatever their outcomes
    blocks: list[list[float]] = []  # sum, count, first, last forecast
    for x, v, n in zip(own, np.bincount(of, y), np.bincount(of)):
        blocks.append([v, n, x, x])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    xs = np.array([e for b in blocks for e in (b[2], b[3])])
    ys = np.array([b[0] / b[1] for b in blocks for _ in range(2)])
    keep = np.append(True, xs[1:] > xs[:-1])
    return xs[keep], ys[keep]


def recalibrated(df: DataFrame, keys: list[str], steps: int = 100, tolerance: float = 1e-10, settled: bool = True) -> DataFrame:
    """(keys, n, intercept, slope) of each key's line; null where there is none.  Unless only `settled` lines are asked for,
    one that the steps don't settle, as outcomes that are all alike have none, is what they came to.

    The steps start from (0, 0), where all forecasts weigh alike; from a slope of one they may run away where outcomes are
    far from the forecasts.
    Each of Newton's steps is one aggregate over the stored forecasts for all keys that still move, whose lines (one row a
    key) come back to the driver: no key's forecasts are brought together.
    """
    spark, p = df.sparkSession, F.least(F.greatest("predicted", F.lit(LOW)), F.lit(HIGH))
    known = df.where(F.col("predicted").isNotNull() & F.col("realised").isNotNull())
    rows = stored(known.select(*keys, F.ln(p / (1 - p)).alias("_x"), F.col("realised").alias("_y")), "recalibration")
    kinds = dict(rows.dtypes)
    told = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_y").alias("low"), F.max("_y").alias("high"), F.stddev_pop("_x").alias("spread")).collect()
    counts = {tuple(r[k] for k in keys): r.n for r in told}
    going = {tuple(r[k] for k in keys): (0.0, 0.0) for r in told if r.spread >= 1e-12 and (r.low < r.high or not settled)}
    found: dict[tuple, tuple[float, float]] = {}
    names = ", ".join(f"{k} {kinds[k]}" for k in keys)
    for _ in range(steps):
        if not going:
            break
        lines = spark.createDataFrame([(*k, *line) for k, line in going.items()], f"{names}, _a double, _b double")  # one row a key
        x, q = F.col("_x"), 1 / (1 + F.exp(-(F.col("_a") + F.col("_b") * F.col("_x"))))
        w, r = q * (1 - q), F.col("_y") - q
        sums = rows.join(F.broadcast(lines), keys).groupBy(*keys).agg(*(F.sum(c).alias(n) for n, c in (("a", w), ("b", w * x), ("c", w * x * x), ("g", r), ("h", r * x))))
        for row in sums.collect():
            key = tuple(row[k] for k in keys)
            h = np.array([[row.a, row.b], [row.b, row.c]])
            det = row.a * row.c - row.b * row.b
            if not np.isfinite(h).all() or det == 0 or settled and np.linalg.cond(h) > 1e14:
                del going[key]
                continue
            step = np.array([row.c * row.g - row.b * row.h, row.a * row.h - row.b * row.g]) / det
            line = going[key] = tuple((np.array(going[key]) + step).tolist())
            if np.abs(step).max() < tolerance:
                found[key] = line
                del going[key]
    found |= {} if settled else going
    forget(rows)
    out = [(*k, n, *found.get(k, (None, None))) for k, n in counts.items()]
    return spark.createDataFrame(out, f"{names}, n long, intercept double, slope double")


def logistic_lines(x: np.ndarray, y: np.ndarray, weights: np.ndarray, steps: int = 100, tolerance: float = 1e-10) -> np.ndarray:
    """(resamples, 2): intercept and slope of the log odds of y on x for each row of weights (how often each forecast was
    drawn), all by Newton's steps side by side; nan where either doesn't vary or nothing converges.  Outcomes are the
    same for all rows, or a row each."""
    y, total = np.broadcast_to(y, weights.shape), weights.sum(axis=1)
    mean = (weights @ x) / np.maximum(total, 1)
    spread = np.sqrt(np.maximum((weights @ (x * x)) / np.maximum(total, 1) - mean * mean, 0))
    positive, out, line = (weights * y).sum(axis=1), np.full((len(weights), 2), np.nan), np.tile([0.0, 1.0], (len(weights), 1))
    going = np.flatnonzero((total >= 2) & (positive > 0) & (positive < total) & (spread >= 1e-7))
    for _ in range(steps):
        if not len(going):
            break
        w, l = weights[going], line[going]
        q = 0.5 + 0.5 * np.tanh(0.5 * (l[:, :1] + l[:, 1:] * x))
        d, r = w * (q * (1 - q)), w * (y[going] - q)
        a, b, c = d.sum(axis=1), d @ x, d @ (x * x)
        g, h = r.sum(axis=1), r @ x
        det, half = a * c - b * b, 0.5 * np.sqrt((a - c) ** 2 + 4 * b * b)
        large, small = 0.5 * (a + c) + half, 0.5 * (a + c) - half  # the eigenvalues
        sound = np.isfinite(l).all(axis=1) & (small > 0) & (large <= 1e14 * small)
        going, det, a, b, c, g, h = (v[sound] for v in (going, det, a, b, c, g, h))
        step = np.stack([(c * g - b * h) / det, (a * h - b * g) / det], axis=1)
        line[going] += step
        done = np.abs(step).max(axis=1) < tolerance if len(step) else np.empty(0, bool)
        out[going[done]] = line[going[done]]
        going = going[~done]
    return out


#: Resamples of one group, and numbers a group holds at once.
BATCH, HELD = 2500, 2_000_000


def slope_interval(df: DataFrame, keys: list[str], key_schema: str, date: str, block: int | Column, resamples: int = 10_000, level: float = 0.95, seed: int = SEED) -> DataFrame:
    """(keys, slope, lower, upper, usable): an interval by drawing blocks of consecutive dates, the same as the bootstrap
    of sums draws.  A resample is weights of the forecasts, and a task fits `BATCH` of a key's side by side; null where
    too few of them have a line."""
    rows = df.where(F.col("predicted").isNotNull() & F.col("realised").isNotNull()).select(*keys, F.col(date).alias("_date"), (block if isinstance(block, Column) else F.lit(block)).cast("int").alias("_block"), "predicted", "realised")
    batches = rows.withColumn("_batch", F.explode(F.sequence(F.lit(-1), F.lit((resamples - 1) // BATCH))))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_date", "predicted"])
        dates, number = np.unique(rows["_date"].to_numpy(), return_inverse=True)
        p, y = np.clip(rows["predicted"].to_numpy(), LOW, HIGH), rows["realised"].to_numpy()
        x = np.log(p / (1 - p))
        *own, batch = key
        if batch < 0:  # all dates, once
            slopes = logistic_lines(x, y, np.ones((1, len(x))))[:, 1]
        else:
            n, size, slopes = len(dates), min(int(rows["_block"].iloc[0]), len(dates)), []
            drawn, each = range(batch * BATCH, min(resamples, (batch + 1) * BATCH)), max(1, HELD // len(x))
            for first in range(drawn.start, drawn.stop, each):
                some = range(first, min(drawn.stop, first + each))
                a = starts(seed, tuple(own), some, -(-n // size), n - size + 1)
                at = (a[:, :, None] + np.arange(size)).reshape(len(some), -1)[:, :n]
                times = np.stack([np.bincount(r, minlength=n) for r in at])
                slopes.append(logistic_lines(x, y, times[:, number].astype(float))[:, 1])
            slopes = np.concatenate(slopes)
        return pd.DataFrame({**dict(zip(keys, own)), "whole": batch < 0, "x": slopes})

    found = batches.groupBy(*keys, "_batch").applyInPandas(run, f"{key_schema}, whole boolean, x double")
    each = F.when(~F.col("whole") & ~F.isnan("x"), F.col("x"))
    ends = F.when(F.count(each) >= max(20, resamples / 100), F.percentile(each, F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))))
    out = found.groupBy(*keys).agg(F.max(F.when(F.col("whole"), F.nanvl("x", F.lit(None)))).alias("slope"), ends.alias("ends"), F.count(each).alias("usable"))
    return out.select(*keys, "slope", F.col("ends")[0].alias("lower"), F.col("ends")[1].alias("upper"), "usable")


def monotone(df: DataFrame, keys: list[str], key_schema: str) -> DataFrame:
    """Every forecast with its monotone recalibration."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        xs, ys = pooled_monotone(rows["predicted"].to_numpy(), rows["realised"].to_numpy())
        return rows.assign(recalibrated=np.interp(rows["predicted"], xs, ys))

    rows = df.where(F.col("predicted").isNotNull() & F.col("realised").isNotNull()).select(*keys, "predicted", "realised")
    return rows.groupBy(*keys).applyInPandas(run, f"{key_schema}, predicted double, realised double, recalibrated double")


def probit_line(x: np.ndarray, y: np.ndarray, steps: int = 50, tolerance: float = 1e-8) -> tuple[float, float] | None:
    """(intercept, slope) of a probit of y on x, by scoring; none where either doesn't vary or nothing converges."""
    if len(y) < 2 or y.min() == y.max() or x.std() < 1e-12:
        return None
    design, w = np.stack([np.ones_like(x), (x - x.mean()) / x.std()], axis=1), np.zeros(2)
    for _ in range(steps):
        z = np.clip(design @ w, -6, 6)
        p = np.clip(normal_share(z), 1e-9, 1 - 1e-9)
        d = np.exp(-0.5 * z * z) / np.sqrt(2 * np.pi)
        weight = d * d / (p * (1 - p))
        step = np.linalg.lstsq((design * weight[:, None]).T @ design, design.T @ (d * (y - p) / (p * (1 - p))), rcond=None)[0]
        w = w + np.clip(step, -1, 1)
        if np.abs(step).max() < tolerance:
            break
    else:
        return None
    slope = w[1] / x.std()
    return float(w[0] - slope * x.mean()), float(slope)


def normal_share(z: np.ndarray) -> np.ndarray:
    """The share of a normal distribution below z."""
    return 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(np.asarray(z) / math.sqrt(2)))


def expanding_probit(grid: DataFrame, ahead: int, lag_days: int, least: int = 24) -> DataFrame:
    """(series_id, month, predicted): a probit of the condition `ahead` months on, on the value, fitted at each month on
    the pairs published by then.  A task fits one series' months in order; null before `least` pairs."""
    w = Window.partitionBy("series_id").orderBy("month")
    rows = grid.select("series_id", "month", "value", F.lead("holds", ahead).over(w).alias("y"), F.date_add(F.add_months("month", ahead), lag_days).alias("told"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("month").reset_index(drop=True)
        x, y, out = rows["value"].to_numpy(float), rows["y"].to_numpy(float), []
        for month in rows["month"]:
            known = (rows["told"] <= month).to_numpy() & np.isfinite(y)
            line = probit_line(x[known], y[known]) if known.sum() >= least else None
            out.append(None if line is None else float(normal_share(np.array([line[0] + line[1] * x[len(out)]]))[0]))
        return pd.DataFrame({"series_id": rows["series_id"], "month": rows["month"], "predicted": pd.array(out, dtype="Float64")})

    return rows.groupBy("series_id").applyInPandas(run, "series_id string, month date, predicted double")
