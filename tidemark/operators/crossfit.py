"""Recalibration out of sample: maps fitted on all blocks of dates but one and scored on that one.

Forecasts are summed to bins of their value first, with partial aggregates, so a fit reads at most `BINS` + 1 rows of a key
however many forecasts it has.  The monotone map pools neighbouring bins that fall; the ridge line is the log odds
of the outcome on those of the forecast, held to the line of no change.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scoring
from .calibration import HIGH, LOW

BINS, RIDGE = 1000, 1.0


def pooled(n: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The non-decreasing rates nearest to those of the bins, in order, by merging neighbours that fall."""
    pools: list[list[float]] = []
    for count, total in zip(n, y):
        pools.append([total, count, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            a, b, c = pools.pop()
            pools[-1] = [pools[-1][0] + a, pools[-1][1] + b, pools[-1][2] + c]
    return np.repeat([p[0] / p[1] for p in pools], [p[2] for p in pools])


def ridge_line(x: np.ndarray, n: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 100, tolerance: float = 1e-12) -> np.ndarray:
    """(intercept, slope) of the log odds on x, of n trials with y successes each, by penalised Newton steps: the penalty is on
    how far the line is from (0, 1), so there always is one."""
    design, line, at = np.stack([np.ones_like(x), x], axis=1), np.array([0.0, 1.0]), np.array([0.0, 1.0])
    for _ in range(steps):
        q = 0.5 + 0.5 * np.tanh(0.5 * (design @ line))
        gradient = design.T @ (y - n * q) - ridge * (line - at)
        step = np.linalg.solve((design * (n * q * (1 - q))[:, None]).T @ design + ridge * np.eye(2), gradient)
        line = line + step
        if np.abs(step).max() < tolerance:
            break
    return line


def log_odds(bins: np.ndarray) -> np.ndarray:
    p = np.clip(bins / BINS, LOW, HIGH)
    return np.log(p / (1 - p))


def crossfitted(rows: DataFrame, key: str, date: str, blocks: int = 4) -> DataFrame:
    """(key, n, raw, ridge, monotone): mean squared errors on held-out blocks of dates, of the forecasts as they are and of
    both maps.  A bin that the other blocks lack takes the map's value of the next lower bin they have, or of their
    first."""
    kind = dict(rows.dtypes)[key]
    found = scoring.usable(rows, "predicted", "realised").select(key, date, "predicted", "realised")
    sums = scoring.chronological_blocks(found, [key], date, blocks).groupBy(key, "block", F.round(F.col("predicted") * BINS).cast("int").alias("bin")).agg(
        F.count("*").cast("double").alias("n"), F.sum("realised").alias("y"), F.sum(scoring.squared("predicted")).alias("raw")
    )
    own = F.col("block") == F.col("held")
    both = sums.withColumn("held", F.explode(F.sequence(F.lit(1), F.lit(blocks)))).groupBy(key, "held", "bin").agg(
        *(F.sum(F.when(own, F.col(c)).otherwise(0.0)).alias(f"{c}_out") for c in ("n", "y", "raw")), *(F.sum(F.when(~own, F.col(c)).otherwise(0.0)).alias(f"{c}_in") for c in ("n", "y"))
    )

    def run(names: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bin")
        fit, held = rows[rows["n_in"] > 0], rows[rows["n_out"] > 0]
        if fit.empty or held.empty:
            return pd.DataFrame(columns=[key, "n", "raw", "ridge", "monotone"])
        line = ridge_line(log_odds(fit["bin"].to_numpy()), fit["n_in"].to_numpy(), fit["y_in"].to_numpy())
        levels = pooled(fit["n_in"].to_numpy(), fit["y_in"].to_numpy())
        at = np.maximum(np.searchsorted(fit["bin"].to_numpy(), held["bin"].to_numpy(), side="right") - 1, 0)
        n, y = held["n_out"].to_numpy(), held["y_out"].to_numpy()
        error = lambda q: float((n * q * q - 2 * q * y + y).sum())  # noqa: E731  (outcomes are 0 or 1)
        straight = 1 / (1 + np.exp(-(line[0] + line[1] * log_odds(held["bin"].to_numpy()))))
        return pd.DataFrame([(names[0], float(n.sum()), float(held["raw_out"].sum()), error(straight), error(levels[at]))], columns=[key, "n", "raw", "ridge", "monotone"])

    each = both.groupBy(key, "held").applyInPandas(run, f"{key} {kind}, n double, raw double, ridge double, monotone double")
    n = F.sum("n")
    return each.groupBy(key).agg(n.cast("long").alias("n"), *((F.sum(c) / n).alias(c) for c in ("raw", "ridge", "monotone")))
