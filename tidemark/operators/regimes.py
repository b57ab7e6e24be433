"""Hidden Markov models with Gaussian emissions, fitted and read for each group of rows.

A fit needs all months of one series together and runs over them many times, so it is a grouped pandas
function; groups (refit date, number of states, restart) are independent and spread over the cluster.
A group is one series' months, a few hundred rows, whatever the size of the raw tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import filtering

FLOOR = 1e-8
RIDGE = 1e-6


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.squeeze(np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top, axis=axis)


def safe_log(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(x)


@dataclass
class Model:
    start: np.ndarray  # K
    transition: np.ndarray  # K x K
    means: np.ndarray  # K x D
    covariances: np.ndarray  # K x D x D

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Log density of each row (T) under each state (K)."""
        out = np.empty((len(x), len(self.means)))
        for k, (m, c) in enumerate(zip(self.means, self.covariances)):
            root = np.linalg.cholesky(c)
            y = np.linalg.solve(root, (x - m).T)
            out[:, k] = -0.5 * ((y * y).sum(axis=0) + 2 * np.log(np.diag(root)).sum() + x.shape[1] * np.log(2 * np.pi))
        return out

    def forward(self, e: np.ndarray) -> np.ndarray:
        a, log_t = np.empty_like(e), safe_log(self.transition)
        a[0] = safe_log(self.start) + e[0]
        for t in range(1, len(e)):
            a[t] = e[t] + log_sum(a[t - 1][:, None] + log_t, 0)
        return a

    def backward(self, e: np.ndarray) -> np.ndarray:
        b, log_t = np.zeros_like(e), safe_log(self.transition)
        for t in range(len(e) - 2, -1, -1):
            b[t] = log_sum(log_t + (e[t + 1] + b[t + 1])[None, :], 1)
        return b

    def log_likelihood(self, x: np.ndarray) -> float:
        return float(log_sum(self.forward(self.emissions(x))[-1], 0))

    def filtered(self, x: np.ndarray) -> np.ndarray:
        """State probabilities given the rows up to each: all a forecast may use."""
        a = self.forward(self.emissions(x))
        return np.exp(a - log_sum(a, 1)[:, None])

    def smoothed(self, x: np.ndarray) -> np.ndarray:
        """State probabilities given all rows: for description only."""
        e = self.emissions(x)
        g = self.forward(e) + self.backward(e)
        return np.exp(g - log_sum(g, 1)[:, None])

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        """The likeliest path; of equal ones the lower state."""
        e, log_t = self.emissions(x), safe_log(self.transition)
        score, back = safe_log(self.start) + e[0], np.zeros(e.shape, dtype=int)
        for t in range(1, len(e)):
            step = score[:, None] + log_t
            back[t] = step.argmax(axis=0)
            score = step.max(axis=0) + e[t]
        path = [int(score.argmax())]
        for t in range(len(e) - 1, 0, -1):
            path.append(int(back[t][path[-1]]))
        return np.array(path[::-1])

    def stationary(self) -> np.ndarray:
        values, vectors = np.linalg.eig(self.transition.T)
        v = np.abs(np.real(vectors[:, np.argmin(np.abs(values - 1))]))
        return v / v.sum()

    def second_modulus(self) -> float:
        return float(np.sort(np.abs(np.linalg.eigvals(self.transition)))[-2]) if len(self.start) > 1 else 0.0

    def projected(self, distribution: np.ndarray, steps: int) -> np.ndarray:
        if steps < 0:
            raise ValueError("steps must not be negative")
        d = distribution @ np.linalg.matrix_power(self.transition, steps)
        return d / d.sum()

    def free_parameters(self) -> int:
        k, d = self.means.shape
        return (k - 1) + k * (k - 1) + k * d + k * d * (d + 1) // 2

    def information_criterion(self, x: np.ndarray) -> float:
        return -2 * self.log_likelihood(x) + self.free_parameters() * float(np.log(len(x)))

    def ordered(self) -> Model:
        """States in the order of their means, first dimension first."""
        o = np.lexsort(self.means.T[::-1])
        return Model(self.start[o], self.transition[np.ix_(o, o)], self.means[o], self.covariances[o])

    def times(self, other: Model) -> Model:
        """The product of two independent chains: joint state i * K + j, observations side by side."""
        k, j = len(self.start), len(other.start)
        d, f = self.means.shape[1], other.means.shape[1]
        means = np.concatenate([np.repeat(self.means, j, axis=0), np.tile(other.means, (k, 1))], axis=1)
        cov = np.zeros((k * j, d + f, d + f))
        cov[:, :d, :d], cov[:, d:, d:] = np.repeat(self.covariances, j, axis=0), np.tile(other.covariances, (k, 1, 1))
        return Model(np.kron(self.start, other.start), np.kron(self.transition, other.transition), means, cov)

    def flat(self) -> dict:
        return {"start": self.start.tolist(), "transition": self.transition.tolist(), "means": self.means.tolist(), "covariances": self.covariances.tolist()}

    @staticmethod
    def of(row) -> Model:
        return Model(*(np.array([list(map(list, m)) if hasattr(m[0], "__len__") else m for m in row[n]] if n == "covariances" else [list(r) if hasattr(r, "__len__") else r for r in row[n]], dtype=float) for n in ("start", "transition", "means", "covariances")))


def start_point(x: np.ndarray, k: int, random: np.random.Generator) -> Model:
    """Means spread as far apart as chance allows (k-means++), persistent states, the pooled covariance."""
    chosen = [x[random.integers(len(x))]]
    while len(chosen) < k:
        d = np.min([((x - c) ** 2).sum(axis=1) for c in chosen], axis=0)
        chosen.append(x[random.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[random.integers(len(x))])
    stay = random.uniform(0.5, 0.98, k)
    off = random.uniform(0.9, 1.1, (k, k)) * (1 - np.eye(k))
    t = np.diag(stay) + (off / np.maximum(off.sum(axis=1, keepdims=True), 1e-300) * (1 - stay)[:, None] if k > 1 else 0)
    t = t / t.sum(axis=1, keepdims=True)
    return Model(np.full(k, 1 / k), t, np.array(chosen), np.repeat(pooled_covariance(x)[None], k, axis=0))


def pooled_covariance(x: np.ndarray) -> np.ndarray:
    c = np.atleast_2d(np.cov(x, rowvar=False, ddof=1)) if len(x) > 1 else np.eye(x.shape[1])
    return c + np.eye(x.shape[1]) * max(RIDGE * np.trace(c) / x.shape[1], 1e-12)


RESTARTS, ITERATIONS, TOLERANCE = 20, 500, 1e-6


class Chains:
    """Models of one chain from several starts, each array with the starts first: they take their steps together."""

    def __init__(self, models: list[Model]):
        self.start, self.transition = np.stack([m.start for m in models]), np.stack([m.transition for m in models])
        self.means, self.covariances = np.stack([m.means for m in models]), np.stack([m.covariances for m in models])

    def one(self, i: int) -> Model:
        return Model(self.start[i], self.transition[i], self.means[i], self.covariances[i])

    def put(self, at: np.ndarray, other: Chains) -> None:
        """Replaces the starts `at` by those of `other`."""
        for name in ("start", "transition", "means", "covariances"):
            getattr(self, name)[at] = getattr(other, name)

    def some(self, at: np.ndarray) -> Chains:
        out = object.__new__(Chains)
        for name in ("start", "transition", "means", "covariances"):
            setattr(out, name, getattr(self, name)[at])
        return out

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """(starts, rows, states): log densities."""
        root = np.linalg.cholesky(self.covariances)
        y = np.linalg.solve(root, np.swapaxes(x[None, None] - self.means[:, :, None], 2, 3))
        size = 2 * np.log(np.diagonal(root, axis1=2, axis2=3)).sum(axis=2)
        return np.swapaxes(-0.5 * ((y * y).sum(axis=2) + size[:, :, None] + x.shape[1] * np.log(2 * np.pi)), 1, 2)

    def expected(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each start: log likelihood, state probabilities, expected transitions."""
        e, log_t = self.emissions(x), safe_log(self.transition)
        a, b = np.empty_like(e), np.zeros_like(e)
        a[:, 0] = safe_log(self.start) + e[:, 0]
        for t in range(1, len(x)):
            a[:, t] = e[:, t] + log_sum(a[:, t - 1, :, None] + log_t, 1)
        for t in range(len(x) - 2, -1, -1):
            b[:, t] = log_sum(log_t + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2)
        total = log_sum(a[:, -1], 1)
        gamma = np.exp(a + b - total[:, None, None])
        pairs = np.zeros_like(log_t)
        for t in range(len(x) - 1):
            pairs += np.exp(a[:, t, :, None] + log_t + (e[:, t + 1] + b[:, t + 1])[:, None, :] - total[:, None, None])
        return total, gamma / gamma.sum(axis=2, keepdims=True), pairs

    def likelihood(self, x: np.ndarray) -> np.ndarray:
        e, log_t = self.emissions(x), safe_log(self.transition)
        a = safe_log(self.start) + e[:, 0]
        for t in range(1, len(x)):
            a = e[:, t] + log_sum(a[:, :, None] + log_t, 1)
        return log_sum(a, 1)

    @staticmethod
    def maximised(x: np.ndarray, gamma: np.ndarray, pairs: np.ndarray, ridge: float) -> Chains:
        k, out = gamma.shape[2], object.__new__(Chains)
        rows = pairs.sum(axis=2, keepdims=True)
        out.transition = np.where(rows > FLOOR, pairs / np.maximum(rows, FLOOR), 1 / k)
        out.start = gamma[:, 0] / gamma[:, 0].sum(axis=1, keepdims=True)
        w = np.maximum(gamma.sum(axis=1), FLOOR)
        out.means = np.einsum("rtk,td->rkd", gamma, x) / w[:, :, None]
        c = x[None, None] - out.means[:, :, None]
        out.covariances = np.einsum("rtk,rktd,rkte->rkde", gamma, c, c) / w[:, :, None, None] + np.eye(x.shape[1]) * ridge
        return out


def fit_together(blocks: list[np.ndarray], starts: list[list[Model]], iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> tuple[list[Model], float]:
    """Independent chains over blocks of columns, fitted by EM from several starts (for each start a model of each block); the
    best by the likelihood of all chains together, the first of equals.

    A start stops when that likelihood settles, and must not fall.  Those that go on take each step as one array.
    """
    chains = [Chains(list(models)) for models in zip(*starts)]
    ridges = [max(RIDGE * np.trace(pooled_covariance(x)) / x.shape[1], 1e-12) for x in blocks]
    last, going = np.full(len(starts), -np.inf), np.arange(len(starts))
    for _ in range(iterations):
        steps = [c.some(going).expected(x) for c, x in zip(chains, blocks)]
        total = sum(s[0] for s in steps)
        if (total < last[going] - np.maximum(1.0, np.abs(last[going])) * 1e-3).any():
            raise RuntimeError("the likelihood fell")
        more = ~(np.abs(total - last[going]) <= tolerance * np.maximum(1.0, np.abs(total)))
        if not more.any():
            break
        going = going[more]
        last[going] = total[more]
        for c, x, (_, gamma, pairs), ridge in zip(chains, blocks, steps, ridges):
            c.put(going, Chains.maximised(x, gamma[more], pairs[more], ridge))
    total = sum(c.likelihood(x) for c, x in zip(chains, blocks))
    best = int(total.argmax())
    return [c.one(best).ordered() for c in chains], float(total[best])


def fit(x: np.ndarray, k: int, seed: int, restarts: int = RESTARTS, iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> tuple[Model, float]:
    """The best of some restarts by likelihood, each from its own start, by EM."""
    random = np.random.default_rng(seed)
    found, total = fit_together([x], [[start_point(x, k, random)] for _ in range(restarts)], iterations, tolerance)
    return found[0], total


def starts_of(blocks: list[np.ndarray], states: list[int], seeds: list[int], restarts: int = RESTARTS) -> list[list[Model]]:
    """For each restart a start of each chain, from the chain's own seed."""
    return [[start_point(x, k, np.random.default_rng([s, i])) for x, k, s in zip(blocks, states, seeds)] for i in range(restarts)]


FITS = "series_id string, states int, log_likelihood double, free_parameters int, information_criterion double, held_out_per_month double, second_modulus double, shortest_duration double, smallest_share double, start array<double>, transition array<array<double>>, means array<array<double>>, covariances array<array<array<double>>>"


def fits(df: DataFrame, columns: list[str], states: list[int], seed: int = 20, holdout: float = 0.2, restarts: int = RESTARTS) -> DataFrame:
    """One fit for each series and number of states, with what a choice among them needs; groups run side by side."""
    spread = df.na.drop(subset=columns).withColumn("states", F.explode(F.array(*(F.lit(k) for k in states))))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        series_id, k = key
        x = rows.sort_values("month")[columns].to_numpy(dtype=float)
        out = int(len(x) * holdout)
        model, total = fit(x, k, seed + 1000 * k, restarts)
        held = np.nan
        if out >= 12:
            early, _ = fit(x[:-out], k, seed + 1000 * k, restarts)
            held = (early.log_likelihood(x) - early.log_likelihood(x[:-out])) / out
        stay = np.minimum(np.diag(model.transition), 1 - 1e-12)
        row = {"series_id": series_id, "states": k, "log_likelihood": total, "free_parameters": model.free_parameters(), "information_criterion": model.information_criterion(x), "held_out_per_month": None if np.isnan(held) else held}
        row |= {"second_modulus": model.second_modulus(), "shortest_duration": float((1 / (1 - stay)).min()), "smallest_share": float(model.smoothed(x).mean(axis=0).min()), **model.flat()}
        return pd.DataFrame([row])

    return spread.groupBy("series_id", "states").applyInPandas(run, FITS)


def chosen(found: DataFrame) -> DataFrame:
    """Of each series the admissible fit (states last three months and hold 5 % of them) that predicts best."""
    from pyspark.sql import Window
    ok = (F.col("states") == 1) | ((F.col("shortest_duration") >= 3) & (F.col("smallest_share") >= 0.05))
    w = Window.partitionBy("series_id").orderBy(F.desc("admissible"), F.desc_nulls_last("held_out_per_month"), "states")
    return found.withColumn("admissible", ok).withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def existence(found: DataFrame) -> DataFrame:
    """(series_id, on_holdout, on_criterion, exist): whether the best of several states beats one, both ways."""
    many = F.col("states") > 1
    out = found.groupBy("series_id").agg(
        F.max(F.when(many, F.col("held_out_per_month"))).alias("m"), F.max(F.when(~many, F.col("held_out_per_month"))).alias("h"),
        F.min(F.when(many, F.col("information_criterion"))).alias("c"), F.min(F.when(~many, F.col("information_criterion"))).alias("d"),
    )
    out = out.select("series_id", F.coalesce(F.col("m") > F.col("h"), F.lit(False)).alias("on_holdout"), F.coalesce(F.col("c") < F.col("d"), F.lit(False)).alias("on_criterion"))
    return out.withColumn("exist", F.col("on_holdout") & F.col("on_criterion"))


def choices(found: DataFrame) -> DataFrame:
    """(series_id, states, runner_up, by_criterion) among the admissible fits of more than one state."""
    from pyspark.sql import Window
    ok = (F.col("states") > 1) & (F.col("shortest_duration") >= 3) & (F.col("smallest_share") >= 0.05)
    w = Window.partitionBy("series_id").orderBy(F.desc("ok"), F.desc_nulls_last("held_out_per_month"), "states")
    placed = found.withColumn("ok", ok).withColumn("place", F.row_number().over(w))
    at = lambda k: F.max(F.when((F.col("place") == k) & F.col("ok"), F.col("states")))
    return placed.groupBy("series_id").agg(F.coalesce(at(1), F.lit(1)).alias("states"), at(2).alias("runner_up"), F.min_by("states", "information_criterion").alias("by_criterion"))


def filtered_states(df: DataFrame, models: DataFrame, on: list[str], keys: list[str], time: str, columns: list[str]) -> DataFrame:
    """(keys, time, filtered, log_likelihood): the chances of the states given the rows up to each, by the model that the
    columns `on`, which are among the keys, name.

    Densities are computed row by row; one fold over each group's rows follows, in the JVM.  A group is one series'
    history, and only its densities are brought together.
    """
    x = F.array(*(F.col(c).cast("double") for c in columns))
    rows = df.na.drop(subset=columns).join(models.select(*on, "means", "covariances"), on)
    rows = rows.select(*keys, F.struct(F.col(time).alias("at"), filtering.emissions(x, F.col("means"), F.col("covariances")).alias("e")).alias("row"))
    groups = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("row")).alias("rows")).join(models.select(*on, "start", "transition"), on)
    told = groups.select(*keys, F.explode(filtering.forward(F.col("rows"), F.col("start"), F.col("transition"))).alias("o"))
    return told.select(*keys, F.col("o.at").alias(time), F.col("o.filtered").alias("filtered"), F.col("o.log_likelihood").alias("log_likelihood"))


def smoothed_states(df: DataFrame, models: DataFrame, on: list[str], keys: list[str], time: str, columns: list[str]) -> DataFrame:
    """(keys, time, smoothed): the chances of the states given all rows of a group, for description only."""
    rows = filtered_states(df, models, on, keys, time, columns)
    groups = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(time).alias("at"), "filtered"))).alias("rows")).join(models.select(*on, "transition"), on)
    return groups.select(*keys, F.explode(filtering.smoothed(F.col("rows"), F.col("transition"))).alias("o")).select(*keys, F.col("o.at").alias(time), F.col("o.smoothed").alias("smoothed"))


def described(states: DataFrame, values: DataFrame, models: DataFrame, on: list[str], keys: list[str], time: str, columns: list[str], cut: float = 0.5) -> DataFrame:
    """(keys, state, label, means, share, duration, a mean of each column): every state in all dimensions.

    `states` has `smoothed`; `values` (keys, time, columns) are natural, not standardised.  Shares and natural means
    are weighted by the chance of being in the state; the label reads the model's own standardised means.
    """
    each = states.select(*keys, time, F.posexplode("smoothed").alias("state", "w")).join(values.select(*keys, time, *columns), [*keys, time], "left")
    weighted = lambda c: F.sum(F.col("w") * F.col(c)) / F.greatest(F.sum(F.when(F.col(c).isNotNull(), F.col("w"))), F.lit(1e-12))
    sums = each.groupBy(*keys, "state").agg(F.avg("w").alias("share"), *(weighted(c).alias(f"mean_{c}") for c in columns)).join(models.select(*on, "transition", "means"), on)
    own = F.col("means")[F.col("state")]
    word = lambda z: F.when(z > cut, "high").when(z < -cut, "low").otherwise("middling")
    label = F.concat_ws(", ", F.zip_with(F.array(*map(F.lit, columns)), own, lambda name, z: F.concat(name, F.lit(" "), word(z))))
    duration = 1 / (1 - F.least(F.col("transition")[F.col("state")][F.col("state")], F.lit(1 - 1e-12)))
    return sums.select(*keys, "state", label.alias("label"), own.alias("means"), "share", duration.alias("duration"), *(f"mean_{c}" for c in columns))


def long_runs(df: DataFrame, matrix: str) -> DataFrame:
    """Adds `long_run`, the distribution that a transition matrix leaves as it is, found batch by batch."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "long_run array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for m in batch.column(batch.schema.get_field_index(matrix)).to_pylist():
                t = np.array(m, dtype=float)
                k = len(t)
                system = np.concatenate([t.T - np.eye(k), np.ones((1, k))])
                found.append(np.linalg.lstsq(system, np.append(np.zeros(k), 1.0), rcond=None)[0].tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.float64()))], [*batch.schema.names, "long_run"])

    return df.mapInArrow(run, schema)


READINGS = "series_id string, month date, state int, filtered array<double>, smoothed array<double>"


def readings(df: DataFrame, models: DataFrame, columns: list[str]) -> DataFrame:
    """Of each month: its state on the likeliest path, filtered and smoothed probabilities, by the series' model."""

    def run(rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or model.empty:
            return pd.DataFrame(columns=["series_id", "month", "state", "filtered", "smoothed"])
        rows = rows.sort_values("month")
        x, m = rows[columns].to_numpy(dtype=float), Model.of(model.iloc[0])
        return pd.DataFrame({"series_id": rows["series_id"], "month": rows["month"], "state": m.viterbi(x), "filtered": list(m.filtered(x)), "smoothed": list(m.smoothed(x))})

    return df.na.drop(subset=columns).groupBy("series_id").cogroup(models.groupBy("series_id")).applyInPandas(run, READINGS)


def regime_label(*means: tuple[str, float], cut: float = 0.5) -> str:
    """A state in words, by its standardised means."""
    return ", ".join(f"{name} {'high' if z > cut else 'low' if z < -cut else 'middling'}" for name, z in means)
