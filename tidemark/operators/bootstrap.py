"""Moving-block bootstrap of ratios of sums, from running sums.

A resample is a list of blocks of consecutive dates.  The sum over a block is the difference of two
running sums, so a resample costs a lookup for each block, not a pass over its rows, and several
statistics and units (indicators scored on the same dates) share the same blocks.

Where a block starts is read from a digest of the seed, the key, the resample and the block: independent
uniform draws that come out alike in any engine and on any number of tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 20


def start_of(choices: Column, *of: Column) -> Column:
    """Where a block starts (from 0), uniform over `choices` places: eight hexadecimal digits of a digest."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(c.cast("string") for c in of))), 1, 8), 16, 10).cast("long") % choices


def resampled(df: DataFrame, keys: list[str], date: str, sums: list[str], block: int | Column, resamples: int, unit: str | None = None, seed: int = SEED) -> DataFrame:
    """(keys, unit, resample, sums): of each resample the sums of the columns over its blocks, cut to n dates in all.

    `df` has one row for each key, date and unit (or less); `block` is a number of dates, or a column over the keys.
    """
    of = [unit] if unit else []
    w = Window.partitionBy(*keys)
    placed = df.select(*keys, date).distinct().withColumn("pos", F.row_number().over(w.orderBy(date)).cast("long"))
    size = placed.groupBy(*keys).agg(F.count("*").alias("_n"))
    rows = placed.join(df.select(*keys, *of).distinct(), keys) if unit else placed
    rows = rows.join(df, [*keys, date, *of], "left")
    upto = Window.partitionBy(*keys, *of).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    running = rows.select(*keys, *of, "pos", *(F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).over(upto).alias(c) for c in sums))
    zero = df.select(*keys, *of).distinct().select(*keys, *of, F.lit(0).cast("long").alias("pos"), *(F.lit(0.0).alias(c) for c in sums))
    running = running.unionByName(zero)
    size = size.withColumn("_length", F.least(block if isinstance(block, Column) else F.lit(block), F.col("_n").cast("int")).cast("long"))
    drawn = size.withColumn("resample", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(resamples - 1).cast("long"))))
    drawn = drawn.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), (F.ceil(F.col("_n") / F.col("_length")) - 1).cast("long"))))
    drawn = drawn.withColumn("_a", start_of(F.col("_n") - F.col("_length") + 1, F.lit(seed), *(F.col(k) for k in keys), F.col("resample"), F.col("_k")))
    drawn = drawn.withColumn("_b", F.col("_a") + F.least(F.col("_length"), F.col("_n") - F.col("_k") * F.col("_length")))
    ends = drawn.join(running.select(*keys, *of, F.col("pos").alias("_a"), *(F.col(c).alias(f"{c}_a") for c in sums)), [*keys, "_a"])
    ends = ends.join(running.select(*keys, *of, F.col("pos").alias("_b"), *(F.col(c).alias(f"{c}_b") for c in sums)), [*keys, "_b", *of])
    return ends.groupBy(*keys, *of, "resample").agg(*(F.sum(F.col(f"{c}_b") - F.col(f"{c}_a")).alias(c) for c in sums))


#: Units of one group, and numbers that a group holds at once while it draws.
UNITS, HELD = 64, 4_000_000


def starts(seed: int, key: tuple, resamples: range, blocks: int, choices: int) -> np.ndarray:
    """The same draws as :func:`start_of`, (resample, block), for a task that has many to make."""
    head = ":".join(map(str, (seed, *key)))
    md5 = hashlib.md5
    return np.array([[int(md5(f"{head}:{r}:{k}".encode()).hexdigest()[:8], 16) % choices for k in range(blocks)] for r in resamples], dtype=np.int64)


def defined(n: np.ndarray, y: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """A skill is defined where the outcome varies and the reference errs."""
    return (n >= 2) & (y > 0.5) & (y < n - 0.5) & (reference > 1e-12)


def mean_ratios(df: DataFrame, keys: list[str], date: str, unit: str, ratios: dict[str, tuple[str, str]], block: Column, resamples: int, seed: int = SEED) -> DataFrame:
    """(keys, resample, a column for each of `ratios`): of each resample of dates the mean over units of 1 - sum of errors /
    sum of the reference's errors.

    `df` has a row for each key, date and unit (or none), with `y` (the outcome) and the errors named in `ratios`
    (name: (errors, reference's errors)).  Each ratio has its own fixed set of units, those it is defined for on all
    dates; a resample in which one of them isn't has no mean.  All ratios and units of a key share its draws.

    A group is `UNITS` units of one key, their dates times ten numbers or so: running sums are taken once, a block is a
    difference of two, and `HELD` numbers are held at a time however many resamples there are.
    """
    w = Window.partitionBy(*keys)
    dates = df.select(*keys, date).distinct().withColumn("_pos", F.row_number().over(w.orderBy(date)).cast("int")).withColumn("_n", F.count("*").over(w).cast("int"))
    parts = df.select(*keys, unit).distinct().groupBy(*keys).agg(F.ceil(F.count("*") / UNITS).cast("int").alias("_parts"))
    columns = sorted({c for pair in ratios.values() for c in pair})
    rows = df.join(dates, [*keys, date]).join(parts, keys)
    rows = rows.select(*keys, F.pmod(F.xxhash64(unit), F.col("_parts")).cast("int").alias("_part"), "_pos", "_n", F.least(block.cast("int"), "_n").alias("_length"), F.col(unit).cast("string").alias("_unit"), F.lit(1.0).alias("_one"), F.col("y").cast("double").alias("_y"), *(F.col(c).cast("double").alias(f"_{c}") for c in columns))
    names = ["_one", "_y", *(f"_{c}" for c in columns)]
    at = {c: 2 + i for i, c in enumerate(columns)}

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n, length = int(rows["_n"].iloc[0]), int(rows["_length"].iloc[0])
        units, of = np.unique(rows["_unit"].to_numpy(), return_inverse=True)
        sums = np.zeros((n + 1, len(units), len(names)))
        np.add.at(sums, (rows["_pos"].to_numpy(), of), rows[names].to_numpy(float))
        sums = sums.cumsum(axis=0)
        fixed = {name: defined(sums[-1, :, 0], sums[-1, :, 1], sums[-1, :, at[b]]) for name, (_, b) in ratios.items()}
        blocks = -(-n // length)
        size = np.minimum(length, n - np.arange(blocks) * length)
        each, found = max(1, HELD // (blocks * len(units) * len(names))), []
        for first in range(0, resamples, each):
            drawn = range(first, min(resamples, first + each))
            a = starts(seed, key[:-1], drawn, blocks, n - length + 1)
            total = (sums[a + size] - sums[a]).sum(axis=1)
            out = dict(zip(keys, key)) | {"resample": np.arange(drawn.start, drawn.stop)}
            for name, (x, b) in ratios.items():
                own = total[:, fixed[name]]
                ok = defined(own[:, :, 0], own[:, :, 1], own[:, :, at[b]])
                share = 1 - own[:, :, at[x]] / np.where(ok, own[:, :, at[b]], 1)
                out |= {f"{name}_k": fixed[name].sum(), f"{name}_d": ok.sum(axis=1), f"{name}_s": np.where(ok, share, 0).sum(axis=1)}
            found.append(pd.DataFrame(out))
        return pd.concat(found)

    kinds = dict(df.select(*keys).dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "resample long", *(f"{n}_k long, {n}_d long, {n}_s double" for n in ratios)])
    each = rows.groupBy(*keys, "_part").applyInPandas(run, schema)
    whole = each.groupBy(*keys, "resample").agg(*(F.sum(f"{n}_{c}").alias(f"{n}_{c}") for n in ratios for c in "kds"))
    return whole.select(*keys, "resample", *(F.when((F.col(f"{n}_k") > 0) & (F.col(f"{n}_d") == F.col(f"{n}_k")), F.col(f"{n}_s") / F.col(f"{n}_k")).alias(n) for n in ratios))


def interval(samples: DataFrame, keys: list[str], statistic: Column, level: float = 0.9, resamples: int = 0) -> DataFrame:
    """(keys, usable, lower, upper): the interval of a statistic; null where too few of the resamples have one
    (20, or one in a hundred)."""
    rows = samples.withColumn("x", statistic)
    n = F.count("x")
    ends = F.percentile("x", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    return rows.groupBy(*keys).agg(n.alias("usable"), F.when(n >= max(20, resamples / 100), ends).alias("ends")).select(*keys, "usable", F.col("ends")[0].alias("lower"), F.col("ends")[1].alias("upper"))
