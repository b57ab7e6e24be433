"""Probabilities of conditions: shrunk rates, chains over horizons, mixtures over states."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shrunk(successes: Column, n: Column, pooled: Column, strength: float | Column = 10.0) -> Column:
    """A rate drawn towards a pooled one that counts for `strength` trials; the pooled one where nothing counts."""
    strength = F.lit(strength)
    total = n + strength
    return F.when(total > 0, (successes + strength * pooled) / total).otherwise(pooled)


def chain_at(now: Column, entry: Column, stay: Column, steps: Column) -> Column:
    """P(holds after `steps` months) of a two-state chain that holds now with probability `now`."""
    ratio = stay - entry
    long_run = entry / (1 - ratio)
    return F.when(ratio >= 1, now).otherwise(long_run + (now - long_run) * F.pow(ratio, steps))


def chain_within(now: Column, entry: Column, stay: Column, horizon: Column) -> Column:
    """P(holds in one of the next `horizon` months)."""
    return 1 - (now * (1 - stay) + (1 - now) * (1 - entry)) * F.pow(1 - entry, horizon - 1)


def blend(a: Column, b: Column, weight: float = 0.5) -> Column:
    """The mean of two probabilities; anything that isn't one is refused."""
    mixed = weight * a + (1 - weight) * b
    ok = mixed.isNull() | (~F.isnan(mixed) & a.between(0, 1) & b.between(0, 1))
    return F.when(ok, mixed).otherwise(F.raise_error(F.lit("not a probability")).cast("double"))


def moved(d: Column, transition: Column) -> Column:
    """A distribution (array) one step of a transition matrix (array of rows) on."""
    return F.transform(F.sequence(F.lit(0), F.size(d) - 1), lambda j: F.aggregate(F.zip_with(d, transition, lambda p, row: p * F.get(row, j)), F.lit(0.0), lambda s, x: s + x))


def stepped(distribution: Column, transition: Column, steps: Column) -> Column:
    """A distribution over states after `steps` steps of a transition matrix (array of rows)."""
    return F.when(steps <= 0, distribution).otherwise(F.aggregate(F.sequence(F.lit(1), steps), distribution, lambda d, _: moved(d, transition)))


def expectation(distribution: Column, values: Column) -> Column:
    return F.aggregate(F.zip_with(distribution, values, lambda p, v: p * v), F.lit(0.0), lambda s, x: s + x)


def within_horizon(distribution: Column, transition: Column, first: Column, entry: Column, horizon: Column) -> Column:
    """P(holds in one of the next months) with states: `first` is each state's chance next month, `entry` later."""

    def missed(d: Column, rates: Column) -> Column:
        after = stepped(d, transition, F.lit(1))
        return F.zip_with(after, rates, lambda p, r: p * (1 - r))

    start = missed(distribution, first)
    left = F.when(horizon <= 1, start).otherwise(F.aggregate(F.sequence(F.lit(2), horizon), start, lambda d, _: missed(d, entry)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.aggregate(left, F.lit(0.0), lambda s, x: s + x)))


def joint_chain(distribution: Column, transition: Column, entry: Column, stay: Column, now: Column, gap: Column, horizon: Column, at: Column) -> Column:
    """P(a condition holds `horizon` months on, or where not `at` in one of the months up to then) of the chain of
    state and condition together.

    Each month the state moves, then the condition is drawn in the state arrived in: by that state's `entry` if it
    didn't hold before, by its `stay` if it did.  It starts at the condition last published (`now`, 1 or 0), `gap`
    months before the forecast.
    """

    def drawn(s: Column) -> tuple[Column, Column, Column, Column]:
        off, on = moved(s["off"], transition), moved(s["on"], transition)
        times = lambda d, r: F.zip_with(d, r, lambda x, y: x * y)
        less = lambda d, r: F.zip_with(d, r, lambda x, y: x * (1 - y))
        return less(off, entry), less(on, stay), times(off, entry), times(on, stay)

    def plus(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: x + y)

    def step(s: Column, _: Column) -> Column:
        a, b, c, d = drawn(s)
        return F.struct(plus(a, b).alias("off"), plus(c, d).alias("on"))

    def after(s: Column, steps: Column) -> Column:
        return F.when(steps <= 0, s).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), s, step))

    none = F.transform(distribution, lambda x: x * 0.0)
    start = F.struct(F.when(now > 0.5, none).otherwise(distribution).alias("off"), F.when(now > 0.5, distribution).otherwise(none).alias("on"))
    opened = after(start, gap)
    total = lambda d: F.aggregate(d, F.lit(0.0), lambda s, x: s + x)
    first = drawn(opened)
    survive = lambda d, _: F.zip_with(moved(d, transition), entry, lambda x, y: x * (1 - y))
    left = F.when(horizon <= 1, plus(first[0], first[1])).otherwise(F.aggregate(F.sequence(F.lit(2), F.greatest(horizon, F.lit(2))), plus(first[0], first[1]), survive))
    found = F.when(at, total(after(opened, horizon)["on"])).otherwise(1 - total(left))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), found))


def total_variation(a: Column, b: Column) -> Column:
    return 0.5 * F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def half_life(ratio: Column) -> Column:
    """Months in which a deviation halves: 0 without persistence, infinite without decay."""
    return F.when(ratio <= 0, 0.0).when(ratio >= 1, float("inf")).otherwise(F.ln(F.lit(0.5)) / F.ln(ratio))


def expected_duration(stay: Column) -> Column:
    return 1 / (1 - F.least(stay, F.lit(1 - 1e-12)))


def normal_share(x: Column) -> Column:
    """The share of a normal distribution below x, by its series in odd powers; beyond 6.5 as at 6.5."""
    z = F.least(F.greatest(x, F.lit(-6.5)), F.lit(6.5))
    zero = F.struct(z.alias("term"), z.alias("sum"))
    step = lambda s, k: F.struct((s["term"] * z * z / (2 * k + 1)).alias("term"), (s["sum"] + s["term"] * z * z / (2 * k + 1)).alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(80)), zero, step, lambda s: s["sum"])
    return 0.5 + series * F.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


def label(*means: tuple[str, Column], cut: float = 0.5) -> Column:
    """A state in words, by its standardised means."""
    words = [F.concat(F.lit(f"{name} "), F.when(z > cut, "high").when(z < -cut, "low").otherwise("middling")) for name, z in means]
    return F.concat_ws(", ", *words)


def rule_parts(rules: DataFrame) -> DataFrame:
    """(rule, any_time, below, composition): what a question's rule says in its name."""
    any_time = F.contains("rule", F.lit("within"))
    return rules.select("rule", any_time.alias("any_time"), F.contains("rule", F.lit("below")).alias("below"), F.when(any_time, "any_time_within_horizon").otherwise("point_in_time").alias("composition"))
