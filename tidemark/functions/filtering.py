"""The forward recursion of hidden Markov models as column expressions.

Models and rows are arrays: a model's start (K), transition (K x K), means (K x D) and covariances (K x D x D), a row's
values (D).  Everything is in logarithms, so states with no chance stay at minus infinity and nothing underflows.  No
Python worker takes part: densities are computed where the rows are, and the recursion is a fold over a group's rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NOTHING = float("-inf")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def safe_ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x)).otherwise(F.lit(NOTHING))


def log_sum_exp(values: Column) -> Column:
    """The logarithm of the sum of exponentials of an array; minus infinity where all are."""
    return let(F.array_max(values), lambda top: F.when(top == NOTHING, top).otherwise(top + F.ln(F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - top)))))


def log_density(x: Column, mean: Column, covariance: Column) -> Column:
    """Log density of a normal distribution: one dimension after the other given those before it, so the covariance is
    neither inverted nor factored beforehand."""
    rest = lambda a: F.slice(a, 2, F.size(a))

    def given(s: Column, _: Column) -> Column:
        pivot, head = s["m"][0][0], s["v"][0]
        column = F.transform(rest(s["m"]), lambda row: row[0])
        v = F.zip_with(rest(s["v"]), column, lambda a, c: a - c * head / pivot)
        m = F.zip_with(rest(s["m"]), column, lambda row, c: F.zip_with(rest(row), rest(s["m"][0]), lambda a, b: a - c * b / pivot))
        return F.struct(v.alias("v"), m.alias("m"), (s["q"] + head * head / pivot + F.ln(pivot)).alias("q"))

    start = F.struct(F.zip_with(x, mean, lambda a, b: a - b).alias("v"), covariance.alias("m"), F.lit(0.0).alias("q"))
    return F.aggregate(x, start, given, lambda s: -0.5 * (s["q"] + F.size(x) * math.log(2 * math.pi)))


def emissions(x: Column, means: Column, covariances: Column) -> Column:
    """The log density of a row under each state."""
    return F.zip_with(means, covariances, lambda mean, covariance: log_density(x, mean, covariance))


def stepped_on(alpha: Column, columns: Column) -> Column:
    """Log chances of the states one step on; `columns` are the log transition's columns."""
    return F.transform(columns, lambda into: log_sum_exp(F.zip_with(alpha, into, lambda a, t: a + t)))


def log_columns(transition: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(transition) - 1), lambda j: F.transform(transition, lambda row: safe_ln(F.get(row, j))))


def forward(rows: Column, start: Column, transition: Column, at: str = "at", e: str = "e") -> Column:
    """array<struct<at, filtered, log_likelihood>> of sorted rows with fields `at` and `e` (log densities): the chances of
    the states after each row, given the rows up to it, and the log likelihood of those rows."""

    def step(columns: Column) -> Callable[[Column, Column], Column]:
        def run(s: Column, row: Column) -> Column:
            before = F.when(F.size(s["alpha"]) == 0, F.transform(start, safe_ln)).otherwise(stepped_on(s["alpha"], columns))
            joint = F.zip_with(before, row[e], lambda a, b: a + b)

            def put(j: Column, total: Column) -> Column:
                alpha, log_likelihood = F.transform(j, lambda a: a - total), s["log_likelihood"] + total
                told = F.struct(row[at].alias("at"), F.transform(j, lambda a: F.exp(a - total)).alias("filtered"), log_likelihood.alias("log_likelihood"))
                return F.struct(alpha.alias("alpha"), log_likelihood.alias("log_likelihood"), F.concat(s["out"], F.array(told)).alias("out"))

            return let(joint, lambda j: let(log_sum_exp(j), lambda total: put(j, total)))

        return run

    none = F.transform(F.slice(rows, 1, 0), lambda row: F.struct(row[at].alias("at"), start.alias("filtered"), F.lit(0.0).alias("log_likelihood")))
    empty = F.struct(F.slice(start, 1, 0).alias("alpha"), F.lit(0.0).alias("log_likelihood"), none.alias("out"))
    return let(log_columns(transition), lambda columns: F.aggregate(rows, empty, step(columns), lambda s: s["out"]))


def smoothed(rows: Column, transition: Column, at: str = "at", filtered: str = "filtered") -> Column:
    """array<struct<at, smoothed>> of sorted rows with fields `at` and `filtered`: the chances of the states given all rows.

    From the last row back: a state's chance is its filtered one times how the states it can move to are seen with all
    rows, against how they were expected from this row.
    """
    columns = F.transform(F.sequence(F.lit(0), F.size(transition) - 1), lambda j: F.transform(transition, lambda row: F.get(row, j)))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def step(into: Column) -> Callable[[Column, Column], Column]:
        def run(s: Column, row: Column) -> Column:
            expected = F.transform(into, lambda column: dot(row[filtered], column))
            ratio = F.zip_with(s["next"], expected, lambda x, e: F.when(e > 0, x / e).otherwise(0.0))
            back = let(ratio, lambda q: F.zip_with(row[filtered], transition, lambda f, moves: f * dot(moves, q)))
            here = F.when(F.size(s["next"]) == 0, row[filtered]).otherwise(back)
            return let(here, lambda h: F.struct(h.alias("next"), F.concat(F.array(F.struct(row[at].alias("at"), h.alias("smoothed"))), s["out"]).alias("out")))

        return run

    none = F.transform(F.slice(rows, 1, 0), lambda row: F.struct(row[at].alias("at"), row[filtered].alias("smoothed")))
    empty = F.struct(F.transform(F.slice(rows, 1, 0), lambda row: F.lit(0.0)).alias("next"), none.alias("out"))
    return let(columns, lambda into: F.aggregate(F.reverse(rows), empty, step(into), lambda s: s["out"]))
