"""Products of chains as column expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kron_vector(a: Column, b: Column) -> Column:
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))


def kron_matrix(a: Column, b: Column) -> Column:
    """The Kronecker product of two matrices (arrays of rows)."""
    return F.flatten(F.transform(a, lambda p: F.transform(b, lambda q: kron_vector(p, q))))


def side_by_side(a: Column, b: Column) -> Column:
    """Means of a product: those of the first for each state, followed by those of the second."""
    return F.flatten(F.transform(a, lambda p: F.transform(b, lambda q: F.concat(p, q))))


def block_diagonal(a: Column, b: Column) -> Column:
    """Covariances of a product: a block of the first and one of the second for each pair of states, nothing between."""

    def joined(p: Column, q: Column) -> Column:
        none = lambda m: F.transform(m[0], lambda _: F.lit(0.0))
        return F.concat(F.transform(p, lambda row: F.concat(row, none(q))), F.transform(q, lambda row: F.concat(none(p), row)))

    return F.flatten(F.transform(a, lambda p: F.transform(b, lambda q: joined(p, q))))


def free_parameters(states: Column, dimensions: Column) -> Column:
    """Of a chain with normal emissions: starts, transitions, means, covariances."""
    return (states - 1) + states * (states - 1) + states * dimensions + F.floor(states * dimensions * (dimensions + 1) / 2).cast("int")


def row_error(matrix: Column) -> Column:
    """How far the rows of a transition matrix are from adding up to one, at most."""
    return F.array_max(F.transform(matrix, lambda row: F.abs(F.aggregate(row, F.lit(0.0), lambda s, x: s + x) - 1)))
