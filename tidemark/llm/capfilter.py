"""Near-duplicate vectors by spherical-cap filters.

Filter directions are the words of a random product code: a vector is rotated, cut into blocks, and each
block has a number of random directions; a filter is one choice for every block.  A vector is list-decoded
to all filters that exceed its threshold, which is the one that `keep_for` directions exceed: as the best
filters are sums of the best of either half, they are found without looking at all.  Vectors of one label
that share a filter are candidates; each is verified by its cosine in double precision, so no link is below
the threshold.  Nothing is capped: a full bucket is joined whole.

The number of directions of a block grows with the fourth root of the largest label (from `CODES` to
`MOST_CODES`), so that the filters which unrelated vectors share by chance stay few for each vector, and the length of
the lists grows with its square root, so that of pairs at the threshold at least 0.995 share a filter whatever the
label's size.  Vectors of under `FEW_DIMS` dimensions have no room for more directions; they keep `CODES` and longer lists.

Equal vectors of one label are one class from the start and counted by its size.  Pairs within a group
of many different but close vectors are links, of which each row's number is asked, so they are made.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, rows without
label or vec_id, and vectors of unequal length link with nothing.  Repeated rows are linked vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, stored
from .graph import components

COSINE = 0.98
BLOCKS = 4
CODES, MOST_CODES = 48, 256
KEEP, FEW_DIMS = 24, 64
#: Rows of other vectors that a vector may meet by chance, about.
CHANCE = 4


def codes_for(rows: int) -> int:
    """Directions of a block for a label of so many vectors."""
    return int(min(MOST_CODES, max(CODES, np.ceil((rows * KEEP * KEEP / CHANCE) ** 0.25))))


def keep_for(dims: int, codes: int) -> int:
    """Filters of a vector's list."""
    return 2 * KEEP if dims < FEW_DIMS else int(np.ceil(KEEP * max(1.0, codes / CODES) ** 0.5))


@lru_cache(maxsize=8)
def code(dims: int, codes: int = CODES) -> tuple[np.ndarray, list[np.ndarray]]:
    """A rotation of `dims` dimensions (at least 16, the others zero) and the directions of each block."""
    size = max(16, dims)
    random = np.random.default_rng(20_040 + dims)
    rotation, _ = np.linalg.qr(random.standard_normal((size, size)))
    parts = []
    for block in np.array_split(np.arange(size), BLOCKS):
        d = random.standard_normal((codes, len(block)))
        parts.append((block, d / np.linalg.norm(d, axis=1, keepdims=True) / np.sqrt(BLOCKS)))
    return rotation[:dims], parts


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _best(scores: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of each row's `keep` highest."""
    top = np.argpartition(-scores, keep - 1, axis=1)[:, :keep] if keep < scores.shape[1] else np.tile(np.arange(scores.shape[1]), (len(scores), 1))
    return top, np.take_along_axis(scores, top, axis=1)


def list_decode(vectors: np.ndarray, codes: int = CODES) -> np.ndarray:
    """The filters of each (unit) vector, a row for each."""
    dims = vectors.shape[1]
    codes = CODES if dims < FEW_DIMS else codes
    keep = keep_for(dims, codes)
    rotation, parts = code(vectors.shape[1], codes)
    x = vectors @ rotation
    scores = [x[:, block] @ d.T for block, d in parts]
    halves = [_best((scores[k][:, :, None] + scores[k + 1][:, None, :]).reshape(len(x), -1), keep) for k in (0, 2)]
    (first, a), (second, b) = halves
    top, _ = _best((a[:, :, None] + b[:, None, :]).reshape(len(x), -1), keep)
    return np.take_along_axis(first, top // b.shape[1], axis=1).astype(np.int64) * codes**2 + np.take_along_axis(second, top % b.shape[1], axis=1)


def _decoded(classes: DataFrame, codes: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        dims = np.array(batch.column("dims"))
        for d in np.unique(dims):
            rows = np.flatnonzero(dims == d)
            step = max(1, 2_000_000 // codes**2)
            for i in range(0, len(rows), step):
                part = batch.take(pa.array(rows[i : i + step]))
                lists = list_decode(unit(_matrix(part.column("embedding"), d)), codes)
                yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("label"), part.column("dims"), pa.array(list(lists), pa.list_(pa.int64()))], names=["rep", "label", "dims", "filters"])

    return mapped(classes.select("rep", "label", "dims", "embedding"), run, "rep long, label string, dims int, filters array<long>")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dims)


def _verified(pairs: DataFrame, cosine: float) -> DataFrame:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        dims = np.array(batch.column("dims"))
        for d in np.unique(dims):
            part = batch.take(pa.array(np.flatnonzero(dims == d)))
            x, y = (unit(_matrix(part.column(c), d)) for c in ("of_a", "of_b"))
            yield part.select(["a", "b"]).filter(pa.array(np.einsum("ij,ij->i", x, y) >= cosine))

    return mapped(pairs.select("a", "b", "dims", "of_a", "of_b"), run, "a long, b long")


def similar_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per vector: the other vectors linked with it, the smallest vec_id of its component, whether it is that one."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))
    valid = rows.where(fit)
    classes = stored(valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("dims", F.size("embedding")), "vectors")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    buckets = stored(_decoded(classes, codes_for(largest)).select("rep", "label", "dims", F.explode("filters").alias("filter")), "filters")
    left, right = buckets.withColumnRenamed("rep", "a"), buckets.withColumnRenamed("rep", "b")
    pairs = left.join(right, ["label", "dims", "filter"]).where("a < b").select("a", "b", "dims").distinct()
    of = classes.select("rep", "embedding")
    pairs = pairs.join(of.toDF("a", "of_a"), "a").join(of.toDF("b", "of_b"), "b")
    links = stored(_verified(pairs, cosine), "links")
    both = links.union(links.select("b", "a"))
    n = both.join(classes.select(F.col("rep").alias("b"), "copies"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("copies").alias("others"))
    found = components(links).withColumnRenamed("node", "rep")
    told = classes.join(n, "rep", "left").join(found, "rep", "left").select("label", "embedding", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = valid.join(told, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
