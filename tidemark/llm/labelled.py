"""A bounded sample of labelled documents, to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drawn

#: At most so many documents of each label, and of so many bytes each, are drawn.
SAMPLE_ROWS = 1000
SAMPLE_BYTES = 16_000


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(y, text): labels (0 or 1) and texts of up to `rows` documents for each label, drawn by a hash of the id; texts of
    over `most_bytes` bytes never teach, and one that has both labels counts as 1 where a classifier reads them as a dict.

    `learn` says over doc_id which rows may be learned from.  The sample is the same for the same rows,
    in whatever order they come.
    """
    marked = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & learn).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    marked = marked.distinct()
    ids = [drawn(marked.where(F.col("y") == y), F.xxhash64("doc_id", F.lit(17)), 2 * rows, "doc_id") for y in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes)
    found = texts.join(F.broadcast(ids[0].union(ids[1])), "doc_id").select("y", F.xxhash64("doc_id", F.lit(17)).alias("drawn"), "doc_id", "text")
    parts = [found.where(F.col("y") == y).orderBy("drawn", "doc_id", "text").limit(rows) for y in (0, 1)]
    return parts[0].union(parts[1]).select("y", "text")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> list[tuple[bytes, int]]:
    """Those rows on the driver: texts and labels."""
    return [((r.text or "").encode(), r.y) for r in labelled_rows(docs, labels, label, learn, rows, most_bytes).collect()]
