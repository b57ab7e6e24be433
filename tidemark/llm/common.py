"""What several operators of this package share: reading tables, shared storage, text bytes."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError, Py4JNetworkError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows and bytes of one Arrow batch at most: Spark's own bound of 10,000 rows would let a batch of texts take tens
#: of megabytes, which each task holds several times.
BATCH_ROWS, BATCH_BYTES = 1000, "4m"

_places: WeakKeyDictionary = WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by Spark's own reader, so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share (``spark.checkpoint.dir``).

    Only where the session names none, as in tests on one machine, a temporary folder is used.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return sc.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes `df` as Parquet to the shared folder and reads it back: later steps need not
    recompute it, and a lost executor loses none of it.  The files go when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    atexit.register(_remove, store, place)
    out = spark.read.schema(df.schema).parquet(path)
    _places[out] = store, place
    return out


def forget(*frames: DataFrame) -> None:
    """Deletes the files of stored frames that nothing reads any more."""
    for df in frames:
        if df in _places:
            _remove(*_places.pop(df))


def _remove(store, place) -> None:
    with contextlib.suppress(Py4JError, Py4JNetworkError, OSError):  # the JVM may have ended before this
        store.delete(place, True)


def residue(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo `mod`: the fold of a document."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % F.lit(mod)


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches (see `BATCH_ROWS`); smaller bounds that are set already stay."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def mapped(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """`fn` over each Arrow batch of `df`; it gives a batch, or several."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out
        pa.default_memory_pool().release_unused()  # the worker lives on

    return df.mapInArrow(run, schema)


def chosen(df: DataFrame, keep: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """The rows of `df`, with all their columns, whose texts `keep` marks."""
    at = df.columns.index("text")
    return mapped(df, lambda batch: batch.filter(pa.array(keep(utf8(batch.column(at))), pa.bool_())), df.schema)


def drawn(df: DataFrame, by: Column, most: int, *order: str) -> DataFrame:
    """At most `most` rows with the smallest values of `by`, a hash, and of the columns `order` among equal ones.

    All but about four times as many go by a threshold on the hash, where the rows are; only what is left is sorted.
    """
    rows = df.withColumn("_drawn", by)
    n = rows.count()
    share = 4 * most / max(n, 1)
    while share < 1:
        few = rows.where(F.col("_drawn") < F.lit(int(-(2**63) + share * 2**64)))
        if few.limit(most).count() >= min(most, n):
            rows = few
            break
        share *= 4
    return rows.orderBy("_drawn", *order).limit(most).drop("_drawn")


def groups_of(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of `texts` of at most `most` bytes together, or of one text: bounds a task's memory."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (a finalizer as in public hash functions)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def salts(n: int, seed: int) -> np.ndarray:
    """`n` fixed 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
