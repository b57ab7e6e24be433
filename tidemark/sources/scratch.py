"""Intermediate results on storage that all machines share, written once and read by everything after them."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from weakref import WeakKeyDictionary

from py4j.protocol import Py4JError, Py4JNetworkError
from pyspark.sql import DataFrame, SparkSession

_places: WeakKeyDictionary = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share (``spark.checkpoint.dir``).

    Only where the session names none and runs on one machine, as in tests, a temporary folder is used.
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
    path, store, place = _folder(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _places[out] = store, place
    return out


def folder(spark: SparkSession, what: str) -> str:
    """A path of its own in the shared folder; what is put there goes when the driver ends."""
    return _folder(spark, what)[0]


def _folder(spark: SparkSession, what: str) -> tuple:
    path = f"{shared_dir(spark)}/tidemark-{what}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    atexit.register(_remove, store, place)
    return path, store, place


def forget(*frames: DataFrame) -> None:
    """Deletes the files of stored frames that nothing reads any more."""
    for df in frames:
        if df in _places:
            _remove(*_places.pop(df))


def _remove(store, place) -> None:
    with contextlib.suppress(Py4JError, Py4JNetworkError, OSError):  # the JVM may have ended before this
        store.delete(place, True)
