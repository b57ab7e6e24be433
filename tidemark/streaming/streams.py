"""Publication as a stream: counts by event time, claims without repeats, and regime filters that keep their state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..functions import filtering
from ..operators.regimes import Model, log_sum, safe_log
from ..sources.scratch import folder


def read_events(spark: SparkSession, pattern: str, like: DataFrame) -> DataFrame:
    """A stream of the Parquet files that match, with the table's own schema."""
    return spark.readStream.schema(like.schema).parquet(pattern)


def windowed_counts(events: DataFrame, time: str, key: str, value: str, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """(day, key, n, mean) by event time; rows that come more than `late` after newer ones are left out."""
    stamped = events.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", late)
    rows = stamped.groupBy(F.window("at", size).alias("w"), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return rows.select(F.col("w.start").cast("date").alias("day"), key, "n", "mean")


def first_claims(claims: DataFrame, keys: list[str], time: str, late: str = "45 days") -> DataFrame:
    """Each claim once, forgotten after `late`: what is kept doesn't grow with the stream."""
    return claims.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


TOLD = "series_id string, us long, filtered array<double>"
EARLY = "us long, e array<double>"


class OrderedFilter(StatefulProcessor):
    """The filter of one series, in the order of event time however its rows arrive.

    Rows wait in state until the watermark has passed their time, as until then an earlier one may come; a timer at
    the earliest of them wakes the series.  The rest of the state is one vector.  Rows that come after the watermark
    has passed them are late and left out: what was told of their time has been told.
    """

    def __init__(self, start: list[float], transition: list[list[float]]):
        self.start, self.transition = start, transition

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.early = handle.getListState("early", EARLY)
        self.reached = handle.getValueState("reached", "us long, alpha array<double>")
        self.alarm = handle.getValueState("alarm", "ms long")
        self.begin, self.step = safe_log(np.array(self.start)), safe_log(np.array(self.transition))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        watermark, first = timerValues.getCurrentWatermarkInMs() * 1000, None
        for part in rows:
            if key[0] is None:  # a heartbeat: it only moves the watermark
                continue
            part = part[part["us"] > watermark]
            if len(part):
                self.early.appendList([(int(us), [float(v) for v in e]) for us, e in zip(part["us"], part["e"])])
                first = int(part["us"].min()) if first is None else min(first, int(part["us"].min()))
        if first is not None:
            self.wake(first)
        return iter(())

    def wake(self, us: int) -> None:
        """A timer at the millisecond that holds `us`, unless an earlier one is set."""
        ms = -(-us // 1000)
        if self.alarm.exists():
            held = self.alarm.get()[0]
            if held <= ms:
                return
            self.handle.deleteTimer(held)
        self.handle.registerTimer(ms)
        self.alarm.update((ms,))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        self.alarm.clear()
        rows = sorted((r[0], list(r[1])) for r in self.early.get())
        ready = [r for r in rows if r[0] <= watermark]
        rest = rows[len(ready) :]
        if rest:
            self.early.put(rest)
            self.wake(rest[0][0])
        else:
            self.early.clear()
        if not ready:
            return
        alpha, out = np.array(self.reached.get()[1]) if self.reached.exists() else None, []
        for _, e in ready:
            alpha = np.array(e) + (self.begin if alpha is None else log_sum(alpha[:, None] + self.step, 0))
            alpha = alpha - log_sum(alpha, 0)
            out.append(np.exp(alpha).tolist())
        self.reached.update((ready[-1][0], alpha.tolist()))
        yield pd.DataFrame({"series_id": key[0], "us": [r[0] for r in ready], "filtered": out})

    def close(self) -> None:
        pass


def filtered(rows: DataFrame, model: Model, columns: list[str], late: str = "45 days") -> DataFrame:
    """(series_id, at, filtered) of a stream of (series_id, at, values): the state probabilities after each row, given
    the rows up to it in event time.  A row may come up to `late` after newer ones of any series; it is told once the
    watermark has passed it.  A row without a series is a heartbeat."""
    array = lambda a: F.lit(np.asarray(a, dtype=float).tolist()) if np.ndim(a) == 1 else F.array(*(array(x) for x in a))
    x = F.array(*(F.col(c).cast("double") for c in columns))
    dense = rows.withColumn("e", filtering.emissions(x, array(model.means), array(model.covariances)))
    stamped = dense.select("series_id", "at", F.unix_micros("at").alias("us"), "e").withWatermark("at", late)
    told = stamped.groupBy("series_id").transformWithStateInPandas(OrderedFilter(model.start.tolist(), model.transition.tolist()), TOLD, "Append", "EventTime")
    return told.select("series_id", F.timestamp_micros("us").alias("at"), "filtered")


def closed(rows: DataFrame, late: str, path: str, files: int = 1, files_a_trigger: int | None = None) -> DataFrame:
    """A frame of (series_id, at, ...) as a stream that ends: its rows in so many files below `path`, then a heartbeat that
    lies `late` and a moment after the last row, so that all of them are told."""
    spark = rows.sparkSession
    rows.repartition(files).write.parquet(path)
    spark.read.schema(rows.schema).parquet(path).agg((F.max("at") + F.expr(f"interval {late}") + F.expr("interval 1 second")).alias("at")).select(
        *(F.col("at") if f.name == "at" else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema)
    ).write.mode("append").parquet(path)
    reader = spark.readStream.schema(rows.schema)
    return (reader.option("maxFilesPerTrigger", files_a_trigger) if files_a_trigger else reader).parquet(path)


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_once(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there, each batch written to the shared folder, and reads the last state back."""
    spark = stream.sparkSession
    base, before = folder(spark, "stream"), spark.conf.get(PROVIDER)

    def put(batch: DataFrame, number: int) -> None:
        # a batch that is run again after a failure replaces what it wrote before
        batch.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch={number}")

    spark.conf.set(PROVIDER, ROCKS)  # large states stay off the heap; timers and lists need it
    try:
        running = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before)
    try:
        running.awaitTermination()
    finally:
        running.stop()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
