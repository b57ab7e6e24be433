"""Queries over hidden regimes: fits, paths, filters, and a walk forward with two chains."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import regimes, timegrid, transforms
from ..sources import tables
from ..sources.scratch import folder
from ..streaming import streams
from .library import as_of_dates, query, r
from .walkforward import LAG_DAYS


def daily(spark, sf_dir: str) -> DataFrame:
    events = tables.table(spark, sf_dir, "events")
    return events.groupBy(F.col("event_type").alias("series_id"), F.col("ts").cast("date").alias("month")).agg(F.avg("value").alias("x"))


@query()
def hmm_fit(spark, sf_dir):
    """Fits with one to three states for each event type, and what a choice needs."""
    return regimes.fits(daily(spark, sf_dir), ["x"], [1, 2, 3]).select("series_id", "states", "log_likelihood", "free_parameters", "information_criterion", "second_modulus", "shortest_duration", "smallest_share")


@query()
def hmm_choice(spark, sf_dir):
    return regimes.chosen(regimes.fits(daily(spark, sf_dir), ["x"], [1, 2, 3])).select("series_id", "states", "admissible", "information_criterion")


@query()
def viterbi_path(spark, sf_dir):
    rows = daily(spark, sf_dir)
    models = regimes.fits(rows, ["x"], [2])
    path = regimes.readings(rows, models, ["x"])
    return path.select("series_id", "month", "state", F.col("filtered")[0].alias("filtered_first"), F.col("smoothed")[0].alias("smoothed_first"))


_FILTER = f"""WITH RECURSIVE d AS (SELECT event_type AS series_id, ts::DATE AS day, avg(value) AS x FROM events GROUP BY 1, 2),
s AS (SELECT series_id, avg(x) AS m, stddev_pop(x) AS sd FROM d GROUP BY 1),
e AS (SELECT d.series_id, day, row_number() OVER (PARTITION BY d.series_id ORDER BY day) AS i, exp(-0.5 * pow((x - (m - sd / 2)) / sd, 2)) AS e0, exp(-0.5 * pow((x - (m + sd / 2)) / sd, 2)) AS e1 FROM d JOIN s ON d.series_id = s.series_id),
f AS (SELECT series_id, day, i, (e0 * 0.5 / (e0 * 0.5 + e1 * 0.5))::DOUBLE AS p FROM e WHERE i = 1 UNION ALL
    SELECT e.series_id, e.day, e.i, (e0 * (p * 0.95::DOUBLE + (1 - p) * 0.1::DOUBLE) / (e0 * (p * 0.95::DOUBLE + (1 - p) * 0.1::DOUBLE) + e1 * (p * 0.05::DOUBLE + (1 - p) * 0.9::DOUBLE)))::DOUBLE FROM f JOIN e ON e.series_id = f.series_id AND e.i = f.i + 1)
SELECT series_id, day AS month, {r('p')} AS filtered_first FROM f"""


@query(_FILTER)
def forward_filter_fixed_params(spark, sf_dir):
    """Filtered probabilities of a given two-state model of each event type's daily mean."""
    rows = daily(spark, sf_dir)
    models = rows.groupBy("series_id").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))
    doubles = lambda *v: F.array(*(x if not isinstance(x, float) else F.lit(x) for x in v))
    m, sd = F.col("m"), F.col("sd")
    models = models.select("series_id", doubles(0.5, 0.5).alias("start"), F.array(doubles(0.95, 0.05), doubles(0.1, 0.9)).alias("transition"), F.array(F.array(m - sd / 2), F.array(m + sd / 2)).alias("means"), F.array(F.array(F.array(sd * sd)), F.array(F.array(sd * sd))).alias("covariances"))
    return regimes.filtered_states(rows, models, ["series_id"], ["series_id"], "month", ["x"]).select("series_id", "month", F.col("filtered")[0].alias("filtered_first"))


@query(f"SELECT ts::DATE AS day, event_type, count(*) AS n, {r('avg(value)')} AS mean FROM events GROUP BY 1, 2")
def streamed_daily_counts(spark, sf_dir):
    """Daily counts by event time, computed as a stream."""
    like = tables.table(spark, sf_dir, "events")
    events = streams.read_events(spark, f"{sf_dir}/event[s].parquet", like)
    return streams.run_once(streams.windowed_counts(events, "ts", "event_type", "value"))


def _arrived(df: DataFrame, what: str) -> DataFrame:
    """A frame as a stream: its rows are put into a folder that all machines share, and read from there as they come."""
    path = folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


@query(_FILTER)
def streamed_filter(spark, sf_dir):
    """The same filtered probabilities as a stream whose rows come in any order, over several triggers."""
    rows = daily(spark, sf_dir)
    usual = rows.groupBy("series_id").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))
    z = rows.join(usual, "series_id").select("series_id", F.col("month").cast("timestamp").alias("at"), ((F.col("x") - F.col("m")) / F.col("sd")).alias("z"))
    model = regimes.Model(np.array([0.5, 0.5]), np.array([[0.95, 0.05], [0.1, 0.9]]), np.array([[-0.5], [0.5]]), np.ones((2, 1, 1)))
    late = "400 days"
    source = streams.closed(z, late, folder(spark, "daily"), files=8, files_a_trigger=3)
    out = streams.run_once(streams.filtered(source, model, ["z"], late), "append")
    return out.select("series_id", F.col("at").cast("date").alias("month"), F.col("filtered")[0].alias("filtered_first"))


@query("SELECT DISTINCT event_type, ts::DATE AS day FROM events")
def streamed_first_claims(spark, sf_dir):
    """Each (event type, day) once, the first time it comes by, as a stream that forgets old ones."""
    events = tables.table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("date").alias("day"), F.col("ts").cast("date").cast("timestamp").alias("at"))
    first = streams.first_claims(_arrived(events, "claims"), ["event_type", "day"], "at", "400 days")
    return streams.run_once(first, "append").select("event_type", "day")


WALK = "refit_date date, horizon int, high_rates double, distance_to_stationary double, second_modulus double, joint_states int"


@query()
def two_chain_walk_forward(spark, sf_dir):
    """At each refit the panel known by then is fitted with a growth chain and a levels chain, whose product
    gives the chance that rates are high at each horizon.  One group for each refit date."""
    grid = timegrid.complete_grid(tables.line_measures(spark, sf_dir))
    change = transforms.transformed(grid.where("series_id <> 'rates'"), transforms.LOG_CHANGE)
    plain = transforms.transformed(grid.where("series_id = 'rates'"), transforms.LEVEL)
    wide = change.unionByName(plain).groupBy("month").pivot("series_id", ["growth", "inflation", "rates"]).agg(F.first("transformed")).na.drop()
    dates = as_of_dates(spark, sf_dir, 36).withColumnRenamed("as_of", "refit_date")
    panel = wide.join(F.broadcast(dates), F.date_add("month", LAG_DAYS) <= F.col("refit_date"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        refit = key[0]
        x = rows.sort_values("month")[["growth", "inflation", "rates"]].to_numpy(dtype=float)
        x = (x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-12)
        seed = 20 + refit.year * 100 + refit.month
        growth, _ = regimes.fit(x[:, :1], 2, seed)
        levels, _ = regimes.fit(x[:, 1:], 2, seed + 1)
        joint = growth.times(levels)
        now, rest = joint.filtered(x)[-1], joint.stationary()
        high = (joint.smoothed(x) * (x[:, 2:] > 0)).sum(axis=0) / np.maximum(joint.smoothed(x).sum(axis=0), 1e-12)
        out = []
        for h in (1, 3, 6, 12):
            d = joint.projected(now, h)
            out.append((refit, h, float(d @ high), float(0.5 * np.abs(d - rest).sum()), joint.second_modulus(), len(rest)))
        return pd.DataFrame(out, columns=["refit_date", "horizon", "high_rates", "distance_to_stationary", "second_modulus", "joint_states"])

    return panel.groupBy("refit_date").applyInPandas(run, WALK)
