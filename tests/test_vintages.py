"""Validity intervals, panels by policy and forked stores against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import validity
from tidemark.plans import vintages
from tidemark.sources import forks, store
from tidemark.sources.scratch import folder

LOG = "series_id string, month date, vintage_date date, value double"


def day(n):
    return dt.date(2000, 1, 1) + dt.timedelta(days=n)


def made_log(seed):
    rnd, rows = random.Random(seed), []
    for s in "ab":
        for m in range(6):
            for t in sorted(rnd.sample(range(30 * m + 31, 400), rnd.randint(1, 6))):
                rows.append((s, dt.date(2000, m + 1, 1), day(t), rnd.choice([1.0, 2.0, 3.0, None])))
    rnd.shuffle(rows)
    return rows


def stood(rows, s, m, at):
    """What was last told of a month by a date, and whether anything was."""
    told = [r for r in rows if r[0] == s and r[1] == m and r[2] <= at]
    return (max(told, key=lambda r: r[2])[3],) if told else None


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_versions_stand_as_a_plain_scan_says(spark, seed):
    rows = made_log(seed)
    versions = validity.intervals(spark.createDataFrame(rows, LOG), ["series_id", "month"])
    dates = [day(n) for n in range(0, 420, 7)]
    wanted = spark.createDataFrame([(d, s) for d in dates for s in "abc"], "as_of date, series_id string")
    got = {(r.as_of, r.series_id, r.month): (r.value,) for r in validity.as_of(versions, wanted).collect()}
    months = {r[1] for r in rows}
    want = {(d, s, m): stood(rows, s, m, d) for d in dates for s in "ab" for m in months}
    assert got == {k: v for k, v in want.items() if v is not None}
    ahead = {(r.as_of, r.series_id, r.month): (r.value,) for r in validity.as_of(versions, wanted, 2).collect()}
    assert ahead != got


def test_a_version_that_repeats_is_no_change(spark):
    rows = [("a", day(0), day(40), 1.0), ("a", day(0), day(50), 1.0), ("a", day(0), day(60), None), ("a", day(0), day(70), None), ("a", day(0), day(80), 1.0)]
    got = validity.intervals(spark.createDataFrame(rows, LOG), ["series_id", "month"]).orderBy("known_from").collect()
    assert [(r.value, r.known_from, r.known_to) for r in got] == [(1.0, day(40), day(60)), (None, day(60), day(80)), (1.0, day(80), dt.date(9999, 12, 31))]


def test_running_sums_add_what_came_later(spark):
    rows = [("m", day(1), 1, 2.0), ("m", day(1), 1, 3.0), ("m", day(5), 1, 5.0), ("n", day(2), 1, 7.0)]
    got = validity.running(spark.createDataFrame(rows, "month string, known date, n int, x double"), ["month"], "known", ["n", "x"]).orderBy("month", "known").collect()
    assert [tuple(r) for r in got] == [("m", day(1), 2, 5.0), ("m", day(5), 3, 10.0), ("n", day(2), 1, 7.0)]


@pytest.mark.parametrize("lead", [0, 3])
def test_panel_reads_the_source_its_policy_says(spark, lead):
    rows = made_log(5)
    log = spark.createDataFrame(rows, LOG)
    versions = validity.intervals(log, ["series_id", "month"])
    latest = {(s, m): max((r for r in rows if r[0] == s and r[1] == m), key=lambda r: r[2])[3] for s in "ab" for m in {r[1] for r in rows}}
    final = spark.createDataFrame([(s, m, v) for (s, m), v in latest.items()], "series_id string, month date, value double")
    dates = [day(n) for n in (62, 125, 200, 390)]
    wanted = spark.createDataFrame([(d, s) for d in dates for s in "ab"], "as_of date, series_id string")
    revised = spark.createDataFrame([("a", True), ("b", False)], "series_id string, is_revised boolean")
    chosen = validity.policies(versions, wanted, revised, 3)
    policy = {(r.as_of, r.series_id): r.policy for r in chosen.collect()}
    assert set(policy.values()) == {"unrevised", "vintage", "publication_lag_fallback"} and all((p == "unrevised") == (s == "b") for (_, s), p in policy.items())
    want = {}
    for (d, s), p in policy.items():
        at = (dt.date(d.year + (d.month + lead - 1) // 12, (d.month + lead - 1) % 12 + 1, min(d.day, 28)) if lead else d) if p == "vintage" else d
        for m in {r[1] for r in rows}:
            if p == "vintage" and (found := stood(rows, s, m, at)) is not None:
                want[d, s, m] = (found[0], p)
            elif p != "vintage" and m + dt.timedelta(days=45) <= d:
                want[d, s, m] = (latest[s, m], p)
    assert all(d.day <= 28 for d in dates)
    assert {(r.as_of, r.series_id, r.month): (r.value, r.policy) for r in validity.panel_by_policy(versions, final, chosen, 45, lead).collect()} == want


def observations(spark, change=0.0):
    rows = [(s, None if v is None else dt.date(v, 6, 1), dt.date(y, m, 1), float(y + m) + (change if (s, v, y) == ("a", None, 2001) else 0)) for s in "abc" for v in (None, 2001, 2002) for y in (2000, 2001) for m in (1, 2)]
    return spark.createDataFrame(rows, store.OBSERVATIONS)


def as_set(df):
    return sorted(map(str, df.select("series_id", "vintage_date", "observation_date", "value").collect()))


def test_fork_writes_only_what_it_changes(spark):
    root = folder(spark, "test-store")
    forks.create(observations(spark).repartition(5), root)
    assert as_set(forks.opened(spark, root)) == as_set(observations(spark))
    before = forks.objects(spark, root).count()
    forks.fork(spark, root, "main", "same", F.lit(False), F.col("value") * 2)
    assert forks.objects(spark, root).count() == before and as_set(forks.opened(spark, root, "same")) == as_set(observations(spark))
    where = (F.col("series_id") == "a") & F.col("vintage_date").isNull() & (F.year("observation_date") == 2001)
    forks.fork(spark, root, "main", "other", where, F.col("value") + 1)
    assert forks.objects(spark, root).count() == before + 1
    assert as_set(forks.opened(spark, root, "other")) == as_set(observations(spark, 1.0)) and as_set(forks.opened(spark, root)) == as_set(observations(spark))
    assert {(r.series_id, r.blocks, r.shared) for r in forks.shared_blocks(spark, root, "main", "other").collect()} == {("a", 4, 3), ("b", 4, 4), ("c", 4, 4)}
    forks.fork(spark, root, "other", "back", where, F.col("value") - 1)  # a fork of a fork, to what was there before
    assert forks.objects(spark, root).count() == before + 1 and forks.shared_blocks(spark, root, "main", "back").where("blocks <> shared").isEmpty()
    assert forks.unsound(spark, root).isEmpty()


def test_equal_blocks_are_one_object_and_digests_tell_damage(spark):
    root = folder(spark, "test-store")
    forks.create(observations(spark), root)
    assert forks.objects(spark, root).count() == 4  # the three series have equal rows
    bad = forks.objects(spark, root).limit(1).withColumn("digest", F.lit("00"))
    bad.write.mode("append").partitionBy("shard").parquet(f"{root}/objects")
    assert forks.unsound(spark, root).count() == 1


def test_an_empty_store(spark):
    root = folder(spark, "test-store")
    forks.create(observations(spark).limit(0), root)
    assert forks.opened(spark, root).count() == 0 and forks.unsound(spark, root).isEmpty()


def test_audit_compares_every_field_and_the_runs_use_vintages(spark, sf_dir):
    found = vintages.panel_policies(spark, sf_dir).groupBy("policy").count().collect()
    assert {r.policy for r in found} == {"unrevised", "vintage", "publication_lag_fallback"}
    assert set(vintages.FIELDS) <= set(vintages.vintage_walk_forward(spark, sf_dir).columns)
