"""The bitemporal store, the registry and the register."""

import datetime as dt

import pytest

from tidemark.sources import register, registry, store


def test_store_round_trip(spark, tmp_path):
    rows = [("a", None, dt.date(2000, 1, 1), 1.5), ("a", dt.date(2000, 3, 1), dt.date(2000, 1, 1), 1.0), ("a", dt.date(2000, 3, 1), dt.date(2000, 2, 1), None), ("b", None, dt.date(2000, 1, 1), 2.0)]
    df = spark.createDataFrame(rows, store.OBSERVATIONS)
    path = str(tmp_path / "s")
    store.write(df, path)
    assert sorted(map(str, store.read(spark, path).select(df.columns).collect())) == sorted(map(str, df.collect()))
    assert store.verified(spark, path).count() == 0
    with pytest.raises(Exception, match="exist"):
        store.write(df, path)
    held = spark.read.parquet(f"{path}/snapshots")
    assert {(r.series_id, r.observation_count, r.missing_value_count) for r in held.collect()} == {("a", 1, 0), ("a", 2, 1), ("b", 1, 0)}
    wanted = spark.createDataFrame([("a", None), ("a", dt.date(2000, 4, 1))], "series_id string, vintage_date date")
    assert [r.vintage_date for r in store.missing(wanted, held).collect()] == [dt.date(2000, 4, 1)]
    plan = store.read(spark, path).where("series_id = 'a' AND observation_date < date'2000-02-01'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(series_id" in plan and "PushedFilters: [IsNotNull(observation_date), LessThan(observation_date" in plan


def test_delivered_text(spark, tmp_path):
    (tmp_path / "X1.csv").write_text("observation_date,X1\n2000-01-01,1.25\n2000-02-01,.\n2000-03-01,\n2000-04-01,NA\n")
    got = {(r.series_id, r.observation_date.month): r.value for r in store.read_csv(spark, str(tmp_path)).collect()}
    assert got == {("X1", 1): 1.25, ("X1", 2): None, ("X1", 3): None, ("X1", 4): None}
    (tmp_path / "X1.csv").write_text("observation_date,X1\nnever,1\n")
    with pytest.raises(Exception, match="never"):
        store.read_csv(spark, str(tmp_path)).collect()


def test_registry(spark, tmp_path):
    (tmp_path / "q.yaml").write_text("schema_version: 1\nderived:\n  - {name: spread, operation: difference, minuend: a, subtrahend: z}\n")
    found = registry.read_file(str(tmp_path / "q.yaml"))
    derived = registry.dimension(spark, found["derived"], registry.DERIVED)
    series = spark.createDataFrame([("a",)], "name string")
    questions = spark.createDataFrame([("q1", "spread"), ("q2", "nothing")], "name string, series string")
    got = {(r.name, r.refers_to) for r in registry.unknown_references(questions, series, derived).collect()}
    assert got == {("spread", "z"), ("q2", "nothing")}
    with pytest.raises(ValueError, match="twice"):
        registry.dimension(spark, found["derived"] * 2, registry.DERIVED)
    with pytest.raises(ValueError, match="lacks"):
        registry.dimension(spark, [{"name": "x"}], registry.DERIVED)
    (tmp_path / "q.yaml").write_text("schema_version: 2\n")
    with pytest.raises(ValueError, match="schema_version"):
        registry.read_file(str(tmp_path / "q.yaml"))


def test_register(spark, tmp_path):
    day = dt.date
    rows = [("i", 1, day(2024, 2, 29), "h", None, 0.4, 0.5, day(2024, 3, 1)), ("i", 1, day(2024, 2, 29), "h", None, 0.9, 0.5, day(2024, 3, 9)), ("j", 5, day(2024, 1, 1), "h", None, 0.2, 0.5, day(2024, 3, 1))]
    batch, path = spark.createDataFrame(rows, register.CLAIMS), str(tmp_path / "r")
    none = spark.createDataFrame([], register.CLAIMS)
    new = register.new_claims(batch, none)
    assert {(r.indicator, r.probability) for r in new.collect()} == {("i", 0.4), ("j", 0.2)}
    register.append(new, path)
    held = register.read(spark, path)
    assert register.new_claims(batch, held).count() == 0
    register.append(register.new_claims(batch, held), path)
    assert held.count() == 2
    told = spark.createDataFrame([("i", day(2025, 2, 28), 1.0)], "indicator string, month date, outcome double")
    got = register.resolved(held, told, "2025-02-28").collect()
    assert [(r.indicator, r.state) for r in got] == [("i", "resolved")] and got[0].brier == pytest.approx(0.36)
    assert register.resolved(held, told.limit(0), "2025-02-28").first().state == "pending"
    assert register.due(held, "2025-02-27").count() == 0
    late = register.staleness(held, "2024-04-16").first()
    assert late.days == 46 and late.overdue
    (tmp_path / "r" / "broken.json").write_text("{not json\n")
    with pytest.raises(Exception):  # noqa: B017  whatever Spark says of a broken line
        register.read(spark, path).collect()
