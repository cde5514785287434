"""Incremental sync: batch and stream agree, replays are harmless."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from veilwork.functions.techniques import ColumnRule, Settings
from veilwork.operators.apply import apply_policy, frozen_scales
from veilwork.plans.run import resume_table
from veilwork.sources.sinks import append_rows, conform, rows_to_insert, write_batch
from veilwork.streaming import changes, statements, sync

SETTINGS = Settings("unit-secret")
RULES = [
    ColumnRule("t", "id", "HASHING", is_primary_key=True),
    ColumnRule("t", "email", "TOKENIZATION", "EMAIL"),
    ColumnRule("t", "amount", "DIFFERENTIAL_PRIVACY", "FINANCIAL"),
]


@pytest.fixture
def source(spark, tmp_path):
    path = str(tmp_path / "source")
    df = spark.range(60).select("id", F.concat(F.lit("u"), "id").alias("email"), (F.col("id") * 1.5).alias("amount"))
    for part in range(3):
        df.filter((F.col("id") >= part * 20) & (F.col("id") < part * 20 + 20)).coalesce(1).write.mode("append").parquet(path)
    return path


def run_stream(spark, path, tmp_path, scales, rules=lambda: RULES):
    schema = spark.read.parquet(path).schema
    stream = sync.read_stream(spark, path, schema, files_per_batch=1)
    query = sync.start_sync(
        stream, "t", rules, SETTINGS, str(tmp_path / "target"), str(tmp_path / "mark"), ["id"], scales, once=True
    )
    query.awaitTermination()
    return spark.read.parquet(str(tmp_path / "target"))


def test_stream_equals_batch_and_resumes(spark, source, tmp_path):
    raw = spark.read.parquet(source)
    scales = frozen_scales(raw, RULES)
    batch = conform(apply_policy(raw, "t", RULES, SETTINGS, ["id"], scales), RULES)
    streamed = run_stream(spark, source, tmp_path, scales)
    assert streamed.select("batch_id").distinct().count() == 3
    assert streamed.drop("batch_id").exceptAll(batch).count() == 0 and streamed.count() == 60
    assert sync.batch_marks(streamed, "id").agg(F.sum("row_count")).first()[0] == 60
    raw.limit(5).select((F.col("id") + 1000).alias("id"), "email", "amount").write.mode("append").parquet(source)
    assert run_stream(spark, source, tmp_path, scales).count() == 65
    assert run_stream(spark, source, tmp_path, scales).count() == 65


def test_policy_is_read_per_batch(spark, source, tmp_path):
    calls = []

    def rules():
        calls.append(1)
        return [*RULES[:2], ColumnRule("t", "amount", "NO_CHANGE")] if len(calls) > 1 else RULES[:2]

    run_stream(spark, source, tmp_path, {}, rules)
    assert len(calls) == 3


def test_replayed_batch_replaces_itself(spark, tmp_path):
    target = str(tmp_path / "out")
    df = spark.range(10)
    write_batch(df, target, 1)
    write_batch(df, target, 2)
    write_batch(df.limit(4), target, 2)
    assert {r["batch_id"]: r["count"] for r in spark.read.parquet(target).groupBy("batch_id").count().collect()} == {1: 10, 2: 4}


def test_noise_in_a_stream_needs_scales(spark, source, tmp_path):
    with pytest.raises(Exception, match="amount"):
        run_stream(spark, source, tmp_path, None)


def test_event_queue(spark, tmp_path):
    src = str(tmp_path / "statements")
    rows = [("INSERT INTO `Shop` VALUES (?)", "7"), ("update t set a=1", None), ("select 1", None), (" DELETE FROM \"x-y\" where 1", "3")]
    spark.createDataFrame(rows, "statement string, first_parameter string").write.parquet(src)
    stream = sync.read_stream(spark, src, spark.read.parquet(src).schema)
    query = sync.start_event_queue(statements.change_events(stream), str(tmp_path / "q"), str(tmp_path / "m"), once=True)
    query.awaitTermination()
    got = sorted((r["table_name"], r["operation"], r["primary_key"]) for r in spark.read.parquet(str(tmp_path / "q")).collect())
    assert got == [("shop", "INSERT", "7"), ("t", "UPDATE", "auto"), ("x-y", "DELETE", "3")]


def test_modes(spark):
    numeric = spark.createDataFrame([], "id bigint, name string")
    timed = spark.createDataFrame([], "code string, Updated_At timestamp")
    text = spark.createDataFrame([], "code string")
    assert changes.sync_mode(numeric, "id") == "key"
    assert changes.sync_mode(timed, "code") == "time" and changes.time_column(timed) == "Updated_At"
    assert changes.sync_mode(text, "code") == "diff"
    with pytest.raises(ValueError, match="cannot be synced"):
        changes.sync_mode(text, None)


def test_extracts(spark, rows):
    df = spark.createDataFrame([(i, dt.datetime(2024, 1, i + 1)) for i in range(6)], "id int, updated_at timestamp")
    assert changes.extract_by_key(df, "id", None).count() == 6
    assert changes.extract_by_key(df, "id", 3).count() == 2
    assert changes.extract_by_time(df, "updated_at", dt.datetime(2024, 1, 5)).count() == 1
    assert changes.extract_auto(df, "id", 5, "updated_at", dt.datetime(2024, 1, 4)).count() == 2
    assert changes.extract_by_diff(df, "id", df.limit(0), "id").count() == 6


def test_change_reasons(spark):
    schema = "table_name string, row_count long, max_id long, max_time timestamp"
    t0, t1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    old = spark.createDataFrame([("a", 1, 1, t0), ("b", 1, 1, t0), ("c", 1, 1, t0), ("d", 1, 1, t0), ("e", 1, None, None)], schema)
    new = spark.createDataFrame([("a", 2, 2, t1), ("b", 1, 2, t1), ("c", 1, 1, t1), ("d", 1, 1, t0), ("e", 1, 5, None), ("new", 1, 1, t0)], schema)
    assert {r["table_name"]: r["reason"] for r in changes.change_reasons(old, new).collect()} == {
        "a": "row_count", "b": "max_id", "c": "max_time", "e": "max_id",
    }


def test_baseline_guard(spark):
    changes.require_same_size(spark.range(3), spark.range(3), "t")
    with pytest.raises(ValueError, match="no baseline"):
        changes.require_same_size(spark.range(3), spark.range(2), "t")


def test_changes_equal_a_replay(spark):
    """One key owns a third of the events; the result is that of applying them one by one."""
    import random

    draw = random.Random(3)
    state = {k: f"v{k}" for k in range(20)}
    start = spark.createDataFrame(list(state.items()), "k int, v string")
    events = []
    for i in range(300):
        k = 5 if draw.random() < 0.34 else draw.randrange(30)
        op = draw.choice(["INSERT", "UPDATE", "DELETE"])
        events.append((k, f"e{i}", op, i // 2, i))
        state.pop(k, None)
        if op != "DELETE":
            state[k] = f"e{i}"
    df = spark.createDataFrame(events, "k int, v string, operation string, ts int, seq int")
    latest = changes.latest_events(df, ["k"], ["ts", "seq"])
    done = changes.apply_changes(start, latest, ["k"])
    assert {r["k"]: r["v"] for r in done.collect()} == state and done.count() == len(state)
    allowed, refused = changes.split_deletes(latest, "k", spark.createDataFrame([(k,) for k in range(30)], "p int"), "p")
    assert refused.count() == latest.filter("operation = 'DELETE'").count()
    assert allowed.count() + refused.count() == latest.count()


def test_resume_and_insert(spark, tmp_path):
    df = spark.range(10).select("id", F.lit("x").alias("email"))
    rules = RULES[:2]
    policy = spark.createDataFrame(
        [(r.table_name, r.column_name, r.technique, r.pii_type, True, r.is_primary_key, None, None) for r in rules],
        "table_name string, column_name string, technique string, pii_type string, is_pii boolean, is_pk boolean, fk_table string, fk_column string",
    )
    done = apply_policy(df, "t", rules, SETTINGS)
    target = str(tmp_path / "t")
    append_rows(done.limit(4), target)
    rest = resume_table(df, "t", spark.read.parquet(target), policy, SETTINGS, "id")
    assert rest.count() == 6
    append_rows(rest.select(*done.columns), target)
    assert spark.read.parquet(target).exceptAll(done).count() == 0
    assert rows_to_insert(df.unionByName(df), df.filter("id < 7").select("id"), ["id"]).count() == 3
