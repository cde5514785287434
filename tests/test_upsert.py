"""The keyed sync target: every way of feeding it ends where a batch run over all events ends."""

import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veilwork.functions.techniques import ColumnRule, Settings
from veilwork.operators.apply import apply_policy
from veilwork.session import SHUFFLE_CLEANUP
from veilwork.sources.keyed import KeyedTarget, buckets_for
from veilwork.sources.sinks import conform
from veilwork.streaming import changes, sync
from veilwork.streaming.upsert import merge_events, quarantined, start_upsert

SETTINGS = Settings("unit-secret")
RULES = [
    ColumnRule("t", "id", "HASHING", is_primary_key=True),
    ColumnRule("t", "email", "TOKENIZATION", "EMAIL"),
    ColumnRule("child", "owner", "HASHING", fk_table="t", fk_column="id"),
]
EVENT = "id long, email string, operation string, seq int"


def events_of(seed: int, n: int, keys: int = 25):
    """One key owns a third of the events."""
    draw = random.Random(seed)
    pick = lambda: 7 if draw.random() < 0.34 else draw.randrange(keys)
    return [(pick(), f"u{i}@x.org", draw.choice(["INSERT", "UPDATE", "UPDATE", "DELETE"]), i) for i in range(n)]


def batch_run(spark, events, children=()):
    """All events at once: refused deletes out, last event per key, anonymized."""
    frame = spark.createDataFrame(events, EVENT)
    done = conform(apply_policy(frame, "t", RULES, SETTINGS), RULES[:2])
    for df, column in children:
        done = changes.split_deletes(done, "id", df, column)[0]
    last = changes.latest_events(done, ["id"], ["seq"]).filter("operation <> 'DELETE'")
    return sorted(tuple(r) for r in last.select("id", "email", "seq").collect())


def rows_of(target, spark, version=None):
    return sorted(tuple(r) for r in target.read(spark, version).select("id", "email", "seq").collect())


def run(spark, tmp_path, target, events, checkpoint, files=4, children=tuple):
    path = str(tmp_path / "events")
    for i in range(files):
        part = events[i * len(events) // files : (i + 1) * len(events) // files]
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(path)
    stream = sync.read_stream(spark, path, spark.read.parquet(path).schema, files_per_batch=1)
    query = start_upsert(
        stream, "t", lambda: RULES, SETTINGS, target, str(tmp_path / checkpoint), ["seq"], children_now=children, once=True
    )
    query.awaitTermination()


def test_stream_equals_batch_through_replay_and_restart(spark, tmp_path):
    target = KeyedTarget(str(tmp_path / "t"), ("id",), 8)
    assert target.read(spark) is None and target.versions(spark) == []
    first, second = events_of(1, 160), [(k, e, o, s + 160) for k, e, o, s in events_of(2, 80, 40)]
    run(spark, tmp_path, target, first, "mark")
    assert rows_of(target, spark) == batch_run(spark, first)
    at = target.manifest(spark).version
    run(spark, tmp_path, target, second, "mark", files=2)
    everything = batch_run(spark, first + second)
    assert rows_of(target, spark) == everything
    # a new checkpoint folder brings every event again, in whatever order the files are listed
    run(spark, tmp_path, target, [], "another mark", files=0)
    assert rows_of(target, spark) == everything
    assert rows_of(target, spark, at) == batch_run(spark, first)  # versions stay readable


def merge(spark, target, events, children=()):
    done = conform(apply_policy(spark.createDataFrame(events, EVENT), "t", RULES, SETTINGS), RULES[:2])
    return merge_events(target, done, ["seq"], children=children)


@pytest.mark.parametrize("seed", [3, 4])
def test_late_and_repeated_batches(spark, tmp_path, seed):
    target = KeyedTarget(str(tmp_path / "t"), ("id",), 4)
    events = events_of(seed, 120)
    parts = [events[i : i + 30] for i in range(0, 120, 30)]
    random.Random(seed).shuffle(parts)
    for part in [*parts, parts[0], parts[2]]:
        merge(spark, target, part)
    assert rows_of(target, spark) == batch_run(spark, events)


def test_a_replay_writes_nothing(spark, tmp_path):
    target = KeyedTarget(str(tmp_path / "t"), ("id",), 4)
    events = events_of(5, 50)
    assert [merge(spark, target, events), merge(spark, target, events), merge(spark, target, events[:9])] == [1, 1, 1]
    assert merge(spark, target, events[:0]) == 1
    assert merge(spark, target, [(7, "new@x.org", "UPDATE", 999)]) == 2
    held = target.manifest(spark).held
    assert sorted(held.values()).count(2) == 1  # only the touched bucket was written again


def test_deletes_with_children_are_refused(spark, tmp_path):
    target = KeyedTarget(str(tmp_path / "t"), ("id",), 4)
    child = apply_policy(spark.createDataFrame([(7,), (3,), (None,)], "owner long"), "child", RULES, SETTINGS)
    events = events_of(6, 120)
    run(spark, tmp_path, target, events, "mark", children=lambda: [(child, "owner")])
    assert rows_of(target, spark) == batch_run(spark, events, [(child, "owner")])
    wanted = sum(1 for e in events if e[0] in (7, 3) and e[2] == "DELETE")
    assert target.refused(spark).count() == wanted
    run(spark, tmp_path, target, [], "another mark", files=0, children=lambda: [(child, "owner")])
    assert target.refused(spark).count() == wanted
    assert rows_of(target, spark) == batch_run(spark, events, [(child, "owner")])


def test_a_failed_batch_leaves_no_trace(spark, tmp_path):
    target = KeyedTarget(str(tmp_path / "t"), ("id",), 4)
    events = events_of(8, 60)
    merge(spark, target, events[:30])
    before = rows_of(target, spark)
    # data of the next version without its manifest: the attempt died between the two
    spark.createDataFrame([(0, "x", "y", 1)], "_bucket int, id string, email string, seq int").write.partitionBy("_bucket").parquet(f"{target.path}/data/_version=2")
    assert rows_of(target, spark) == before
    merge(spark, target, events[30:])
    assert rows_of(target, spark) == batch_run(spark, events)


def test_new_columns_and_composite_keys(spark, tmp_path):
    target = KeyedTarget(str(tmp_path / "t"), ("a", "b"), 3)
    one = spark.createDataFrame([(1, None, "x", "INSERT", 1), (1, 2, "y", "INSERT", 1)], "a int, b int, v string, operation string, seq int")
    target.merge(one, ["seq"])
    two = spark.createDataFrame([(1, None, "z", 5.0, "UPDATE", 2)], "a int, b int, v string, w double, operation string, seq int")
    target.merge(two, ["seq"])
    got = {(r["a"], r["b"]): (r["v"], r["w"]) for r in target.read(spark).collect()}
    assert got == {(1, None): ("z", 5.0), (1, 2): ("y", None)}


def test_ordering_columns_must_stay(spark, tmp_path):
    target = KeyedTarget(str(tmp_path / "t"), ("id",), 4)
    path = str(tmp_path / "e")
    spark.createDataFrame(events_of(9, 5), EVENT).write.parquet(path)
    stream = sync.read_stream(spark, path, spark.read.parquet(path).schema)
    query = start_upsert(stream, "t", lambda: [*RULES, ColumnRule("t", "seq", "HASHING")], SETTINGS, target, str(tmp_path / "m"), ["seq"], once=True)
    with pytest.raises(Exception, match="cannot be rewritten"):
        query.awaitTermination()


def test_bucket_count_follows_the_rows():
    assert [buckets_for(n) for n in (0, 1, 1_000_000, 1_000_001, 10**11)] == [1, 1, 1, 2, 100_000]


def test_unknown_columns_stay_out_of_the_target(spark, tmp_path):
    """A column that appears in the source is quarantined, the policy goes back to review, and its next version lets it in."""
    from veilwork.plans import policy

    target, path, told = KeyedTarget(str(tmp_path / "t"), ("id",), 4), str(tmp_path / "e"), []
    wide = spark.createDataFrame([(1, "a@x.org", "INSERT", 1, "secret-1"), (2, "b@x.org", "INSERT", 2, None)], EVENT + ", notes string")
    wide.coalesce(1).write.parquet(path)
    stream = lambda: sync.read_stream(spark, path, wide.schema)
    start_upsert(stream(), "t", lambda: RULES, SETTINGS, target, str(tmp_path / "m"), ["seq"], on_shift=lambda *a: told.append(a), once=True).awaitTermination()
    assert told == [("t", ["notes"])] and "notes" not in target.read(spark).columns
    held = quarantined(spark, target)
    assert {r["notes"] for r in held.collect()} == {"secret-1", None}
    assert held.join(target.read(spark), "id").count() == 2  # by the anonymized key
    statuses = spark.createDataFrame([("p", "APPROVED"), ("q", "APPROVED")], "policy_id string, status string")
    shifted = policy.status_after_shift(statuses, spark.createDataFrame([("p",)], "policy_id string"))
    assert {r["policy_id"]: r["status"] for r in shifted.collect()} == {"p": "DRAFT", "q": "APPROVED"}
    more = [*RULES, ColumnRule("t", "notes", "REDACTION")]
    spark.createDataFrame([(1, "a@x.org", "UPDATE", 3, "secret-2")], wide.schema).coalesce(1).write.mode("append").parquet(path)
    start_upsert(stream(), "t", lambda: more, SETTINGS, target, str(tmp_path / "m"), ["seq"], once=True).awaitTermination()
    notes = {r["seq"]: r["notes"] for r in target.read(spark).collect()}
    assert notes[2] is None and notes[3] not in (None, "secret-2")


def test_repeated_and_late_events(spark, tmp_path):
    """An event delivered again is stored once; one beyond the watermark is dropped; the marks say how far the queue is."""
    import datetime as dt

    at = lambda h: dt.datetime(2024, 5, 1) + dt.timedelta(hours=h)
    path, queue = str(tmp_path / "e"), str(tmp_path / "q")
    batches = [
        [("e1", "t", at(0)), ("e2", "t", at(1)), ("e1", "t", at(0))],
        [("e2", "t", at(1)), ("e3", "u", at(20))],
        [("e3", "u", at(20)), ("late", "t", at(2)), ("e4", "t", at(19))],
    ]
    schema = "event_id string, table_name string, at timestamp"
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
        stream = sync.read_stream(spark, path, spark.read.parquet(path).schema)
        sync.start_event_queue(stream, queue, str(tmp_path / "m"), True, "event_id", "at", "6 hours").awaitTermination()
    stored = spark.read.parquet(queue)
    assert sorted(r["event_id"] for r in stored.collect()) == ["e1", "e2", "e3", "e4"]
    marks = {r["table_name"]: (r["events"], r["last_id"], r["last_time"]) for r in sync.queue_marks(stored, "event_id", "at").collect()}
    assert marks == {"t": (3, "e4", at(19)), "u": (1, "e3", at(20))}
    with pytest.raises(ValueError, match="name both"):
        sync.start_event_queue(stored, queue, "x", event_id="event_id")


def test_large_buckets_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    """Rows of a task follow ``ROWS_PER_TASK``, not the number of buckets."""
    from veilwork.sources import keyed

    monkeypatch.setattr(keyed, "ROWS_PER_TASK", 50)
    target = keyed.KeyedTarget(str(tmp_path / "t"), ("k",), 2)
    events = spark.range(2000).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("at"), F.lit("PUT").alias("operation"), F.col("id").alias("v"))
    target.merge(events, ["at"])
    later = events.filter("v % 2 = 0").withColumns({"at": F.lit(2), "v": -F.col("v")})
    version = target.merge(later, ["at"])
    files = spark.read.parquet(f"{target.path}/data/_version={version}").groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in files) == 2000 and max(r["count"] for r in files) < 400
    assert {r["k"]: r["v"] for r in target.read(spark).select("k", "v").collect()} == {str(i): i if i % 2 else -i for i in range(2000)}


def shuffle_files(spark):
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    folders = [f.getPath() for f in env.blockManager().diskBlockManager().localDirs()]
    return {p.name for folder in folders for p in Path(folder).rglob("shuffle_*")}


def test_a_merge_leaves_nothing_on_the_local_disks(spark, tmp_path):
    """Three batches, refused deletes among them: no shuffle file stays until the driver collects its garbage, nothing is cached."""
    target = KeyedTarget(str(tmp_path / "t"), ("id",), 4)
    child = apply_policy(spark.createDataFrame([(7,), (3,)], "owner long"), "child", RULES, SETTINGS)
    events, before, setting = events_of(11, 120), shuffle_files(spark), spark.conf.get(SHUFFLE_CLEANUP)
    for part in (events[60:], events[:60], events[60:]):
        merge(spark, target, part, [(child, "owner")])
    end = time.monotonic() + 20
    while (left := shuffle_files(spark) - before) and time.monotonic() < end:
        time.sleep(0.2)
    assert not left and not spark.sparkContext._jsc.getPersistentRDDs()
    assert spark.conf.get(SHUFFLE_CLEANUP) == setting
    assert rows_of(target, spark) == batch_run(spark, events, [(child, "owner")])


@pytest.mark.parametrize("seed", [12, 13])
def test_large_batches_are_merged_in_steps(spark, tmp_path, monkeypatch, seed):
    """A batch of many rows is read once for every few buckets; it still counts as a whole or not at all."""
    from veilwork.sources import keyed

    monkeypatch.setattr(keyed, "ROWS_PER_STEP", 10)
    children = [(apply_policy(spark.createDataFrame([(k,) for k in ks], "owner long"), "child", RULES, SETTINGS), "owner") for ks in ([7, 3], [3, 5])]
    target, events = KeyedTarget(str(tmp_path / "t"), ("id",), 5), events_of(seed, 60)
    spark.createDataFrame([(0, "x")], "_bucket int, id string").write.partitionBy("_bucket").parquet(f"{target.path}/data/_version=1")  # of a failed attempt
    versions = [merge(spark, target, part, children) for part in (events[30:], events[:30], [e for e in events if e[2] != "DELETE"])]
    assert versions == [1, 2, 2]
    assert rows_of(target, spark) == batch_run(spark, events, children)
    assert rows_of(target, spark, 1) == batch_run(spark, events[30:], children)
    assert target.refused(spark).count() == sum(1 for e in events if e[0] in (7, 3, 5) and e[2] == "DELETE")


def test_only_refused_deletes(spark, tmp_path):
    """A bucket to which nothing else comes holds no row, and the manifest does not name it."""
    target = KeyedTarget(str(tmp_path / "t"), ("id",), 4)
    child = apply_policy(spark.createDataFrame([(7,)], "owner long"), "child", RULES, SETTINGS)
    assert merge(spark, target, [(7, "a@x.org", "DELETE", 1)], [(child, "owner")]) == 1
    assert target.read(spark) is None and target.refused(spark).count() == 1
    later = [(7, "b@x.org", "INSERT", 2), (7, "c@x.org", "DELETE", 3), (8, "d@x.org", "INSERT", 4)]
    assert merge(spark, target, later, [(child, "owner")]) == 2
    assert rows_of(target, spark) == batch_run(spark, later, [(child, "owner")]) and len(rows_of(target, spark)) == 2


def test_any_text_is_a_key(spark, tmp_path):
    """Keys in hex travel as bytes: no two keys fall together, none is changed, and columns that order the events come back."""
    import datetime as dt

    keys = ["ab", "AB", "Ab", "0ab", "ab0", "", None, "a", "00", "0", "é", "c3a9", "ab ", "x" * 70, "f" * 64]
    schema = "k string, n int, operation string, day date, at double, v array<string>"

    def rows(turn):
        return [(k, i, "PUT", dt.date(2024, 1, turn), [0.5, None, float("nan"), 1.5][(i + turn) % 4], [str(turn), None]) for i, k in enumerate(keys)]

    one, two = (spark.createDataFrame(rows(turn), schema) for turn in (1, 2))
    for order in (["day", "at"], ["day", "operation", "k"]):
        target = KeyedTarget(str(tmp_path / order[1]), ("k",), 3)
        assert [target.merge(df, order) for df in (two.limit(9), one, two, one)] == [1, 2, 3, 3]
        assert sorted(map(repr, target.read(spark).select("k", "n", "day", "at", "v").collect())) == sorted(map(repr, two.drop("operation").collect()))
    pair = KeyedTarget(str(tmp_path / "pair"), ("k", "n"), 3)
    pair.merge(one, ["day"])
    assert pair.read(spark).count() == len(keys)
