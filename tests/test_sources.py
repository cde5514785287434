"""Scans, guards, catalogs, logs and histories."""

import json

import pytest
from pyspark.sql import functions as F

from veilwork.operators import search, stats
from veilwork.plans.run import draft_policy
from veilwork.session import cut_lineage
from veilwork.sources import catalog, history, logs, sinks, tables


def test_jdbc_options():
    got = tables.jdbc_options("postgresql", "db", "t", "h", user="u", password="p", partition_column="id", bounds=(0, 9), partitions=4)
    assert got["url"] == "jdbc:postgresql://h:5432/db" and got["numPartitions"] == "4" and got["upperBound"] == "9"
    assert tables.jdbc_options("mysql", "db", "t", "h", 99)["url"] == "jdbc:mysql://h:99/db"
    assert tables.jdbc_options("sqlserver", "db", "t", "h")["url"] == "jdbc:sqlserver://h:1433;databaseName=db"
    assert tables.jdbc_options("sqlite", "/x.db", "t")["url"] == "jdbc:sqlite:/x.db"
    for bad in ({"kind": "oracle"}, {"kind": "mysql"}, {"kind": "mysql", "host": "h", "partition_column": "id"}):
        with pytest.raises(ValueError):
            tables.jdbc_options(**{"database": "d", "table": "t"} | bad)


def test_source_and_target_must_differ(tmp_path, spark):
    tables.require_distinct("/a/b", "/a/c")
    tables.require_distinct("s3://one/a", "s3://two/a")
    for a, b in (("/a/b", "file:///a/b/"), ("/a", "/a/b"), ("s3://x/a/b", "S3://x/a")):
        with pytest.raises(ValueError, match="overlap"):
            tables.require_distinct(a, b)
    with pytest.raises(ValueError, match="overlap"):
        sinks.append_rows(spark.range(1), str(tmp_path), source=str(tmp_path))


def test_choosing_tables(spark):
    assert tables.choose_tables(["a", "B"], " b , zzz") == ["B"]
    assert tables.choose_tables(["a", "b"], "zzz") == ["a", "b"]
    assert tables.choose_tables(["a", "b"], None) == ["a", "b"]


def test_latest_records(spark):
    df = spark.sql("select 1 as id, timestamp'2024-01-01 10:00:00' as t, array(1) as a, date'2024-02-03' as d union all select 2, null, array(), null")
    first = tables.latest_records(df, 1).first()
    assert tuple(first) == (2, None, "[]", None)
    assert tuple(tables.latest_records(df).collect()[1]) == (1, "2024-01-01T10:00:00", "[1]", "2024-02-03")


def test_catalog_and_inspection(spark, rows):
    df = spark.createDataFrame([(1, "a")], "id int, name string")
    keys = catalog.declared_keys(spark, [("t", "id", True, None, None, True)])
    cat = catalog.catalog(catalog.columns_of(spark, {"t": df, "u": df}), keys)
    assert rows(cat, "table_name", "column_name", "ordinal", "data_type", "is_pk") == [
        ("t", "id", 1, "int", True), ("t", "name", 2, "string", False), ("u", "id", 1, "int", False), ("u", "name", 2, "string", False),
    ]
    assert catalog.text_columns(cat).count() == 2
    sized = cat.withColumn("data_type", F.lit("VARCHAR(20)"))
    assert catalog.text_columns(sized).first()["max_length"] == 20
    listing = catalog.type_listing(cat.filter("table_name = 't'"), cat.filter("table_name = 't' and column_name = 'id'"))
    assert rows(listing, "column_name", "target_type") == [("id", "int"), ("name", None)]
    assert rows(tables.inspect_tables({"t": df, "u": df})) == [("t", 1, 2), ("u", 1, 2), (None, 2, 4)]


def test_draft_policy_with_external_answers(spark):
    df = spark.createDataFrame([(i, "ABCDE1234F", "x") for i in range(12)], "id bigint, tax string, note string")
    cat = catalog.catalog(catalog.columns_of(spark, {"t": df}), catalog.declared_keys(spark, [("t", "id", True, None, None, True)]))
    external = spark.createDataFrame(
        [("t", "id", False, None, 0.0, None), ("t", "tax", True, "TAX_NO", 0.9, "hashing")],
        "table_name string, column_name string, is_pii boolean, pii_type string, confidence double, technique string",
    )
    got = {r["column_name"]: r for r in draft_policy({"t": df}, cat, {"t": "id"}, external).collect()}
    assert (got["tax"]["pii_type"], round(got["tax"]["confidence"], 4)) == ("TAX_NO", 0.99)
    assert got["note"]["is_pii"] is True  # no answer: treated as personal until reviewed
    assert (got["id"]["technique"], got["id"]["is_pk"]) == ("NO_CHANGE", True)
    alone = {r["column_name"]: r["technique"] for r in draft_policy({"t": df}, cat, {"t": "id"}).collect()}
    assert alone == {"id": "NO_CHANGE", "tax": "MASKING", "note": "NO_CHANGE"}


def test_log_lines(spark):
    lines = [
        "Step: PII Detection started", "Chunk: 3/12 of table: users", "Processed: 500 rows (45%)", "BATCH 7 done", "nothing here",
        "Processing table: orders",
    ]
    got = [r.asDict() for r in logs.parse_log_lines(spark.createDataFrame([(x,) for x in lines], "line string")).collect()]
    assert got[0]["step"] == 5
    assert (got[1]["step"], got[1]["current_chunk"], got[1]["total_chunks"], got[1]["table_name"]) == (11, 3, 12, "users")
    assert (got[2]["step"], got[2]["records_processed"], got[2]["progress"]) == (13, 500, 45.0)
    assert (got[3]["step"], got[3]["batch_number"]) == (None, 7)
    assert all(v is None for k, v in got[4].items() if k != "line")
    assert (got[5]["table_name"], got[5]["step"]) == ("orders", 11)


def test_histories_of_all_tenants(spark, tmp_path):
    for user in ("ann", "bob"):
        run = {"run_id": f"r-{user}", "timestamp": "2024", "records_anonymized": 5, "policy_snapshot": {"column_policies": [
            {"table_name": "t", "column_name": "c", "is_pii": True, "pii_type": "EMAIL", "anonymization_technique": "hashing"}, {"table_name": "t", "column_name": "d"}]}}
        (tmp_path / f"run_history_{user}.json").write_text(json.dumps([run, run | {"run_id": "x"}], indent=1))
    runs = history.read_histories(spark, str(tmp_path / "run_history_*.json"))
    assert sorted(r["user_id"] for r in runs.collect()) == ["ann", "ann", "bob", "bob"]
    snaps = history.snapshot_columns(runs)
    assert snaps.count() == 8 and {r["technique"] for r in snaps.collect()} == {"HASHING", "NO_CHANGE"}


def test_searches(spark):
    df = spark.createDataFrame([(1, "Alpha"), (2, None)], "id int, name string")
    assert search.any_column_contains(df, "LPH").count() == 1
    assert search.any_column_contains(df, "2").count() == 1
    assert search.any_column_contains(df, "").count() == 2
    pol = spark.createDataFrame([("t", "b", "EMAIL", True), ("t", "a", "PAN", True), ("s", "z", "X", False)], "table_name string, column_name string, pii_type string, is_pii boolean")
    assert [r["column_name"] for r in search.pii_columns(pol).collect()] == ["a", "b"]
    assert search.search_policy(pol, "ema").count() == 1 and search.search_policy(pol, pii_type="X").count() == 1
    assert search.column_policy(pol, "t", "a").first()["pii_type"] == "PAN"


def test_completeness_and_storage(spark, rows):
    counts = spark.createDataFrame([("a", 10), ("b", 5), ("c", 0), ("d", 3)], "table_name string, row_count long")
    targets = spark.createDataFrame([("a", 10), ("b", 20), ("c", 5)], "table_name string, target long")
    assert rows(stats.completeness(counts, targets), "table_name", "state", "percentage", "remaining") == [
        ("a", "complete", 100.0, 0), ("b", "partial", 25.0, 15), ("c", "not_started", 0.0, 5), ("d", "not_started", None, 0),
    ]
    sizes = spark.createDataFrame([("a", 10, 1048576)], "table_name string, row_count long, bytes long")
    assert rows(stats.storage_projection(sizes, targets.filter("table_name = 'a'"))) == [("a", 10, 1.0), (None, 10, 1.0)]
    assert spark.createDataFrame([("é", 1)], "a string, b int").transform(lambda d: d.select(stats.text_bytes(d))).first()[0] == 3


def test_mapping_rewrite(spark, tmp_path):
    df = spark.createDataFrame([("a", "1"), ("b", "2")], "scope string, key_hash string")
    sinks.write_without(df, str(tmp_path / "m"), {"scope": "a"})
    assert [r["scope"] for r in spark.read.parquet(str(tmp_path / "m")).collect()] == ["b"]


def test_cut_lineage(spark):
    assert cut_lineage(spark.range(5)).count() == 5


def test_spread_small(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    small = spark.read.parquet(str(tmp_path / "one"))
    assert tables.spread_small(small).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(0, 1000, 1, 50)
    assert tables.spread_small(wide) is wide


def test_drafts_of_text_keys_and_empty_tables_run(spark, tmp_path):
    """A draft has every column of every table, and a run of it keeps keys joined."""
    from veilwork.functions.techniques import Settings
    from veilwork.operators.apply import apply_policy, rules_from

    people = spark.createDataFrame([(f"ABCDE{1000 + i}F", f"n{i}") for i in range(30)], "pan_key string, note string")
    visits = spark.createDataFrame([(i, f"ABCDE{1000 + i % 20}F") for i in range(60)], "id bigint, visitor string")
    empty = spark.createDataFrame([], "code string, email string")
    tables_ = {"people": people, "visits": visits, "empty": empty}
    keys = [("people", "pan_key", True, None, None, True), ("visits", "id", True, None, None, True), ("visits", "visitor", False, "people", "pan_key", False)]
    cat = catalog.catalog(catalog.columns_of(spark, tables_), catalog.declared_keys(spark, keys))
    policy = draft_policy(tables_, cat, {"people": "pan_key", "visits": "id", "empty": "code"})
    got = {(r["table_name"], r["column_name"]): r["technique"] for r in policy.collect()}
    assert set(got) == {("people", "pan_key"), ("people", "note"), ("visits", "id"), ("visits", "visitor"), ("empty", "code"), ("empty", "email")}
    assert got["people", "pan_key"] == got["visits", "visitor"] == "HASHING" and got["visits", "id"] == "NO_CHANGE"
    done = {n: apply_policy(df, n, rules_from(policy, n, strict=True), Settings("s"), ["id"] if n == "visits" else ()) for n, df in tables_.items()}
    assert done["visits"].join(done["people"], F.col("visitor") == F.col("pan_key")).count() == 60


def test_documents_keep_every_field(spark):
    from veilwork.sources import policy_docs

    doc = """{"column_policies": [{"table_name": "t", "column_name": "a", "is_primary_key": true, "unknown": {"x": [1, 2]}, "confidence": "0.5"},
      {"table_name": "t", "column_name": "b", "is_foreign_key": false, "foreign_key_details": {"referred_table": "u", "referred_columns": ["c"]}},
      {"table_name": "t", "column_name": "c", "foreign_key_details": {"referred_table": "u", "referred_columns": ["c", "d"]}, "admin_comments": "ok"}]}"""
    docs = spark.createDataFrame([("p", doc), ("bad", "{not json"), ("none", None), ("empty", "{}")], "policy_id string, doc string")
    got = {r["column_name"]: r for r in policy_docs.policy_rows(docs).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"]["is_pk"] is True and got["a"]["confidence"] == 0.5
    assert '"x":[1,2]' in got["a"]["entry"]
    assert (got["b"]["fk_table"], got["c"]["fk_table"], got["c"]["fk_column"], got["c"]["admin_comment"]) == (None, "u", "c", "ok")
