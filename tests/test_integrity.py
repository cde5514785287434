"""Keys, references, the vault and order-dependent operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from veilwork.functions.digests import derive_key, sha256_hex
from veilwork.operators import integrity, ordered, vault
from veilwork.operators.integrity import Relation

KEY = derive_key("unit")


@pytest.fixture(scope="module")
def shop(spark):
    customers = spark.createDataFrame([(i,) for i in range(1, 6)], "id int")
    orders = spark.createDataFrame(
        [(1, 1), (2, 1), (3, 9), (4, 9), (5, 8), (6, None), (7, 2)], "id int, customer_id int"
    )
    items = spark.createDataFrame([(i, i % 9) for i in range(20)], "id int, order_id int")
    return {"customers": customers, "orders": orders, "items": items}


ORDERS = Relation("orders", "customer_id", "customers", "id")
ITEMS = Relation("items", "order_id", "orders", "id")


def test_orphans(shop):
    assert integrity.count_orphans(shop, ORDERS).first()["orphans"] == 3
    assert integrity.count_orphans(shop, ORDERS, count_nulls=True).first()["orphans"] == 4
    report = {r["relation"]: r["orphans"] for r in integrity.orphan_report(shop, [ORDERS, ITEMS]).collect()}
    assert report == {ORDERS.name: 3, ITEMS.name: 5, None: 8}
    top = integrity.top_orphans(shop["orders"], "customer_id", shop["customers"], "id", 1).collect()
    assert [tuple(r) for r in top] == [(9, 2)]


def test_key_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a"), (None, "x")], "id int, v string")
    row = integrity.key_violations({"t": df}, {"t": ["id"]}).first()
    assert tuple(row) == ("t", 1, 1, 2)
    assert integrity.null_keys(df, "id").first()[0] == 1


def test_probe_and_compare(shop, rows):
    keys = shop["customers"].select(F.col("id").alias("key"))
    got = rows(integrity.key_probe(keys, shop["customers"], "id", shop["orders"], "customer_id"))
    assert got == [(1, True, 2), (2, True, 1), (3, True, 0), (4, True, 0), (5, True, 0)]
    cmp = rows(integrity.compare_keys(shop["customers"], "id", shop["orders"], "customer_id"))
    assert cmp == [(1, True, True), (2, True, True), (3, True, False), (4, True, False), (5, True, False), (8, False, True), (9, False, True)]
    ext = integrity.compare_extent({"c": (shop["customers"], "id"), "o": (shop["orders"], "id")})
    assert rows(ext) == [("c", 5, 1, 5), ("o", 7, 1, 7)]


def test_subset_keeps_references(shop):
    kept = integrity.referential_subset(shop, "customers", {"customers": "id", "orders": "id", "items": "id"}, [ORDERS, ITEMS], 2)
    assert [r["id"] for r in kept["customers"].orderBy("id").collect()] == [1, 2]
    assert [r["id"] for r in kept["orders"].orderBy("id").collect()] == [1, 2]
    assert integrity.count_orphans(kept, ORDERS).first()["orphans"] == 0
    assert integrity.count_orphans(kept, ITEMS).first()["orphans"] == 0


def test_load_levels_of_the_crm_schema():
    tables = ["companies", "sales_representatives", "customers", "contacts", "leads", "opportunities", "contracts",
              "support_tickets", "activities", "invoices"]
    edges = [
        ("customers", "companies"), ("contacts", "customers"), ("leads", "companies"), ("leads", "sales_representatives"),
        ("opportunities", "customers"), ("opportunities", "sales_representatives"), ("opportunities", "leads"),
        ("contracts", "customers"), ("contracts", "opportunities"), ("support_tickets", "customers"),
        ("support_tickets", "contacts"), ("support_tickets", "contracts"), ("support_tickets", "sales_representatives"),
        ("activities", "customers"), ("activities", "contacts"), ("activities", "opportunities"), ("activities", "leads"),
        ("activities", "sales_representatives"), ("invoices", "customers"), ("invoices", "contracts"),
    ]
    level = dict(integrity.load_levels(tables, edges))
    assert [sorted(t for t in tables if level[t] == n) for n in range(5)] == [
        ["companies", "sales_representatives"], ["customers", "leads"], ["contacts", "opportunities"],
        ["activities", "contracts"], ["invoices", "support_tickets"],
    ]


def test_load_levels_of_a_cycle(spark):
    assert integrity.load_levels(["a", "b", "c"], [("b", "c"), ("c", "b")]) == [("a", 0), ("b", 1), ("c", 1)]
    cat = spark.createDataFrame([("a", None), ("b", "a")], "table_name string, fk_table string")
    assert {(r["table_name"], r["level"]) for r in integrity.load_order(cat).collect()} == {("a", 0), ("b", 1)}


def test_vault_round_trip(spark, tmp_path, rows):
    df = spark.createDataFrame([("x",), ("y",), ("x",), (None,), ("",)], "v string")
    scope = vault.scope_name("t", "v")
    entries = vault.build(df, "v", sha256_hex(F.col("v")), scope, KEY)
    assert entries.count() == 2
    vault.store(entries, str(tmp_path / "vault"))
    read = spark.read.parquet(str(tmp_path / "vault"))
    found = {r["v"]: r["out"] for r in vault.lookup(df.unionByName(spark.createDataFrame([("miss",)], "v string")), "v", read, scope, KEY, "out").collect()}
    assert found["x"] and found["miss"] is None and found[None] is None
    replaced = df.select(sha256_hex(F.col("v")).alias("v"))
    assert {r["original"] for r in vault.reveal(replaced, "v", read, scope, KEY).collect()} == {"x", "y"}
    again = vault.build(df, "v", sha256_hex(F.col("v")), scope, KEY)
    assert again.exceptAll(entries).count() == 0
    stored_again = vault.merge(read.select(*entries.columns), again)
    assert stored_again.count() == 2
    shared = vault.build(df, "v", F.col("v"), vault.scope_name("t", "v", shared=True), KEY)
    assert rows(vault.stats(entries.unionByName(shared))) == [("global:t.v", "global", 2), ("mapping:t.v", "table", 2), (None, "total", 4)]
    assert vault.without(entries.unionByName(shared), scope).count() == 2
    assert vault.without(entries).count() == 0


def test_vault_partition_overwrite(spark, tmp_path):
    df = spark.createDataFrame([("x",)], "v string")
    path = str(tmp_path / "vault")
    a, b = (vault.build(df, "v", F.col("v"), vault.scope_name("t", c), KEY) for c in "ab")
    vault.store(a, path)
    vault.store(b, path)
    vault.store(a, path)
    assert spark.read.parquet(path).count() == 2


@pytest.fixture(scope="module")
def hot(spark):
    """One group owns most rows; null and small groups as well."""
    rows = [("hot" if i % 3 else (None if i % 2 else f"g{i % 5}"), i, (i * 7) % 4 if i % 11 else None) for i in range(600)]
    return spark.createDataFrame(rows, "grp string, seq int, v int").cache()


@pytest.mark.parametrize("width", [1, 13, 10_000, "even", None])
def test_ordered_operators_equal_plain_windows(spark, hot, width):
    from pyspark.sql import Window

    w = Window.partitionBy("grp").orderBy("seq")
    if width == "even":
        bucket = ordered.even_buckets(hot, F.col("seq"), rows_per_bucket=50)
    else:
        bucket = F.floor(F.col("seq") / width) if width else None
    lagged = ordered.previous_value(hot, ["grp"], ["seq"], "v", "p", bucket)
    plain = hot.select("*", F.lag("v").over(w).alias("p"), (F.row_number().over(w) > 1).alias("p_exists"))
    assert lagged.exceptAll(plain).count() == 0 and lagged.count() == 600
    numbered = ordered.row_numbers(hot, ["grp"], ["seq"], "n", bucket).select("*", F.col("n").cast("int").alias("m")).drop("n")
    assert numbered.exceptAll(hot.select("*", F.row_number().over(w).alias("m"))).count() == 0
    summed = ordered.running_sum(hot, ["grp"], ["seq"], F.coalesce("v", F.lit(0)), "s", bucket)
    assert summed.exceptAll(hot.select("*", F.sum(F.coalesce("v", F.lit(0))).over(w).alias("s"))).count() == 0
    low = ordered.per_group_value(hot, ["grp"], F.min("v"), "low", salts=5)
    assert low.exceptAll(hot.select("*", F.min("v").over(Window.partitionBy("grp")).alias("low"))).count() == 0


@pytest.mark.parametrize("kind", ["int", "text", "stamp", "wide"])
def test_sketched_buckets_split_hot_groups_and_hot_values(spark, monkeypatch, kind):
    """Without a bucket expression the quantiles cut: any type, one value with most rows, null orders."""
    from pyspark.sql import Window

    monkeypatch.setattr(ordered, "ROWS_PER_BUCKET", 40)
    value = {
        "int": lambda i: 5 if i % 2 else i, "text": lambda i: f"2024-01-{i % 28:02d}T{i % 24:02d}", "stamp": lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(hours=i),
        "wide": lambda i: float(i) ** 9 if i % 5 else None,
    }[kind]
    kinds = {"int": "int", "text": "string", "stamp": "timestamp_ntz", "wide": "double"}
    rows = [("hot" if i % 3 else None, value(i), i, i % 7) for i in range(500)]
    df = spark.createDataFrame(rows, f"g string, a {kinds[kind]}, b int, v int")
    cut = ordered.with_sketched_buckets(df, ["a", "b"], 40).withColumnRenamed(ordered.BUCKET, "_b")
    sizes = [r["count"] for r in cut.groupBy("g", "_b").count().collect()]
    assert max(sizes) <= 90 and len(sizes) > 8
    w = Window.orderBy("a", "b")
    assert cut.withColumn("_p", F.lag("_b").over(w)).filter("_p > _b").count() == 0  # never falls along the order
    own = Window.partitionBy("g").orderBy("a", "b")
    numbered = ordered.row_numbers(df, ["g"], ["a", "b"], "n", total="t")
    plain = df.select("*", F.row_number().over(own).cast("long").alias("n"), F.count("*").over(Window.partitionBy("g")).alias("t"))
    assert numbered.exceptAll(plain).count() == 0 and numbered.count() == 500


def test_ordered_plans_shuffle_the_table_once(spark):
    """No checkpoint; the rows are exchanged once, the other exchanges move one row per bucket."""
    from tests.test_plans import simple

    table = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        text = simple(ordered.row_numbers(table, ["g"], ["id"], "n"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    main = text.split("Subquery")[0] if text.index("Join") < text.find("Subquery") else text
    assert "ExistingRDD" not in text and "SortMergeJoin" in main
    fine = main[main.index("SortMergeJoin") :]
    rows = fine[: fine.index("HashAggregate")] if "HashAggregate" in fine else fine
    assert rows.count("Exchange hashpartitioning") <= 3 and "max_by" not in rows


def test_only_large_groups_are_cut(spark, monkeypatch):
    """Small groups stay whole: the summary has rows of large groups alone, whatever the number of groups."""
    monkeypatch.setattr(ordered, "ROWS_PER_BUCKET", 40)
    df = spark.createDataFrame([("hot" if i % 2 else (None if i % 10 == 0 else f"g{i % 90}"), f"{i:04d}", i) for i in range(600)], "g string, a string, b int")
    cut = ordered._cut(df, ["g"], ["a", "b"], None)
    found = {r["g"]: r for r in cut.groupBy("g").agg(F.countDistinct(ordered.BUCKET).alias("n"), F.max(ordered.LARGE).alias("large")).collect()}
    assert {g for g, r in found.items() if r["large"]} == {"hot", None} and found["hot"]["n"] > 3 and found[None]["n"] > 1
    assert all(r["n"] == 1 for g, r in found.items() if g not in ("hot", None)) and len(found) > 10


def test_versions_are_counted_once_for_totals(spark, data):
    from tests.test_plans import simple
    from veilwork import queries

    windows = [simple(queries.all_queries()[q](spark, data)).count("Window [") for q in ("run_versions", "records_total")]
    assert windows[0] == windows[1]


def test_vault_joins_are_not_broadcast(spark):
    """A vault passes for small by the size of the columns it is made of."""
    from tests.test_plans import simple

    df, scope = spark.createDataFrame([("x",), ("y",)], "v string"), vault.scope_name("t", "v")
    entries = vault.build(df, "v", F.upper("v"), scope, KEY)
    for found in (vault.lookup(df, "v", entries, scope, KEY, "r"), vault.reveal(df, "v", entries, scope, KEY), vault.merge(entries, entries)):
        assert "BroadcastHashJoin" not in simple(found)


def test_vault_store_first_writer_wins(spark, tmp_path):
    value = F.col("v")
    store = vault.VaultStore(str(tmp_path / "v"), 4)
    scope = vault.scope_name("t", "v")
    some = lambda *vs: spark.createDataFrame([(v,) for v in vs], "v string")
    asked = lambda df, prefix, epoch: {r["v"]: r["replacement"] for r in store.assign(df, "v", F.concat(F.lit(prefix), value), scope, KEY, epoch).collect()}
    assert asked(some("a", "b", "", None, "a"), "one-", 1) == {"a": "one-a", "b": "one-b", "": "", None: None}
    assert asked(some("b", "c"), "two-", 2) == {"b": "one-b", "c": "two-c"}
    assert asked(some("a", "b", "c"), "three-", 3) == {"a": "one-a", "b": "one-b", "c": "two-c"}
    held = store.read(spark)
    without = held.drop("token_hash")  # as older vaults were written
    assert {r["original"] for r in vault.reveal(some("two-c"), "v", without, scope, KEY).collect()} == {"c"}
    assert held.count() == 3 and {r["original"] for r in vault.reveal(some("one-a", "two-c", "zzz"), "v", held, scope, KEY).collect()} == {"a", "c"}
    # a run of an earlier epoch that wrote apart: its entries win when they are put
    late = vault.lookup_or_create(some("c", "d"), "v", spark.createDataFrame([], vault.ENTRY), F.concat(F.lit("zero-"), value), scope, KEY, 0)[1]
    store.put(late)
    assert asked(some("c", "d"), "four-", 4) == {"c": "zero-c", "d": "zero-d"}


def test_a_vault_writer_that_lost_looks_again(spark, tmp_path, monkeypatch):
    store = vault.VaultStore(str(tmp_path / "v"), 4)
    scope, value = vault.scope_name("t", "v"), F.col("v")
    df = spark.createDataFrame([("a",)], "v string")
    real, met = vault.VaultStore.put, []

    def other_first(self, entries):
        if not met:
            met.append(1)
            version = real(self, vault.lookup_or_create(df, "v", self.read(spark), F.lit("theirs"), scope, KEY, 1)[1])
            spark.range(1).write.mode("errorifexists").parquet(f"{self.path}/manifest/_version={version}")  # what a late writer meets
        return real(self, entries)

    monkeypatch.setattr(vault.VaultStore, "put", other_first)
    got = store.assign(df, "v", F.lit("ours"), scope, KEY, 2)
    assert [r["replacement"] for r in got.collect()] == ["theirs"]
