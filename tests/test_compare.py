"""Digest trees: what changed between two stores, without joining what did not."""

import random

import pytest
from pyspark.sql import functions as F

from veilwork.operators import compare, integrity
from veilwork.operators.compare import LEVEL, NODE

ROW = "id long, code string, v double, w string"


def stores(seed, n=400):
    draw = random.Random(seed)
    old = {(i, f"c{i % 7}" if i % 11 else None): (draw.choice([1.0, None, 2.5]), draw.choice(["x", None])) for i in range(n)}
    new = dict(old)
    change = {}
    for k in draw.sample(sorted(old, key=str), 9):
        new[k] = (99.0, new[k][1])
        change[k] = "updated"
    for k in draw.sample(sorted(set(old) - set(change), key=str), 5):
        del new[k]
        change[k] = "deleted"
    for i in range(n, n + 6):
        new[i, None] = (1.0, "x")
        change[i, None] = "inserted"
    return old, new, change


def frame(spark, rows):
    return spark.createDataFrame([(*k, *v) for k, v in rows.items()], ROW)


@pytest.mark.parametrize("rows_per_leaf", [1, 30, 10_000])
def test_changes_are_found(spark, rows_per_leaf):
    old, new, change = stores(rows_per_leaf)
    a, b = frame(spark, old), frame(spark, new).repartition(5)
    found = compare.compare_rows(a, b, ["id", "code"], 400, rows_per_leaf=rows_per_leaf)
    assert {(r["id"], r["code"]): r["change"] for r in found.collect()} == change
    assert compare.compare_rows(a, a.orderBy("v"), ["id", "code"], 400, rows_per_leaf=rows_per_leaf).count() == 0


def test_where_nulls_stand_and_repeats_count(spark):
    one = spark.createDataFrame([(1, None, 2.0, "x"), (2, "a", 1.0, "x"), (2, "a", 1.0, "x"), (None, None, None, None)], ROW)
    two = spark.createDataFrame([(1, None, 2.0, None), (2, "a", 1.0, "x"), (None, None, None, None)], ROW)
    found = compare.compare_rows(one, two, ["id"], 10)
    assert {(r["id"], r["change"]) for r in found.collect()} == {(1, "updated"), (2, "updated")}
    a = spark.createDataFrame([(1, "x", None)], "id int, p string, q string")
    b = spark.createDataFrame([(1, None, "x")], "id int, p string, q string")
    assert compare.compare_rows(a, b, ["id"], 1).count() == 1
    empty = one.limit(0)
    assert {r["change"] for r in compare.compare_rows(empty, one, ["id"], 10).collect()} == {"inserted"}
    assert compare.compare_rows(empty, empty, ["id"], 0).count() == 0
    with pytest.raises(TypeError, match="map columns"):
        m = spark.sql("SELECT 1 AS id, map('a', 1) AS m")
        compare.compare_rows(m, m, ["id"], 1)


def test_nodes_sum_their_children(spark):
    old, new, change = stores(3)
    level = compare.leaf_level(400, 2)
    assert level == 2 and compare.leaf_level(0) == 0 and compare.leaf_level(10_000) == 0 and compare.leaf_level(10_001) == 1
    a, b = (compare.digest_tree(frame(spark, r), ["id", "code"], level) for r in (old, new))
    totals = {r[LEVEL]: (r["n"], r["one"]) for r in a.groupBy(LEVEL).agg(F.sum("n").alias("n"), F.sum("one").alias("one")).collect()}
    assert set(totals) == {0, 1, 2} and len(set(totals.values())) == 1
    nodes = {(r[LEVEL], r[NODE]) for r in compare.differing_nodes(a, b).collect()}
    leaves = {n for lv, n in nodes if lv == 2}
    assert {n // 16 for n in leaves} == {n for lv, n in nodes if lv == 1} and (0, 0) in nodes
    assert 0 < len(leaves) <= len(change)


def test_equal_leaves_are_not_joined(spark):
    """Only rows of differing leaves reach the shuffle below the join of rows."""
    old, new, change = stores(4)
    a, b = frame(spark, old), frame(spark, new)
    level = compare.leaf_level(400, 2)
    trees = [compare.digest_tree(d, ["id", "code"], level) for d in (a, b)]
    leaves = compare.differing_leaves(*trees, level).cache()
    reached = b.withColumn(NODE, compare.leaf_of(["id", "code"], level)).join(leaves, NODE, "left_semi").count()
    assert leaves.count() <= reached < 60 < len(new)
    plan = compare.changed_rows(a, b, ["id", "code"], leaves, level)._jdf.queryExecution().optimizedPlan().toString()
    join, below = plan.index("Join FullOuter"), plan.index("Join LeftSemi")
    assert join < below and plan.count("Join LeftSemi") == 2


def test_extract_by_a_stored_tree(spark, tmp_path):
    old, new, change = stores(5)
    level = compare.leaf_level(400, 2)
    compare.digest_tree(frame(spark, old), ["id", "code"], level).write.parquet(str(tmp_path / "tree"))
    before = spark.read.parquet(str(tmp_path / "tree"))
    rows, tree = compare.extract_changed(frame(spark, new), ["id", "code"], before, level)
    got = {(r["id"], r["code"]) for r in rows.collect()}
    assert {k for k, c in change.items() if c != "deleted"} <= got and len(got) < 60
    again, _ = compare.extract_changed(frame(spark, new), ["id", "code"], tree, level)
    assert again.count() == 0


def test_load_order_of_chains_diamonds_and_cycles(spark):
    tables = spark.createDataFrame([(t,) for t in "abcdefg"], "table_name string")
    edges = [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("a", "a"), ("e", "f"), ("f", "e"), ("g", "e"), ("x", "a"), ("b", "y"), ("b", "a")]
    order = integrity.load_order_of(tables, spark.createDataFrame(edges, "child string, parent string"))
    got = {r["table_name"]: r["level"] for r in order.collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3, "f": 3, "g": 3}
    assert got == dict(integrity.load_levels("abcdefg", edges))
    none = spark.createDataFrame([], "child string, parent string")
    assert {r["level"] for r in integrity.load_order_of(tables, none).collect()} == {0}
    assert integrity.load_order_of(tables.limit(0), none).count() == 0
