"""Incremental extracts, change detection and change application."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.techniques import ColumnRule
from ..operators import compare
from ..operators.apply import apply_policy
from ..session import shared_folder
from ..sources import sinks
from ..sources.keyed import KeyedTarget
from ..streaming import changes, statements, upsert
from .derived import cte, frame
from .registry import SETTINGS, query


@query(
    "statement_events",
    cte("statements")
    + r"""SELECT seq, lower(regexp_extract(statement, '(?i)(?:INSERT\s+INTO|UPDATE|DELETE\s+FROM)\s+["`]?([a-zA-Z0-9_-]+)["`]?', 1)) AS table_name,
    CASE WHEN upper(trim(statement)) LIKE 'INSERT%' THEN 'INSERT' WHEN upper(trim(statement)) LIKE 'UPDATE%' THEN 'UPDATE' ELSE 'DELETE' END AS operation,
    coalesce(first_parameter, 'auto') AS primary_key, 'queued' AS status
    FROM statements WHERE NOT upper(trim(statement)) LIKE 'SELECT%'""",
)
def statement_events(t):
    """Change events from the text of SQL statements."""
    return statements.change_events(frame(t, "statements")).select("seq", "table_name", "operation", "primary_key", "status")


def _state(name: str, table: str, key: str, time: str, where: str = "true") -> str:
    ts = f"max({time})" if time else "NULL::timestamp"
    return f"SELECT '{name}' AS table_name, count(*) AS row_count, max({key}) AS max_id, {ts} AS max_time FROM {table} WHERE {where}"


@query(
    "table_states",
    "SELECT table_name, row_count, max_id, strftime(max_time, '%Y-%m-%d %H:%M:%S') AS max_time FROM ("
    + " UNION ALL ".join(
        [
            _state("events", "events", "event_id", "ts"),
            _state("orders", "orders", "o_orderkey", "o_orderdate"),
            _state("customer", "customer", "c_custkey", ""),
        ]
    )
    + ")",
)
def table_states(t):
    """High-water marks: rows, greatest key and latest change of each table."""
    states = changes.table_states(
        {
            "events": (t.events, "event_id", "ts"),
            "orders": (t.orders, "o_orderkey", "o_orderdate"),
            "customer": (t.customer, "c_custkey", None),
        }
    )
    return states.withColumn("max_time", F.date_format("max_time", "yyyy-MM-dd HH:mm:ss"))




@query(
    "change_reasons",
    """WITH s AS (SELECT user_id::varchar AS table_name, ts < timestamp '2024-01-16' AS early, event_id, ts, event_type FROM events),
    o AS (SELECT table_name, count(*) AS n, max(event_id) AS mid, max(ts) AS mt FROM s WHERE early AND event_type <> 'view' GROUP BY 1),
    w AS (SELECT table_name, count(*) AS n, max(event_id) AS mid, max(ts) AS mt FROM s WHERE NOT early AND event_type <> 'click' GROUP BY 1)
    SELECT table_name, reason FROM (SELECT coalesce(o.table_name, w.table_name) AS table_name,
      CASE WHEN o.n <> w.n THEN 'row_count' WHEN w.mid > o.mid THEN 'max_id' WHEN w.mt > o.mt THEN 'max_time' END AS reason
      FROM o FULL OUTER JOIN w ON o.table_name = w.table_name) WHERE reason IS NOT NULL""",
)
def change_reasons(t):
    """First reason why a table counts as changed between two snapshots (a table per user)."""
    base = t.events.withColumn("table_name", F.col("user_id").cast("string"))
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")

    def state(df):
        return df.groupBy("table_name").agg(
            F.count(F.lit(1)).alias("row_count"), F.max("event_id").alias("max_id"), F.max("ts").alias("max_time")
        )

    old = state(base.filter(early & (F.col("event_type") != "view")))
    new = state(base.filter(~early & (F.col("event_type") != "click")))
    return changes.change_reasons(old, new)


@query(
    "incremental_by_key",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey >
    (SELECT max(l_orderkey) FROM lineitem WHERE l_quantity < 1.5 AND l_returnflag = 'R' AND l_discount = 0)""",
)
def incremental_by_key(t):
    """Rows above the stored key mark (the mark is one value read from the data)."""
    late = t.lineitem.filter("l_quantity < 1.5 and l_returnflag = 'R' and l_discount = 0")
    mark = late.agg(F.max("l_orderkey")).first()[0]
    rows = changes.extract_by_key(t.orders, "o_orderkey", mark)
    return rows.select("o_orderkey", "o_custkey", "o_totalprice")


@query("incremental_by_time", "SELECT event_id, user_id, event_type FROM events WHERE ts > timestamp '2024-01-20 12:00:00'")
def incremental_by_time(t):
    import datetime as dt

    rows = changes.extract_by_time(t.events, "ts", dt.datetime(2024, 1, 20, 12))
    return rows.select("event_id", "user_id", "event_type")


@query(
    "incremental_by_diff",
    "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def incremental_by_diff(t):
    return changes.extract_by_diff(t.documents, "doc_id", t.labels, "doc_id").select("doc_id", "lang")


@query(
    "incremental_auto",
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate > timestamp '2000-06-01' OR o_orderkey >
    (SELECT max(l_orderkey) FROM lineitem WHERE l_quantity < 1.5 AND l_returnflag = 'R' AND l_discount = 0)""",
)
def incremental_auto(t):
    """New keys or later changes, whichever shows."""
    import datetime as dt

    late = t.lineitem.filter("l_quantity < 1.5 and l_returnflag = 'R' and l_discount = 0")
    mark = late.agg(F.max("l_orderkey")).first()[0]
    rows = changes.extract_auto(t.orders, "o_orderkey", mark, "o_orderdate", dt.datetime(2000, 6, 1))
    return rows.select("o_orderkey", "o_custkey")


@query(
    "checkpoint_upsert",
    """SELECT user_id::varchar AS table_name, max(event_id) AS max_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS max_time FROM events GROUP BY user_id""",
)
def checkpoint_upsert(t):
    """One mark per table after merging two sets of marks."""
    marks = (
        t.events.withColumn("early", F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"))
        .groupBy("user_id", "early")
        .agg(F.max("event_id").alias("max_id"), F.max("ts").cast("timestamp").alias("max_time"))
        .withColumn("table_name", F.col("user_id").cast("string"))
    )
    cols = ["table_name", "max_id", "max_time"]
    merged = changes.upsert_checkpoints(marks.filter("early").select(*cols), marks.filter("not early").select(*cols))
    return merged.withColumn("max_time", F.date_format("max_time", "yyyy-MM-dd HH:mm:ss"))


_ORDER = "l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, op"
_LATEST = f"""latest AS (SELECT * FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 'DELETE' WHEN l_linestatus = 'F' THEN 'INSERT' ELSE 'UPDATE' END AS op
   FROM lineitem) QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(c.strip() + " DESC" for c in _ORDER.split(","))}) = 1)"""


def _latest(t):
    op = F.when(F.col("l_returnflag") == "R", "DELETE").when(F.col("l_linestatus") == "F", "INSERT").otherwise("UPDATE")
    events = t.lineitem.withColumn("op", op)
    return changes.latest_events(events, ["l_orderkey"], [c.strip() for c in _ORDER.split(",")])


@query(
    "latest_changes",
    f"WITH {_LATEST} SELECT l_orderkey, op, l_partkey, l_extendedprice FROM latest",
)
def latest_changes(t):
    """Last change event of every key."""
    return _latest(t).select("l_orderkey", "op", "l_partkey", "l_extendedprice")


@query(
    "apply_changes",
    f"""WITH {_LATEST}
    SELECT sha256(o_orderkey::varchar) AS o_orderkey, o_totalprice, repeat('X', length(o_orderpriority)) AS o_orderpriority
    FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM latest)
    UNION ALL SELECT sha256(l_orderkey::varchar), l_extendedprice, repeat('X', length(l_returnflag || l_partkey::varchar)) FROM latest WHERE op <> 'DELETE'""",
)
def apply_changes(t):
    """Destination after upserts and deletes, all values anonymized, keys mapped alike."""
    rules = [ColumnRule("orders", "o_orderkey", "HASHING", is_primary_key=True), ColumnRule("orders", "o_orderpriority", "MASKING")]
    destination = apply_policy(t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority"), "orders", rules, SETTINGS)
    images = _latest(t).select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.col("l_extendedprice").alias("o_totalprice"),
        F.concat("l_returnflag", F.col("l_partkey").cast("string")).alias("o_orderpriority"),
        F.col("op").alias("operation"),
    )
    return changes.apply_changes(destination, apply_policy(images, "orders", rules, SETTINGS), ["o_orderkey"])


@query(
    "refused_deletes",
    "SELECT doc_id, CASE WHEN lang = 'fr' THEN 'DELETE' ELSE 'UPDATE' END AS operation, lang = 'fr' AND doc_id IN (SELECT doc_id FROM labels) AS refused FROM documents",
)
def refused_deletes(t):
    """Deletes of rows that still have children are refused."""
    op = F.when(F.col("lang") == "fr", "DELETE").otherwise("UPDATE").alias("operation")
    allowed, refused = changes.split_deletes(t.documents.select("doc_id", op), "doc_id", t.labels.select(F.col("doc_id").alias("child")), "child")
    return allowed.withColumn("refused", F.lit(False)).unionByName(refused.withColumn("refused", F.lit(True)))


@query(
    "insert_if_absent",
    """SELECT doc_id FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels) WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def insert_if_absent(t):
    """Insert-if-absent: one row per unseen key."""
    new = t.documents.select("doc_id").unionByName(t.labels.select("doc_id"))
    return sinks.rows_to_insert(new, t.labels, ["doc_id"])


@query(
    "resume_load",
    """SELECT sha256(c_custkey::varchar) AS c_custkey, repeat('X', length(c_name)) AS c_name, c_acctbal FROM customer
    WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)""",
)
def resume_load(t):
    """What a half-done load still lacks, compared through the key expression."""
    rules = [ColumnRule("customer", "c_custkey", "HASHING", is_primary_key=True), ColumnRule("customer", "c_name", "MASKING")]
    key_rule = [ColumnRule("orders", "o_custkey", "HASHING", fk_table="customer", fk_column="c_custkey")]
    loaded = apply_policy(t.orders.filter("o_totalprice > 450000"), "orders", key_rule, SETTINGS)
    done = apply_policy(t.customer.select("c_custkey", "c_name", "c_acctbal"), "customer", rules, SETTINGS)
    return sinks.rows_to_resume(done, loaded.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", F.col("c_custkey"))


_OP = "CASE WHEN l_returnflag = 'R' THEN 'DELETE' WHEN l_linestatus = 'F' THEN 'INSERT' ELSE 'UPDATE' END"
_BY = ", ".join(c.strip() + " DESC" for c in _ORDER.split(","))


@query(
    "upsert_target",
    f"""WITH events AS (SELECT *, {_OP} AS op FROM lineitem),
    kept AS (SELECT * FROM events WHERE NOT (op = 'DELETE' AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'))),
    latest AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {_BY}) = 1)
    SELECT sha256(l_orderkey::varchar) AS l_orderkey, l_partkey, l_extendedprice FROM latest WHERE op <> 'DELETE'""",
)
def upsert_target(t):
    """A target kept by key, fed late and twice: as one run over all events, with refused deletes."""
    rules = [
        ColumnRule("lineitem", "l_orderkey", "HASHING", is_primary_key=True),
        ColumnRule("orders", "o_orderkey", "HASHING", fk_table="lineitem", fk_column="l_orderkey"),
    ]
    op = F.when(F.col("l_returnflag") == "R", "DELETE").when(F.col("l_linestatus") == "F", "INSERT").otherwise("UPDATE")
    events = apply_policy(t.lineitem.withColumn("op", op), "lineitem", rules, SETTINGS)
    finished = apply_policy(t.orders.filter("o_orderstatus = 'F'").select("o_orderkey"), "orders", rules, SETTINGS)
    target = KeyedTarget(shared_folder(t.spark, "upsert"), ("l_orderkey",), 8)
    order = [c.strip() for c in _ORDER.split(",")]
    early = F.col("l_linenumber") <= 2
    for batch in (events.filter(~early), events.filter(early), events.filter(~early)):
        upsert.merge_events(target, batch, order, "op", [(finished, "o_orderkey")])
    return target.read(t.spark).select("l_orderkey", "l_partkey", "l_extendedprice")


_OTHER = """SELECT CASE WHEN o_orderkey % 19 = 0 THEN -o_orderkey ELSE o_orderkey END AS o_orderkey, o_custkey,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
  FROM orders WHERE o_orderkey % 17 <> 0"""


@query(
    "changed_rows",
    f"""WITH b AS ({_OTHER})
    SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
      CASE WHEN a.o_orderkey IS NULL THEN 'inserted' WHEN b.o_orderkey IS NULL THEN 'deleted' ELSE 'updated' END AS change
    FROM orders a FULL OUTER JOIN b ON a.o_orderkey = b.o_orderkey
    WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus""",
)
def changed_rows(t):
    """Updated, inserted and deleted keys between two states of a table, by digest tree."""
    key = F.col("o_orderkey")
    later = t.orders.filter(key % 17 != 0).withColumn("o_orderstatus", F.when(key % 13 != 0, F.col("o_orderstatus")))
    later = later.withColumn("o_orderkey", F.when(key % 19 == 0, -key).otherwise(key))
    return compare.compare_rows(t.orders, later, ["o_orderkey"], 15_000, rows_per_leaf=16)


@query(
    "differing_nodes",
    f"""WITH b AS ({_OTHER}), o AS (SELECT count(*) AS n FROM orders)
    SELECT 'root' AS node, (SELECT n FROM o) AS left_rows, (SELECT count(*) FROM b) AS right_rows""",
)
def differing_nodes(t):
    """The root of two digest trees: equal for a shuffled copy, different for a changed one."""
    key = F.col("o_orderkey")
    later = t.orders.filter(key % 17 != 0).withColumn("o_orderstatus", F.when(key % 13 != 0, F.col("o_orderstatus")))
    later = later.withColumn("o_orderkey", F.when(key % 19 == 0, -key).otherwise(key))
    trees = [compare.digest_tree(df, ["o_orderkey"], 1) for df in (t.orders, t.orders.repartition(3), later)]
    found = compare.differing_nodes(trees[0], trees[2]).unionByName(compare.differing_nodes(trees[0], trees[1]))
    return found.filter("level = 0").select(F.lit("root").alias("node"), "left_rows", "right_rows")
