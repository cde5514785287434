"""Keys, references and the mapping vault."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.digests import sha256_hex
from ..functions.techniques import ColumnRule
from ..operators import integrity, vault
from ..operators.apply import apply_policy, rules_from
from ..operators.integrity import Relation
from ..session import shared_folder
from ..plans import run
from .derived import cte, frame
from .registry import KEY, SETTINGS, keyed, q, query

RELATIONS = (
    Relation("orders", "o_custkey", "customer", "c_custkey"),
    Relation("lineitem", "l_orderkey", "orders", "o_orderkey"),
    Relation("lineitem", "l_partkey", "part", "p_partkey"),
    Relation("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    Relation("customer", "c_nationkey", "nation", "n_nationkey"),
    Relation("supplier", "s_nationkey", "nation", "n_nationkey"),
    Relation("nation", "n_regionkey", "region", "r_regionkey"),
    Relation("events", "user_id", "customer", "c_custkey"),
    Relation("events", "user_id", "supplier", "s_suppkey"),
    Relation("documents", "doc_id", "labels", "doc_id"),
    Relation("labels", "doc_id", "documents", "doc_id"),
)
TABLES = ("customer", "documents", "events", "labels", "lineitem", "nation", "orders", "part", "region", "supplier")


def _tables(t):
    return {name: getattr(t, name) for name in TABLES}


def _orphans(r: Relation) -> str:
    return (
        f"SELECT {q(r.name)} AS relation, count(*)::bigint AS orphans FROM {r.child} c WHERE c.{r.child_key} IS NOT NULL "
        f"AND NOT EXISTS (SELECT 1 FROM {r.parent} p WHERE p.{r.parent_key} = c.{r.child_key})"
    )


_ALL = " UNION ALL ".join(_orphans(r) for r in RELATIONS)


@query(
    "fk_orphans",
    f"WITH o AS ({_ALL}) SELECT * FROM o UNION ALL SELECT NULL, sum(orphans)::bigint FROM o",
)
def fk_orphans(t):
    """Orphans of every relation, with the grand total."""
    return integrity.orphan_report(_tables(t), RELATIONS)


@query(
    "fk_orphans_with_nulls",
    """WITH child AS (SELECT o_custkey AS k FROM customer LEFT JOIN orders ON c_custkey = o_custkey), parent AS (SELECT s_suppkey AS k FROM supplier)
    SELECT 'child.k -> parent.k' AS relation, count(*)::bigint AS orphans FROM child
    WHERE k IS NULL OR k NOT IN (SELECT k FROM parent WHERE k IS NOT NULL)""",
)
def fk_orphans_with_nulls(t):
    """Orphans where a missing reference counts as one: customers without an order have a null key."""
    child = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("o_custkey").alias("k"))
    parent = t.supplier.select(F.col("s_suppkey").alias("k"))
    return integrity.count_orphans({"child": child, "parent": parent}, Relation("child", "k", "parent", "k"), True)


@query(
    "fk_orphans_top",
    """SELECT user_id AS key, count(*) AS n FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)
    GROUP BY user_id ORDER BY n DESC, key LIMIT 10""",
)
def fk_orphans_top(t):
    """The ten orphan keys with the most rows (a top-k report)."""
    return integrity.top_orphans(t.events, "user_id", t.supplier, "s_suppkey")


@query(
    "key_probe",
    """SELECT c_custkey AS key, c_custkey IN (SELECT s_suppkey FROM supplier) AS in_parent,
    (SELECT count(*) FROM events WHERE user_id = c_custkey) AS children FROM customer""",
)
def key_probe(t):
    keys = t.customer.select(F.col("c_custkey").alias("key"))
    return integrity.key_probe(keys, t.supplier, "s_suppkey", t.events, "user_id")


def _violations(table: str, keys: list[str], source: str | None = None) -> str:
    cols = ", ".join(keys)
    null = " OR ".join(f"{k} IS NULL" for k in keys)
    return (
        f"SELECT '{table}' AS table_name, coalesce(sum(n) FILTER (WHERE {null}), 0)::bigint AS null_keys, "
        f"count(*) FILTER (WHERE NOT ({null}) AND n > 1)::bigint AS duplicate_keys, "
        f"coalesce(sum(n - 1) FILTER (WHERE NOT ({null})), 0)::bigint AS surplus_rows "
        f"FROM (SELECT {cols}, count(*) AS n FROM {source or table} GROUP BY {cols})"
    )


_PKS = {
    "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber"],
    "conversations": ["conv_id", "turn"],
    "persons": ["aadhaar_no"],
}


@query("key_violations", cte("persons") + " UNION ALL ".join(_violations(n, k) for n, k in _PKS.items()))
def key_violations(t):
    """Null and duplicated primary keys per table."""
    tables = {"orders": t.orders, "lineitem": t.lineitem, "conversations": t.conversations, "persons": frame(t, "persons")}
    return integrity.key_violations(tables, _PKS)


@query("null_keys", cte("persons") + "SELECT count(*) FILTER (WHERE aadhaar_no IS NULL)::bigint AS null_keys FROM persons")
def null_keys(t):
    return integrity.null_keys(frame(t, "persons"), "aadhaar_no")


@query(
    "unseen_rows",
    "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def unseen_rows(t):
    """Rows whose key was not seen yet (key difference)."""
    return integrity.unseen_rows(t.documents.drop("text"), "doc_id", t.labels, "doc_id")


@query(
    "compare_keys",
    """SELECT coalesce(a.k, b.k) AS key, a.k IS NOT NULL AS in_left, b.k IS NOT NULL AS in_right
    FROM (SELECT DISTINCT user_id AS k FROM events) a FULL OUTER JOIN (SELECT s_suppkey AS k FROM supplier) b ON a.k = b.k""",
)
def compare_keys(t):
    return integrity.compare_keys(t.events, "user_id", t.supplier, "s_suppkey")


@query(
    "compare_extent",
    """SELECT 'orders' AS store, count(*) AS row_count, min(o_orderkey) AS min_key, max(o_orderkey) AS max_key FROM orders
    UNION ALL SELECT 'lineitem', count(*), min(l_orderkey), max(l_orderkey) FROM lineitem""",
)
def compare_extent(t):
    return integrity.compare_extent({"orders": (t.orders, "o_orderkey"), "lineitem": (t.lineitem, "l_orderkey")})


@query(
    "referential_subset",
    """WITH n AS (SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 12),
    c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM n) ORDER BY c_custkey LIMIT 12),
    o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c) ORDER BY o_orderkey LIMIT 12)
    SELECT o_orderkey, o_custkey, o_totalprice FROM o""",
)
def referential_subset(t):
    """First 12 nations, then the first 12 of their customers, then of the customers' orders."""
    tables = {"nation": t.nation, "customer": t.customer, "orders": t.orders}
    keys = {"nation": "n_nationkey", "customer": "c_custkey", "orders": "o_orderkey"}
    chain = [RELATIONS[4], RELATIONS[0]]
    kept = integrity.referential_subset(tables, "nation", keys, chain, 12)
    return kept["orders"].select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "kept_children",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN
    (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0))""",
)
def kept_children(t):
    """All children of kept parents, two levels deep."""
    customers = t.customer.filter("c_acctbal < 0")
    orders = integrity.keep_children(t.orders, "o_custkey", customers, "c_custkey")
    return integrity.keep_children(t.lineitem, "l_orderkey", orders, "o_orderkey").select("l_orderkey", "l_linenumber", "l_partkey")


_EDGES = f"""WITH o AS ({_ALL}), e AS (SELECT split_part(relation, '.', 1) AS child, split_part(split_part(relation, ' -> ', 2), '.', 1) AS parent
  FROM o WHERE orphans = 0)"""


@query(
    "load_order",
    _EDGES.replace("WITH", "WITH RECURSIVE", 1)
    + f""", tabs AS (SELECT unnest([{", ".join(q(n) for n in TABLES)}]) AS table_name),
    lv AS (SELECT table_name, 0 AS level FROM tabs UNION
           SELECT e.child, lv.level + 1 FROM lv JOIN e ON e.parent = lv.table_name WHERE lv.level < 10)
    SELECT table_name, max(level)::int AS level FROM lv GROUP BY table_name""",
)
def load_order(t):
    """Load levels over the references that hold in the data (relations without orphans)."""
    report = integrity.union_all(integrity.count_orphans(_tables(t), r) for r in RELATIONS)
    names = F.split("relation", " -> ")
    edge = lambda i: F.split(names[i], r"\.")[0]
    edges = report.filter("orphans = 0").select(edge(0).alias("child"), edge(1).alias("parent"))
    return integrity.load_order_of(t.spark.createDataFrame([(n,) for n in TABLES], "table_name string"), edges.cache())


@query(
    "fk_preserved",
    """SELECT count(*) AS joined, count(DISTINCT o_custkey) AS parents FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def fk_preserved(t):
    """The anonymized join equals the raw join (joined rows and parents)."""
    rules = [
        ColumnRule("customer", "c_custkey", "TOKENIZATION", "FULL_NAME", is_primary_key=True),
        ColumnRule("orders", "o_custkey", "TOKENIZATION", "FULL_NAME", fk_table="customer", fk_column="c_custkey"),
    ]
    customer = apply_policy(t.customer, "customer", rules, SETTINGS).select("c_custkey")
    orders = apply_policy(t.orders, "orders", rules, SETTINGS).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return joined.agg(F.sum("n").alias("joined"), F.count(F.lit(1)).alias("parents"))


_CHAIN = [
    # table, column, technique, type, primary key, referenced table and column
    ("customer", "c_custkey", "HASHING", "IDENTIFIER", True, None, None),
    ("customer", "c_name", "TOKENIZATION", "EMAIL", False, None, None),
    ("orders", "o_custkey", "HASHING", None, False, "customer", "c_custkey"),
    ("orders", "o_owner", "TOKENIZATION", "FULL_NAME", False, "customer", "c_name"),
    ("events", "user_id", "HASHING", "FREE_TEXT", False, "orders", "o_custkey"),
    ("events", "holder", "TOKENIZATION", "PHONE", False, "orders", "o_owner"),
]


def _chain_policy(t):
    rows = [(*r[:4], True, *r[4:]) for r in _CHAIN]
    return t.spark.createDataFrame(
        rows, "table_name string, column_name string, technique string, pii_type string, is_pii boolean, is_pk boolean, fk_table string, fk_column string"
    )


def _chain_tables(t):
    """Customers, orders that name their owner by a unique text, and events that name the orders' owner."""
    owner = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("o_owner"))
    orders = t.orders.select("o_orderkey", "o_custkey").join(owner, "o_custkey")
    holder = owner.select(F.col("o_custkey").alias("user_id"), F.col("o_owner").alias("holder"))
    return {"customer": t.customer.select("c_custkey", "c_name"), "orders": orders, "events": t.events.select("event_id", "user_id").join(holder, "user_id")}


@query(
    "fk_chain",
    """SELECT count(*) AS joined, count(DISTINCT c_custkey) AS parents, count(*) AS by_name FROM
    (SELECT o_custkey FROM orders GROUP BY 1) JOIN customer ON c_custkey = o_custkey JOIN events ON user_id = o_custkey""",
)
def fk_chain(t):
    """A chain of three tables, by key and by a referenced unique text, joins as the raw tables do.

    Every table is rewritten by its own rules, as a run does it table by table.
    """
    policy, tables = _chain_policy(t), _chain_tables(t)
    done = {n: apply_policy(df, n, rules_from(policy, n, strict=True), SETTINGS) for n, df in tables.items()}
    orders = done["orders"].select("o_custkey", "o_owner").distinct()
    by_key = orders.join(done["customer"], orders["o_custkey"] == F.col("c_custkey")).join(done["events"], F.col("user_id") == F.col("o_custkey"))
    by_name = orders.join(done["customer"], orders["o_owner"] == F.col("c_name")).join(done["events"], F.col("holder") == F.col("o_owner"))
    counted = by_key.agg(F.count(F.lit(1)).alias("joined"), F.count_distinct("c_custkey").alias("parents"))
    return counted.select("*", by_name.agg(F.count(F.lit(1)).alias("n")).scalar().alias("by_name"))


@query(
    "resume_chain",
    """SELECT count(*) AS missing, (SELECT count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 3 <> 0) AS equal_to_batch
    FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 3 <> 0""",
)
def resume_chain(t):
    """What a half-done load still lacks is replaced as the batch run replaces it, chains included."""
    policy, orders = _chain_policy(t), _chain_tables(t)["orders"]
    batch = apply_policy(orders, "orders", rules_from(policy), SETTINGS, ["o_orderkey"])
    loaded = batch.filter("o_orderkey % 3 = 0")
    rest = run.resume_table(orders, "orders", loaded, policy, SETTINGS, "o_orderkey")
    same = rest.join(batch, rest.columns, "left_semi")
    return rest.agg(F.count(F.lit(1)).alias("missing")).select("*", same.agg(F.count(F.lit(1)).alias("n")).scalar().alias("equal_to_batch"))


# --- vault ------------------------------------------------------------------------------------

SCOPE = vault.scope_name("persons", "pan_no")


def _vault(t, column="pan_no", scope=SCOPE):
    text = F.col(column).cast("string")
    return vault.build(frame(t, "persons"), column, sha256_hex(text), scope, KEY)


@query(
    "vault_entries",
    cte("persons")
    + f"SELECT DISTINCT {q(SCOPE)} AS scope, {keyed('pan_no', '')} AS key_hash FROM persons WHERE pan_no IS NOT NULL AND pan_no <> ''",
)
def vault_entries(t):
    return _vault(t).select("scope", "key_hash")


@query(
    "vault_lookup",
    cte("persons") + "SELECT DISTINCT pan_no, sha256(pan_no) AS replacement FROM persons",
)
def vault_lookup(t):
    """Stored replacement of every value: seal, store, look up, unseal."""
    return vault.lookup(frame(t, "persons"), "pan_no", _vault(t), SCOPE, KEY, "replacement")


@query(
    "vault_reveal",
    cte("persons") + "SELECT DISTINCT sha256(pan_no) AS pan_no, pan_no AS original FROM persons WHERE pan_no <> ''",
)
def vault_reveal(t):
    """Reverse lookup: from the replacement back to the original."""
    replaced = frame(t, "persons").select(sha256_hex(F.col("pan_no")).alias("pan_no"))
    return vault.reveal(replaced, "pan_no", _vault(t), SCOPE, KEY)


_HASHED = "SELECT DISTINCT {c}::varchar AS v FROM persons WHERE {c} IS NOT NULL AND {c}::varchar <> ''"


@query(
    "vault_merge",
    cte("persons")
    + f""", a AS ({_HASHED.format(c="city")}), b AS ({_HASHED.format(c="pincode")})
    SELECT origin, count(*) AS entries FROM (
      SELECT 'existing' AS origin, v FROM a UNION ALL
      SELECT 'offline', v FROM (SELECT v FROM b UNION SELECT v FROM a) WHERE v NOT IN (SELECT v FROM a)) GROUP BY origin""",
)
def vault_merge(t):
    """Offline entries join the vault; what is already there wins."""
    existing = _vault(t, "city").withColumn("origin", F.lit("existing"))
    offline = _vault(t, "city").unionByName(_vault(t, "pincode")).withColumn("origin", F.lit("offline"))
    return vault.merge(existing, offline).groupBy("origin").agg(F.count(F.lit(1)).alias("entries"))


_STORED = "CASE WHEN substr(sha256(pan_no), 1, 1) < '8' THEN 'kept-' || lower(pan_no) ELSE sha256(pan_no) END"


@query(
    "vault_lookup_or_create",
    cte("persons")
    + f"""SELECT DISTINCT pan_no, {_STORED} AS replacement, substr(sha256(pan_no), 1, 1) < '8' AS stored FROM persons""",
)
def vault_lookup_or_create(t):
    """Half the values are stored under other replacements, which win; the rest is made."""
    value = F.col("pan_no")
    stored = frame(t, "persons").filter(F.substring(sha256_hex(value), 1, 1) < "8")
    held = vault.build(stored, "pan_no", F.concat(F.lit("kept-"), F.lower(value)), SCOPE, KEY)
    return vault.lookup_or_create(frame(t, "persons"), "pan_no", held, sha256_hex(value), SCOPE, KEY, 2)[0]


@query(
    "vault_first_writer",
    cte("persons")
    + """SELECT DISTINCT pan_no, CASE WHEN substr(sha256(pan_no), 1, 1) >= 'c' THEN 'late-' || pan_no
      WHEN substr(sha256(pan_no), 1, 1) >= '4' THEN 'first-' || pan_no ELSE NULL END AS replacement FROM persons""",
)
def vault_first_writer(t):
    """Two runs stored replacements of overlapping values: the earlier epoch wins wherever it wrote."""
    value, digit = F.col("pan_no"), F.substring(sha256_hex(F.col("pan_no")), 1, 1)
    epoch = lambda rows, prefix, n: vault.build(
        rows, "pan_no", F.concat(F.lit(prefix), value), SCOPE, KEY
    ).withColumn("epoch", F.lit(n))
    persons = frame(t, "persons")
    first = epoch(persons.filter((digit >= "4") & (digit < "c")), "first-", 1)
    late = epoch(persons.filter(digit >= "8"), "late-", 2)
    return vault.lookup(persons, "pan_no", vault.first_entries(late.unionByName(first)), SCOPE, KEY, "replacement")


@query(
    "vault_assigned",
    cte("persons") + "SELECT DISTINCT pan_no, CASE WHEN substr(sha256(pan_no), 1, 1) < '8' THEN 'one-' ELSE 'two-' END || pan_no AS replacement FROM persons",
)
def vault_assigned(t):
    """Replacements handed out by a stored vault in two runs: the second keeps those of the first."""
    value = F.col("pan_no")
    store = vault.VaultStore(shared_folder(t.spark, "vault"), 8)
    persons = frame(t, "persons")
    store.assign(persons.filter(F.substring(sha256_hex(value), 1, 1) < "8"), "pan_no", F.concat(F.lit("one-"), value), SCOPE, KEY, 1)
    return store.assign(persons, "pan_no", F.concat(F.lit("two-"), value), SCOPE, KEY, 2)


@query(
    "vault_stats",
    cte("persons")
    + f""", s AS (SELECT 'mapping:persons.pan_no' AS scope, 'table' AS kind, count(DISTINCT pan_no) AS entries FROM persons
    UNION ALL SELECT 'global:persons.customer_id', 'global', count(DISTINCT customer_id) FROM persons)
    SELECT * FROM s UNION ALL SELECT NULL, 'total', sum(entries)::bigint FROM s""",
)
def vault_stats(t):
    shared = _vault(t, "customer_id", vault.scope_name("persons", "customer_id", shared=True))
    return vault.stats(_vault(t).unionByName(shared))


@query(
    "vault_cleared",
    cte("persons") + "SELECT 'mapping:persons.city' AS scope, count(DISTINCT city) AS entries FROM persons",
)
def vault_cleared(t):
    """The vault after clearing one scope."""
    both = _vault(t).unionByName(_vault(t, "city", vault.scope_name("persons", "city")))
    return vault.without(both, SCOPE).groupBy("scope").agg(F.count(F.lit(1)).alias("entries"))
