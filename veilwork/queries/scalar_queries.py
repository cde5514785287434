"""Column functions and policy application (masks, tokens, noise, digests)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import digests, masks, noise, pools, tokens
from ..functions.techniques import ColumnRule, Settings
from ..operators.apply import apply_policy, noise_scales, preview
from .derived import cte, frame
from .registry import (
    KEY, SECRET, SETTINGS, compact, hide_tail, keep_blank, keep_tail, keyed, laplace, pick, q, query, s52,
)


def rule(table: str, column: str, technique: str, pii_type: str | None = None, **more) -> ColumnRule:
    return ColumnRule(table, column, technique, pii_type, **more)


FLAGSHIP_RULES = (
    rule("customer", "c_custkey", "HASHING", "IDENTIFIER", is_primary_key=True),
    rule("customer", "c_name", "TOKENIZATION", "FULL_NAME"),
    rule("customer", "c_acctbal", "DIFFERENTIAL_PRIVACY", "FINANCIAL"),
    rule("orders", "o_orderkey", "HASHING", "IDENTIFIER", is_primary_key=True),
    rule("orders", "o_custkey", "HASHING", "IDENTIFIER", fk_table="customer", fk_column="c_custkey"),
    rule("orders", "o_totalprice", "DIFFERENTIAL_PRIVACY", "FINANCIAL"),
)


def noise_text(table: str, column: str, row_key: str) -> str:
    return f"{q(f'{KEY}|{table}.{column}|')} || ({row_key})"


def scale_sql(column: str, table: str) -> str:
    return f"(SELECT {rounded_scale(column)} FROM {table})"


def rounded_scale(column: str) -> str:
    """A tenth of the deviation of the finite values, to six significant digits."""
    x = f"(stddev_pop({column}) FILTER (WHERE isfinite({column}::DOUBLE)) * 0.1)"
    unit = f"('1e' || (floor(log10(nullif({x}, 0))) - 5)::INT)::DOUBLE"
    return f"coalesce(CASE WHEN {x} = 0 THEN 0.0 ELSE round({x} / {unit}) * {unit} END, 1.0)"


@query(
    "policy_join",
    f"""
    WITH c AS (SELECT sha256(c_custkey::varchar) AS k, c_mktsegment FROM customer),
         o AS (SELECT sha256(o_custkey::varchar) AS k,
                      round(o_totalprice + {laplace(noise_text("orders", "o_totalprice", "o_orderkey::varchar"), scale_sql("o_totalprice", "orders"))}, 2) AS price
               FROM orders)
    SELECT c_mktsegment, count(*) AS orders, count(DISTINCT c.k) AS customers,
           cast(round(sum(price) / 1000, 0) AS bigint) AS revenue_thousands
    FROM c JOIN o ON c.k = o.k GROUP BY c_mktsegment
    """,
)
def policy_join(t):
    """Flagship: anonymize customer and orders, join them on the hashed key, aggregate.

    Orders are reduced to one row per hashed customer, map-side, before the
    join: a customer with a third of all orders joins as a single row.
    """
    customer = apply_policy(t.customer, "customer", FLAGSHIP_RULES, SETTINGS)
    orders = apply_policy(t.orders, "orders", FLAGSHIP_RULES, SETTINGS)
    per_customer = orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("price")
    )
    return (
        customer.join(per_customer, customer.c_custkey == per_customer.o_custkey)
        .groupBy("c_mktsegment")
        .agg(
            F.sum("n").alias("orders"),
            F.count(F.lit(1)).alias("customers"),
            F.round(F.sum("price") / 1000, 0).cast("long").alias("revenue_thousands"),
        )
    )


@query("hash_keys", "SELECT sha256(o_orderkey::varchar) AS o_orderkey, sha256(o_custkey::varchar) AS o_custkey FROM orders")
def hash_keys(t):
    rules = [rule("orders", "o_orderkey", "hashing"), rule("orders", "o_custkey", "HASHING")]
    return apply_policy(t.orders, "orders", rules, SETTINGS).select("o_orderkey", "o_custkey")


@query("hash_keyed", f"SELECT c_custkey, {keyed('c_custkey::varchar', '')} AS hashed FROM customer")
def hash_keyed(t):
    rules = [rule("customer", "hashed", "HASHING")]
    settings = Settings(SECRET, keyed_hash=True)
    df = t.customer.select("c_custkey", F.col("c_custkey").alias("hashed"))
    return apply_policy(df, "customer", rules, settings)


_aadhaar = f"""CASE WHEN contains(aadhaar_no, ' ') AND length({compact("aadhaar_no")}) >= 4
    THEN rtrim(regexp_replace({hide_tail("aadhaar_no", 4)}, '(.{{4}})', '\\1 ', 'g')) ELSE {hide_tail("aadhaar_no", 4)} END"""


@query(
    "mask_variants",
    cte("persons")
    + f"""SELECT customer_id, {keep_blank("aadhaar_no", _aadhaar)} AS aadhaar_no, {hide_tail("pan_no", 4)} AS pan_no,
    {hide_tail("gstin", 5)} AS gstin, {keep_tail("credit_card", 4)} AS credit_card,
    {keep_tail("account_no", 4)} AS account_no, {hide_tail("license_no", 4)} AS license_no,
    {hide_tail("uan_no", 4)} AS uan_no, repeat('X', length(ref)) AS ref FROM persons""",
)
def mask_variants(t):
    names = ["aadhaar_no", "pan_no", "gstin", "credit_card", "account_no", "license_no", "uan_no", "ref"]
    rules = [rule("persons", n, "MASKING") for n in names]
    df = frame(t, "persons").select("customer_id", *names)
    return apply_policy(df, "persons", rules, SETTINGS)


@query(
    "edge_mask",
    cte("persons")
    + """SELECT customer_id,
    CASE WHEN contains(email, '@') THEN left(email, 1) || '***'
           || CASE WHEN length(split_part(email, '@', 1)) > 1 THEN right(split_part(email, '@', 1), 1) ELSE '' END
           || '@' || split_part(email, '@', 2)
         ELSE left(email, 1) || '***' || CASE WHEN length(email) > 1 THEN right(email, 1) ELSE '' END END AS email
    FROM persons""",
)
def edge_mask(t):
    return frame(t, "persons").select("customer_id", masks.edge_mask(F.col("email")).alias("email"))


@query(
    "short_tokens",
    """SELECT doc_id, substr(sha256(text), 1, 16) AS short_hash,
    'TOK-' || upper(substr(sha256(text), 1, 8)) AS short_token FROM documents""",
)
def short_tokens(t):
    text = F.col("text")
    return t.documents.select(
        "doc_id", digests.short_hash(text).alias("short_hash"), digests.short_token(text).alias("short_token")
    )


def _mail(d: str) -> str:
    return (
        f"lower({pick(pools.FIRST_NAMES, d, 0)}) || '.' || lower({pick(pools.LAST_NAMES, d, 1)}) || "
        f"({s52(d, 2)} % 10000)::varchar || '@' || {pick(pools.MAIL_DOMAINS, d, 3)}"
    )


def _scope(column: str) -> str:
    return keyed(f"{column}::varchar", f"persons.{column}")


_T = {
    "full_name": f"{pick(pools.FIRST_NAMES, _scope('full_name'), 0)} || ' ' || {pick(pools.LAST_NAMES, _scope('full_name'), 1)}",
    "email": _mail(_scope("email")),
    "phone": f"'+91 ' || (6 + {s52(_scope('phone'), 0)} % 4)::varchar || lpad(({s52(_scope('phone'), 1)} % 1000000000)::varchar, 9, '0')",
    "city": pick(pools.CITIES, _scope("city"), 0),
    "pincode": f"(100000 + {s52(_scope('pincode'), 0)} % 900000)::varchar",
    "ref": pick(pools.WORDS, _scope("ref"), 0),
}


@query(
    "tokenize_columns",
    cte("persons") + "SELECT customer_id, " + ", ".join(f"{x} AS {c}" for c, x in _T.items()) + " FROM persons",
)
def tokenize_columns(t):
    rules = [rule("persons", c, "TOKENIZATION") for c in (*_T, "customer_id")]
    df = frame(t, "persons").select("customer_id", *_T)
    return apply_policy(df, "persons", rules, SETTINGS)


@query(
    "tokenize_addresses",
    f"""SELECT s_suppkey, ({s52(keyed("s_name", "supplier.s_name"), 2)} % 999 + 1)::varchar || ' '
    || {pick(pools.STREETS, keyed("s_name", "supplier.s_name"), 1)} || ', '
    || {pick(pools.CITIES, keyed("s_name", "supplier.s_name"), 0)} AS s_name FROM supplier""",
)
def tokenize_addresses(t):
    rules = [rule("supplier", "s_name", "TOKENIZATION", "ADDRESS")]
    return apply_policy(t.supplier.select("s_suppkey", "s_name"), "supplier", rules, SETTINGS)


_row = keyed("c_custkey::varchar", "people#row")


@query(
    "row_names",
    f"""SELECT c_custkey, {pick(pools.FIRST_NAMES, _row, 0)} AS first_name, {pick(pools.LAST_NAMES, _row, 1)} AS last_name,
    {pick(pools.FIRST_NAMES, _row, 0)} || ' ' || {pick(pools.LAST_NAMES, _row, 1)} AS full_name FROM customer""",
)
def row_names(t):
    """First, last and full name of a row agree."""
    df = t.customer.select("c_custkey", *[F.col("c_name").alias(n) for n in tokens.ROW_NAME_COLUMNS])
    rules = [rule("people", n, "TOKENIZATION") for n in tokens.ROW_NAME_COLUMNS]
    return apply_policy(df, "people", rules, Settings(SECRET, row_names=True), ["c_custkey"])


_pseudo = keyed("url", "pages.url#pseudonym")


@query(
    "pseudonyms",
    cte("persons")
    + f"""SELECT customer_id,
    {pick(pools.FIRST_NAMES, keyed("full_name", "persons.full_name#pseudonym"), 0)} || ' ' ||
    {pick(pools.LAST_NAMES, keyed("full_name", "persons.full_name#pseudonym"), 1)} AS full_name,
    {_mail(keyed("email", "persons.email#pseudonym"))} AS email,
    {pick(pools.WORDS, keyed("ref", "persons.ref#pseudonym"), 0)} AS ref FROM persons""",
)
def pseudonyms(t):
    names = ["full_name", "email", "ref"]
    rules = [rule("persons", n, "PSEUDONYMIZATION") for n in names]
    return apply_policy(frame(t, "persons").select("customer_id", *names), "persons", rules, SETTINGS)


@query(
    "unique_key_tokens",
    f"""SELECT {pick(pools.WORDS, keyed("url", "pages.url"), 0)} || '-' || right({keyed("url", "pages.url")}, 32) AS url
    FROM pages""",
)
def unique_key_tokens(t):
    """A tokenized key stays injective."""
    rules = [rule("pages", "url", "TOKENIZATION", is_primary_key=True)]
    return apply_policy(t.pages.select("url"), "pages", rules, SETTINGS)


@query(
    "generalize_columns",
    cte("persons")
    + """SELECT customer_id, 'CITY' AS city,
    CASE WHEN length(pincode) >= 3 THEN left(pincode, 3) || 'XXX' ELSE 'XXXXXX' END AS pincode,
    left(birth_date::varchar, 4) || '-XX-XX' AS birth_date, 'GENERALIZED' AS ref, 'LOCATION' AS full_name FROM persons""",
)
def generalize_columns(t):
    kinds = {"city": None, "pincode": None, "birth_date": "DATE_OF_BIRTH", "ref": None, "full_name": "ADDRESS"}
    rules = [rule("persons", n, "GENERALIZATION", kind) for n, kind in kinds.items()]
    return apply_policy(frame(t, "persons").select("customer_id", *kinds), "persons", rules, SETTINGS)


@query("redact_columns", "SELECT conv_id, turn, CASE WHEN text IS NULL OR text = '' THEN text ELSE 'REDACTED' END AS text FROM conversations")
def redact_columns(t):
    return apply_policy(
        t.conversations.select("conv_id", "turn", "text"), "conversations", [rule("conversations", "text", "REDACTION")], SETTINGS
    )


@query(
    "noise_scale",
    f"""SELECT {rounded_scale("l_quantity")} AS l_quantity,
    {rounded_scale("l_extendedprice")} AS l_extendedprice FROM lineitem""",
)
def noise_scale(t):
    rules = [rule("lineitem", c, "DIFFERENTIAL_PRIVACY") for c in ("l_quantity", "l_extendedprice")]
    return noise_scales(t.lineitem, rules)


_li_key = "l_orderkey::varchar || chr(1) || l_linenumber::varchar || chr(1) || l_partkey::varchar"


@query(
    "noise_values",
    f"""SELECT l_orderkey, l_linenumber,
    round(l_extendedprice + {laplace(noise_text("lineitem", "l_extendedprice", _li_key), scale_sql("l_extendedprice", "lineitem"))}, 2) AS l_extendedprice,
    round(l_quantity + {laplace(noise_text("lineitem", "l_quantity", _li_key), scale_sql("l_quantity", "lineitem"))}, 0) AS l_quantity
    FROM lineitem""",
)
def noise_values(t):
    rules = [
        rule("lineitem", "l_extendedprice", "DIFFERENTIAL_PRIVACY", "FINANCIAL"),
        rule("lineitem", "l_quantity", "DIFFERENTIAL_PRIVACY"),
    ]
    done = apply_policy(t.spread("lineitem"), "lineitem", rules, SETTINGS, ["l_orderkey", "l_linenumber", "l_partkey"])
    return done.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")


@query(
    "noise_age",
    f"""SELECT p_partkey, greatest(round(p_size + {laplace(noise_text("part", "age", "p_partkey::varchar"), scale_sql("p_size", "part"))}, 0), 0.0) AS age
    FROM part""",
)
def noise_age(t):
    df = t.part.select("p_partkey", F.col("p_size").alias("age"))
    return apply_policy(df, "part", [rule("part", "age", "DIFFERENTIAL_PRIVACY")], SETTINGS, ["p_partkey"])


@query(
    "noise_dates",
    f"""SELECT o_orderkey, o_orderdate::date + round({laplace(noise_text("orders", "o_orderdate", "o_orderkey::varchar"), "14.0::double")}, 0)::int AS o_orderdate
    FROM orders""",
)
def noise_dates(t):
    df = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"))
    settings = Settings(SECRET, date_noise_days=14)
    return apply_policy(df, "orders", [rule("orders", "o_orderdate", "DIFFERENTIAL_PRIVACY")], settings, ["o_orderkey"])


@query("fixed_factor", "SELECT s_suppkey, round(s_acctbal * 1.02::double, 2) AS s_acctbal FROM supplier")
def fixed_factor(t):
    return t.supplier.select("s_suppkey", noise.fixed_factor(F.col("s_acctbal")).alias("s_acctbal"))


_share = (sum(ord(ch) for ch in "o_totalprice") % 20 - 10) / 100


@query(
    "preview_values",
    cte("persons")
    + f"""SELECT p.customer_id,
    CASE WHEN length(email) - length(replace(email, '@', '')) = 1
         THEN CASE WHEN length(split_part(email, '@', 1)) > 2 THEN left(email, 2) ELSE '' END || '***@' || split_part(email, '@', 2)
         ELSE '***' END AS email,
    '[TOK_' || upper(left(pan_no, 3)) || '_948]' AS pan_no,
    floor(balance * (1 + {_share})::double + 0.5::double) AS balance FROM persons p""",
)
def preview_values(t):
    return frame(t, "persons").select(
        "customer_id",
        masks.preview_email(F.col("email")).alias("email"),
        masks.preview_token(F.col("pan_no")).alias("pan_no"),
        noise.preview_shift(F.col("balance"), "o_totalprice").alias("balance"),
    )


@query(
    "preview_policy",
    """SELECT c_custkey AS c_custkey__before, sha256(c_custkey::varchar) AS c_custkey, c_name AS c_name__before,
    repeat('X', length(c_name)) AS c_name, c_nationkey, c_acctbal, c_mktsegment
    FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 5)""",
)
def preview_policy(t):
    """Before and after of the first five rows (the review view shows five)."""
    rules = [rule("customer", "c_custkey", "HASHING", is_primary_key=True), rule("customer", "c_name", "MASKING")]
    return preview(t.customer, "customer", rules, SETTINGS)


@query(
    "apply_lineitem",
    f"""SELECT sha256(l_orderkey::varchar) AS l_orderkey, sha256(l_partkey::varchar) AS l_partkey, l_suppkey, l_linenumber, l_quantity,
    round(l_extendedprice + {laplace(noise_text("lineitem", "l_extendedprice", _li_key), scale_sql("l_extendedprice", "lineitem"))}, 2) AS l_extendedprice,
    l_discount, l_tax, l_returnflag, l_linestatus, strftime(l_shipdate, '%Y') || '-XX-XX' AS l_shipdate FROM lineitem""",
)
def apply_lineitem(t):
    """A whole fact table through its policy: two hashes, one noise, one generalization."""
    rules = [
        rule("lineitem", "l_orderkey", "HASHING", fk_table="orders", fk_column="o_orderkey"),
        rule("lineitem", "l_partkey", "HASHING", fk_table="part", fk_column="p_partkey"),
        rule("lineitem", "l_extendedprice", "DIFFERENTIAL_PRIVACY", "FINANCIAL"),
        rule("lineitem", "l_shipdate", "GENERALIZATION", "DATE_OF_BIRTH"),
    ]
    return apply_policy(t.spread("lineitem"), "lineitem", rules, SETTINGS, ["l_orderkey", "l_linenumber", "l_partkey"])


@query(
    "null_and_empty",
    cte("persons")
    + """SELECT customer_id, CASE WHEN aadhaar_no IS NULL OR aadhaar_no = '' THEN aadhaar_no ELSE sha256(aadhaar_no) END AS aadhaar_no
    FROM persons""",
)
def null_and_empty(t):
    df = frame(t, "persons").select("customer_id", "aadhaar_no")
    return apply_policy(df, "persons", [rule("persons", "aadhaar_no", "HASHING")], SETTINGS)


@query(
    "reanonymize",
    f"""SELECT o_orderkey, {keyed("o_custkey::varchar", "")} AS o_custkey, o_orderstatus, o_totalprice, o_orderdate,
    repeat('X', length(o_orderpriority)) AS o_orderpriority FROM orders""",
)
def reanonymize(t):
    """The same table under a changed policy."""
    rules = [rule("orders", "o_custkey", "HASHING"), rule("orders", "o_orderpriority", "MASKING")]
    return apply_policy(t.orders, "orders", rules, Settings(SECRET, keyed_hash=True))
