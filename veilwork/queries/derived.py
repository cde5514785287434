"""Inputs that Spark derives from the given tables, row for row.

Each is a projection of a whole table, written once as a template and rendered
for Spark and for the reference engine, so both sides start from equal rows:

* ``persons``  identifier-shaped values from ``customer``
* ``fields``   declared columns (a policy's raw material) from ``events``
* ``audit``    audit entries from ``events``
* ``runs``     run history from ``orders``
* ``batches``  batch log from ``lineitem``
* ``reviews``  review events from ``events``
* ``log_lines``, ``statements``  text of logs and of SQL statements
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from .registry import Tables, q, s52


class Dialect:
    def __init__(self, spark: bool) -> None:
        self.spark = spark

    def sha(self, text: str) -> str:
        return f"sha2({text}, 256)" if self.spark else f"sha256({text})"

    def h(self, digest: str, slot: int = 0) -> str:
        if self.spark:
            return f"cast(conv(substr({digest}, {1 + 13 * slot}, 13), 16, 10) as bigint)"
        return s52(digest, slot)

    def pick(self, pool: Sequence[str | None], number: str) -> str:
        words = ", ".join("null" if w is None else q(w) for w in pool)
        at = f"({number} % {len(pool)}) + 1"
        return f"element_at(array({words}), cast({at} as int))" if self.spark else f"([{words}])[{at}]"

    def digits(self, number: str, n: int) -> str:
        return f"lpad(cast({number} % {10**n} as string), {n}, '0')"

    def letters(self, digest: str, start: int, n: int) -> str:
        return f"translate(substr({digest}, {start}, {n}), '0123456789abcdef', 'ABCDEFGHIJKLMNOP')"

    def iso(self, ts: str) -> str:
        if self.spark:
            return f"date_format({ts}, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")"
        return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f')"

    def day(self, number: str) -> str:
        if self.spark:
            return f"date_add(date'1950-01-01', cast({number} as int))"
        return f"(date '1950-01-01' + cast({number} as int))"


SPARK, DUCK = Dialect(True), Dialect(False)
NUMBERS = ("dg", "n0", "n1", "n2")  # digest of the row's key and three numbers cut from it

FIELD_NAMES = (
    "email", "phone_no", "mobile", "contact_id", "aadhaar_no", "uid_code", "pan_card", "company", "first_name",
    "dob", "birth_place", "address_line", "city", "state", "pincode", "shipping_note", "salary",
    "account_balance", "amount_due", "income_tax", "ssn", "card_no", "customer_id", "paid", "stage", "gstin",
    "account_number", "zip_code", "gender", "notes", "flag", "age", "order_total", "product_code",
    "patient_ref", "loan_ref", "call_data", "premium", "claim_no", "employee_no",
)
TABLE_NAMES = ("customers", "orders", "policies", "employees", "patients", "accounts", "calls")
RAW_TYPES = (
    None, "UNKNOWN", "email", "PHONE", "NAME", "IDENTIFIER", "FINANCIAL", "NON_PII", "VOTER_ID", "HEALTH", "",
    "OTHER", "DOB",
)
TECHNIQUES = (
    "NO_CHANGE", "HASHING", "MASKING", "TOKENIZATION", "DIFFERENTIAL_PRIVACY", "REDACTION", "GENERALIZATION",
    "PSEUDONYMIZATION", "NO_CHANGE", "PERTURBATION", "MASK_EMAIL", "HASH_HMAC",
)
CATEGORIES = ("pipeline", "security", "policy", "database")
STEP_NAMES = ("Extract Schema", "PII Detection", "Policy Generation", "Batch Loading", "Audit Report")


def _persons(d: Dialect) -> dict[str, str]:
    digest, n0, n1, n2 = NUMBERS
    a, b, c = d.digits(n0, 4), d.digits(n1, 4), d.digits(n2, 4)
    pan = f"{d.letters(digest, 1, 5)} || {d.digits(n1, 4)} || {d.letters(digest, 6, 1)}"
    return {
        "customer_id": "c_custkey",
        "full_name": "c_name",
        "aadhaar_no": (
            f"CASE {n2} % 13 WHEN 0 THEN null WHEN 1 THEN '' WHEN 2 THEN substr({a}, 1, 3) "
            f"WHEN 3 THEN {a} || {b} || {c} WHEN 4 THEN {a} || '-' || {b} || '-' || {c} "
            f"ELSE {a} || ' ' || {b} || ' ' || {c} END"
        ),
        "pan_no": f"CASE {n2} % 5 WHEN 0 THEN lower({pan}) ELSE {pan} END",
        "phone": f"CASE {n2} % 4 WHEN 0 THEN '' WHEN 1 THEN '+91-' ELSE '+91 ' END || cast(6 + {n0} % 4 as string) || {d.digits(n1, 9)}",
        "gstin": f"{d.digits(n0, 2)} || {pan} || '1Z' || {d.letters(digest, 7, 1)}",
        "passport_no": f"{d.letters(digest, 8, 1)} || {d.digits(n0, 7)}",
        "license_no": f"CASE {n1} % 2 WHEN 0 THEN {d.letters(digest, 9, 2)} || {d.digits(n0, 2)} || {d.letters(digest, 11, 2)} || {c} ELSE 'DL-' || {d.digits(n0, 2)} || '-' || {d.digits(n1, 11)} END",
        "voter_no": f"{d.letters(digest, 13, 3)} || {d.digits(n1, 7)}",
        "uan_no": d.digits(n0, 12),
        "ref": f"CASE {n1} % 3 WHEN 0 THEN {d.digits(n0, 12)} WHEN 1 THEN {d.letters(digest, 1, 8)} ELSE {d.digits(n0, 8)} END",
        "credit_card": f"{d.digits(n0, 4)} || ' ' || {d.digits(n1, 8)} || '-' || {c}",
        "account_no": d.digits(n1, 11),
        "email": f"CASE {n1} % 9 WHEN 0 THEN 'x' || {d.digits(n0, 3)} WHEN 1 THEN 'q@example.org' ELSE lower(replace(c_name, '#', '.')) || '@example.com' END",
        "pincode": f"CASE {n0} % 11 WHEN 0 THEN '12' ELSE {d.digits(n0, 6)} END",
        "city": "c_mktsegment",
        "birth_date": d.day(f"({n1} % 20000)"),
        "balance": "c_acctbal",
    }


def _fields(d: Dialect) -> dict[str, str]:
    digest, n0, n1, n2 = NUMBERS
    return {
        "policy_id": "user_id",
        "table_name": d.pick(TABLE_NAMES, n1),
        "column_name": f"{d.pick(FIELD_NAMES, n0)} || '_' || cast(event_id as string)",
        "seq": "event_id",
        "is_pii": f"({n2} % 3 <> 0)",
        "pii_type": d.pick(RAW_TYPES, n2),
        "confidence": f"CASE {n1} % 7 WHEN 0 THEN null ELSE cast({n1} % 101 as double) / 100 END",
        "technique": d.pick(TECHNIQUES, n1),
        "data_type": d.pick(("bigint", "string", "double", "date"), n2),
        "is_pk": f"({n0} % 11 = 0)",
        "fk_table": f"CASE WHEN {n0} % 11 IN (1, 2) THEN {d.pick(TABLE_NAMES, n2)} END",
        "fk_column": f"CASE WHEN {n0} % 11 IN (1, 2) THEN 'id' END",
    }


def _audit(d: Dialect) -> dict[str, str]:
    _, n0, n1, _ = NUMBERS
    return {
        "id": "'log_' || cast(event_id as string)",
        "timestamp": d.iso("ts"),
        "user_id": "'user_' || cast(user_id as string)",
        "run_id": "'RUN-' || cast(user_id as string)",
        "step_index": f"cast({n0} % 17 + 1 as int)",
        "step_name": d.pick((*STEP_NAMES, None), n1),
        "category": d.pick(CATEGORIES, n0),
        "level": "CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'view' THEN 'warning' ELSE 'info' END",
        "action": "'Action ' || event_type",
        "details": "props",
        "seq": "event_id",
    }


def _runs(d: Dialect) -> dict[str, str]:
    _, n0, _, _ = NUMBERS
    return {
        "user_id": "o_custkey",
        "run_id": "o_orderkey",
        "timestamp": d.iso("o_orderdate"),
        "table_name": "o_orderpriority",
        "records": f"CASE {n0} % 3 WHEN 0 THEN 0 ELSE cast(floor(o_totalprice) as bigint) END",
        "privacy_score": f"cast(100 - {n0} % 90 as double)",
        "risk_score": f"cast({n0} % 90 as double)",
    }


def _batches(d: Dialect) -> dict[str, str]:
    return {
        "table_name": "l_returnflag || l_linestatus",
        "kind": "CASE WHEN l_discount >= 0.095 THEN 'deadlock' WHEN l_discount >= 0.085 THEN 'readonly' WHEN l_discount >= 0.075 THEN 'resume' ELSE 'batch' END",
        "rows": "cast(l_quantity as bigint)",
        "seconds": "l_tax",
    }


def _reviews(d: Dialect) -> dict[str, str]:
    return {
        "policy_id": "user_id",
        "ts": "ts",
        "event_id": "event_id",
        "action": "CASE event_type WHEN 'signup' THEN 'reset' WHEN 'click' THEN 'approve' WHEN 'view' THEN 'approve' ELSE 'reject' END",
        "comment": "CASE WHEN event_type = 'purchase' AND value > 20 THEN props END",
    }


def _log_lines(d: Dialect) -> dict[str, str]:
    e = "cast(event_id as string)"
    return {
        "seq": "event_id",
        "line": (
            "CASE event_type "
            "WHEN 'view' THEN 'Processing table: tbl_' || cast(user_id as string) || ' Progress: ' || cast(user_id % 100 as string) || '%' "
            f"WHEN 'click' THEN 'Chunk: ' || {e} || '/' || cast(event_id + 9 as string) || ' batch 3' "
            f"WHEN 'purchase' THEN 'Processed: ' || {e} || ' rows into Table : t' || cast(user_id as string) "
            f"WHEN 'signup' THEN 'Batch ' || {e} || ' written by append' "
            "ELSE 'unknown ' || props END"
        ),
    }


def _statements(d: Dialect) -> dict[str, str]:
    k = "cast(o_orderkey as string)"
    return {
        "seq": "o_orderkey",
        "statement": (
            "CASE o_orderstatus "
            "WHEN 'O' THEN 'INSERT INTO \"Orders_' || substr(o_orderpriority, 1, 1) || '\" (id) VALUES (?)' "
            f"WHEN 'F' THEN ' update `orders` set x = ' || {k} || ' where id = ?' "
            "ELSE CASE WHEN o_totalprice > 200000 THEN 'delete  from archive-2 where id = ?' ELSE 'SELECT 1' END END"
        ),
        "first_parameter": f"CASE WHEN o_totalprice > 100000 THEN {k} END",
    }


# name -> (columns, source table, key column the digest is taken of)
_VIEWS = {
    "persons": (_persons, "customer", "c_custkey"),
    "fields": (_fields, "events", "event_id"),
    "audit": (_audit, "events", "event_id"),
    "runs": (_runs, "orders", "o_orderkey"),
    "batches": (_batches, "lineitem", None),
    "reviews": (_reviews, "events", None),
    "log_lines": (_log_lines, "events", None),
    "statements": (_statements, "orders", None),
}


def _digest(d: Dialect, name: str, key: str) -> str:
    return d.sha(f"'{name}|' || cast({key} as string)")


def frame(t: Tables, name: str) -> DataFrame:
    """The view as a frame.  The digest is computed in a projection of its own, once per row."""
    build, source, key = _VIEWS[name]
    df = t.spread(source)
    if key:
        df = df.selectExpr("*", f"{_digest(SPARK, name, key)} AS dg")
        df = df.selectExpr("*", *[f"{SPARK.h('dg', i)} AS n{i}" for i in range(3)])
    return df.selectExpr(*[f"{sql} AS {alias}" for alias, sql in build(SPARK).items()])


def cte(*names: str) -> str:
    """``WITH`` prefix that defines the views for the reference engine."""
    parts = []
    for name in names:
        build, source, key = _VIEWS[name]
        body = ", ".join(f'{sql} AS "{alias}"' for alias, sql in build(DUCK).items())
        inner = source
        if key:
            numbers = ", ".join(f"{DUCK.h('dg', i)} AS n{i}" for i in range(3))
            inner = f"(SELECT *, {numbers} FROM (SELECT *, {_digest(DUCK, name, key)} AS dg FROM {source}))"
        parts.append(f"{name} AS MATERIALIZED (SELECT {body} FROM {inner})")
    return "WITH " + ", ".join(parts) + " "
