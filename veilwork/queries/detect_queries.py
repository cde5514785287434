"""Detection of personal data: values, columns, merged answers, leak scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.patterns import LEAK_PATTERNS, best_match
from ..operators import detect, leaks
from ..plans.run import draft_policy
from ..sources.sampling import head_sample, random_sample
from .derived import cte, frame
from .registry import has_any, q, query, s52

ID_COLUMNS = (
    "aadhaar_no", "pan_no", "phone", "gstin", "passport_no", "license_no", "voter_no", "uan_no", "ref", "email",
    "full_name",
)

# The value rules in the reference dialect (name, test on v, base confidence).
_V = {
    "aadhaar": (r"(regexp_full_match(v, '\d{4}[\s-]?\d{4}[\s-]?\d{4}') OR regexp_full_match(replace(replace(v, ' ', ''), '-', ''), '\d{12}'))", 0.95),
    "pan": (r"regexp_full_match(upper(v), '[A-Z]{5}[0-9]{4}[A-Z]')", 0.98),
    "indian_phone": (r"regexp_matches(replace(replace(v, ' ', ''), '-', ''), '\b(\+91[-\s]?|91)?[6-9]\d{9}\b')", 0.90),
    "gstin": (r"regexp_full_match(upper(v), '[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]')", 0.95),
    "indian_passport": (r"regexp_full_match(upper(v), '[A-Z][0-9]{7}')", 0.60),
    "driving_license": (r"regexp_full_match(upper(v), '[A-Z]{2}[0-9]{2}[A-Z0-9]+|DL[-\s]?[0-9]{2}[-\s]?[0-9]{11}')", 0.75),
    "voter_id": (r"regexp_full_match(upper(v), '[A-Z]{3}[0-9]{7}')", 0.80),
    "uan": (r"regexp_full_match(v, '\d{12}')", 0.85),
}


def _confidence(name: str, base: float) -> str:
    ad, ua = "(contains(c, 'aadhaar') OR contains(c, 'uid'))", "(contains(c, 'uan') OR contains(c, 'epfo') OR contains(c, 'pf') OR contains(c, 'provident'))"
    if name not in ("aadhaar", "uan"):
        return f"{base}::double"
    own, other = (ad, ua) if name == "aadhaar" else (ua, ad)
    return (
        f"CASE WHEN {own} THEN least(0.99::double, {base}::double + 0.1::double) "
        f"WHEN {other} THEN greatest(0.0::double, {base}::double - 0.3::double) ELSE {base}::double END"
    )


def _cells(source: str, key: str, columns) -> str:
    return " UNION ALL ".join(
        f"SELECT {key} AS pos, '{c}' AS c, {c}::varchar AS v FROM {source}" for c in columns
    )


_MATCHES = "matches AS (" + " UNION ALL ".join(
    f"SELECT c, pos, v, {i} AS ord, '{n}' AS pii_type, {_confidence(n, base)} AS conf FROM cells WHERE {test}"
    for i, (n, (test, base)) in enumerate(_V.items())
) + ")"

_TECH = "CASE WHEN pii_type = 'indian_phone' THEN 'tokenization' WHEN pii_type IS NOT NULL THEN 'masking' END"

_VERDICT = f""", {_MATCHES},
 types AS (SELECT c, pii_type, count(*) AS n, avg(conf) AS conf, min(pos * 100 + ord) AS seen FROM matches GROUP BY c, pii_type),
 best AS (SELECT * FROM types QUALIFY row_number() OVER (PARTITION BY c ORDER BY n DESC, seen) = 1)
"""


@query(
    "detect_values",
    cte("persons")
    + f""", cells AS ({_cells("persons", "customer_id", ID_COLUMNS)}), {_MATCHES},
    best AS (SELECT * FROM matches QUALIFY row_number() OVER (PARTITION BY c, pos ORDER BY conf DESC, ord) = 1)
    SELECT cells.pos AS customer_id, cells.c AS column_name, pii_type, round(conf, 4) AS confidence
    FROM cells LEFT JOIN best ON cells.c = best.c AND cells.pos = best.pos""",
)
def detect_values(t):
    """Best match of every value, with the column name as context."""
    cells = detect.long_form(frame(t, "persons"), "persons", F.col("customer_id"), ID_COLUMNS)
    best = best_match(F.col("value"), F.col("column_name"))
    return cells.select(F.col("position").alias("customer_id"), "column_name", best.alias("b")).select(
        "customer_id", "column_name", "b.pii_type", F.round("b.confidence", 4).alias("confidence")
    )


@query(
    "pattern_hits",
    cte("persons")
    + f""", cells AS ({_cells("persons", "customer_id", ID_COLUMNS)}), {_MATCHES}
    SELECT c AS column_name, pii_type, count(*) AS matches, round(avg(conf), 4) AS confidence FROM matches GROUP BY c, pii_type""",
)
def pattern_hits(t):
    """Hits of every identifier rule per column."""
    cells = detect.long_form(frame(t, "persons"), "persons", F.col("customer_id"), ID_COLUMNS)
    return detect.value_matches(cells).groupBy("column_name", "pii_type").agg(
        F.count(F.lit(1)).alias("matches"), F.round(F.avg("confidence"), 4).alias("confidence")
    )


@query(
    "detect_columns",
    cte("persons")
    + f""", cells AS ({_cells("persons", "customer_id", ID_COLUMNS)}){_VERDICT}
    SELECT k.c AS column_name, best.c IS NOT NULL AS is_pii, pii_type, round(coalesce(conf, 0.0::double), 4) AS confidence,
    {_TECH} AS technique, coalesce(n, 0)::bigint AS matches
    FROM (SELECT DISTINCT c FROM cells) k LEFT JOIN best ON k.c = best.c""",
)
def detect_columns(t):
    """Verdict per column over all of its values."""
    cells = detect.long_form(frame(t, "persons"), "persons", F.col("customer_id"), ID_COLUMNS)
    return detect.column_verdicts(cells).select(
        "column_name", "is_pii", "pii_type", F.round("confidence", 4).alias("confidence"), "technique", "matches"
    )


_DETECTED = ("aadhaar_no", "pan_no", "email", "city", "ref", "uan_no")
detect.register_detector("mail")(detect.expression_detector("EMAIL", lambda v: v.rlike(r"^[^@]+@[^@]+$"), "TOKENIZATION"))


@query(
    "detect_with_plugins",
    cte("persons")
    + f""", cells AS ({_cells("persons", "customer_id", _DETECTED)}){_VERDICT},
    m AS (SELECT c, count(*) FILTER (WHERE regexp_full_match(v, '[^@]+@[^@]+')) / nullif(count(*) FILTER (WHERE v <> ''), 0)::double AS share FROM cells GROUP BY c),
    j AS (SELECT k.c, pii_type, conf AS p, CASE WHEN share >= 0.5 THEN share END AS q FROM (SELECT DISTINCT c FROM cells) k
      LEFT JOIN best ON best.c = k.c LEFT JOIN m ON m.c = k.c)
    SELECT c AS column_name, p IS NOT NULL OR q IS NOT NULL AS is_pii,
    CASE WHEN p IS NOT NULL AND p >= coalesce(q, 0) THEN pii_type WHEN q IS NOT NULL THEN 'email' END AS pii_type,
    round(CASE WHEN p IS NOT NULL AND q IS NOT NULL THEN greatest(p, q) WHEN p IS NOT NULL THEN greatest(p - 0.15, 0.0) ELSE coalesce(q, 0.0) END, 4)::double AS confidence,
    concat_ws(',', CASE WHEN p IS NOT NULL THEN 'patterns' END, CASE WHEN q IS NOT NULL THEN 'mail' END) AS detectors FROM j""",
)
def detect_with_plugins(t):
    """The pattern rules and a detector that was plugged in, merged by one rule."""
    cells = detect.long_form(frame(t, "persons"), "persons", F.col("customer_id"), _DETECTED)
    found = detect.detect_with(cells, ["patterns", "mail"])
    return found.select("column_name", "is_pii", "pii_type", F.round("confidence", 4).alias("confidence"), "detectors")


@query(
    "detect_sampled",
    cte("persons")
    + f""", s AS (SELECT *, row_number() OVER (ORDER BY {s52("sha256('7|' || customer_id::varchar)")}, customer_id) AS rn
          FROM persons ORDER BY rn LIMIT 20),
    cells AS (SELECT * FROM ({_cells("s", "rn", ID_COLUMNS)}) WHERE pos <= 10){_VERDICT}
    SELECT k.c AS column_name, best.c IS NOT NULL AS is_pii, pii_type, round(coalesce(conf, 0.0::double), 4) AS confidence,
    {_TECH} AS technique, coalesce(n, 0)::bigint AS matches
    FROM (SELECT DISTINCT c FROM cells) k LEFT JOIN best ON k.c = best.c""",
)
def detect_sampled(t):
    """The sampling detector: 20 random rows, of which the first 10 values of a column count."""
    persons = frame(t, "persons")
    sample = random_sample(persons, 20, seed=7, key=["customer_id"])
    draw = s_draw("7", "customer_id")
    ranked = sample.withColumn("draw", draw)
    cells = detect.first_values(detect.long_form(ranked, "persons", F.col("draw"), ID_COLUMNS), 10)
    return detect.column_verdicts(cells).select(
        "column_name", "is_pii", "pii_type", F.round("confidence", 4).alias("confidence"), "technique", "matches"
    )


def s_draw(seed: str, key: str):
    from ..functions.digests import digest52

    return digest52(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))


@query(
    "random_sample",
    f"""SELECT doc_id, lang, source FROM documents
    ORDER BY {s52("sha256('11|' || doc_id::varchar)")}, doc_id LIMIT 20""",
)
def random_sample_rows(t):
    """Twenty random rows of a table (the sample size of the profiler), repeatable on any cluster."""
    return random_sample(t.documents.select("doc_id", "lang", "source"), 20, seed=11, key=["doc_id"])


@query("head_sample", "SELECT url FROM pages ORDER BY page_id LIMIT 10")
def head_sample_values(t):
    return head_sample(t.pages, "url", 10, ["page_id"])




@query(
    "merge_detections",
    cte("fields")
    + """, e AS (SELECT table_name, column_name, is_pii, pii_type, confidence, technique FROM fields WHERE NOT is_pk),
    r AS (SELECT table_name, column_name, seq % 2 = 0 AS is_pii, CASE WHEN seq % 2 = 0 THEN 'pan' END AS pii_type,
          CASE WHEN seq % 2 = 0 THEN (seq % 100)::double / 100 ELSE 0.0 END AS confidence,
          CASE WHEN seq % 2 = 0 THEN 'masking' END AS technique FROM fields WHERE fk_table IS NULL),
    j AS (SELECT coalesce(e.table_name, r.table_name) AS table_name, coalesce(e.column_name, r.column_name) AS column_name,
          coalesce(e.is_pii, false) AS ep, coalesce(r.is_pii, false) AS rp, e.pii_type AS et, r.pii_type AS rt,
          coalesce(e.confidence, 0.0::double) AS ec, coalesce(r.confidence, 0.0::double) AS rc, e.technique AS eq, r.technique AS rq
          FROM e FULL OUTER JOIN r ON e.table_name = r.table_name AND e.column_name = r.column_name)
    SELECT table_name, column_name, ep OR rp AS is_pii,
    CASE WHEN ep AND rp THEN coalesce(et, rt) WHEN ep THEN et WHEN rp THEN rt END AS pii_type,
    round(CASE WHEN ep AND rp THEN least(0.99::double, greatest(ec, rc) + 0.05::double) WHEN ep THEN ec
         WHEN rp THEN greatest(0.0::double, rc - 0.15::double) ELSE 0.0::double END, 4) AS confidence,
    CASE WHEN ep AND rp THEN coalesce(eq, rq) WHEN ep THEN eq WHEN rp THEN rq ELSE 'no_change' END AS technique,
    CASE WHEN ep AND rp THEN 'combined' WHEN ep THEN 'external' WHEN rp THEN 'regex' ELSE 'combined' END AS method
    FROM j""",
)
def merge_detections(t):
    """External answers against pattern answers, by column."""
    fields = frame(t, "fields")
    external = fields.filter("not is_pk").select("table_name", "column_name", "is_pii", "pii_type", "confidence", "technique")
    hit = F.col("seq") % 2 == 0
    regex = fields.filter("fk_table is null").select(
        "table_name",
        "column_name",
        hit.alias("is_pii"),
        F.when(hit, "pan").alias("pii_type"),
        F.when(hit, (F.col("seq") % 100).cast("double") / 100).otherwise(0.0).alias("confidence"),
        F.when(hit, "masking").alias("technique"),
    )
    return detect.merge_detections(external, regex).withColumn("confidence", F.round("confidence", 4))


@query(
    "missing_answers",
    cte("fields")
    + """, e AS (SELECT * FROM fields WHERE confidence IS NOT NULL)
    SELECT f.table_name, f.column_name,
    CASE WHEN e.column_name IS NULL THEN true ELSE e.is_pii END AS is_pii,
    CASE WHEN e.column_name IS NULL THEN 'unknown' ELSE e.pii_type END AS pii_type,
    CASE WHEN e.column_name IS NULL THEN 0.0 ELSE e.confidence END AS confidence,
    CASE WHEN e.column_name IS NULL THEN 'tokenization' ELSE e.technique END AS technique
    FROM fields f LEFT JOIN e ON f.table_name = e.table_name AND f.column_name = e.column_name""",
)
def missing_answers(t):
    """Columns the external classifier did not answer for are treated as personal."""
    fields = frame(t, "fields")
    answered = fields.filter("confidence is not null").select(
        "table_name", "column_name", "is_pii", "pii_type", "confidence", "technique"
    )
    return detect.fill_missing_answers(fields, answered)


@query(
    "safety_net",
    cte("fields")
    + f""", x AS (SELECT *, NOT is_pii AND {has_any("lower(column_name)", detect.SAFETY_NET_NAMES)} AS caught FROM fields)
    SELECT policy_id, table_name, column_name, is_pii OR caught AS is_pii,
    CASE WHEN caught THEN upper(column_name) ELSE pii_type END AS pii_type,
    CASE WHEN caught THEN 0.9 ELSE confidence END AS confidence,
    CASE WHEN caught THEN 'MASKING' ELSE technique END AS technique FROM x""",
)
def safety_net(t):
    fields = frame(t, "fields").select(
        "policy_id", "table_name", "column_name", "is_pii", "pii_type", "confidence", "technique"
    )
    return detect.safety_net(fields)


def _hits(text: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{p}' AS pattern, count(*) FILTER (WHERE n > 0)::bigint AS row_count, coalesce(sum(n), 0)::bigint AS hits "
        f"FROM (SELECT len(regexp_extract_all({text}, {q(rx)})) AS n FROM src)"
        for p, rx in LEAK_PATTERNS.items()
    )


def _text_scan(table: str, text: str) -> str:
    return f"WITH src AS (SELECT {text} FROM {table}) SELECT '{table}' AS table_name, * FROM ({_hits(text)})"


@query("scan_documents", _text_scan("documents", "text"))
def scan_documents(t):
    """Seven leak patterns over whole documents: rows and occurrences."""
    return leaks.scan_text(t.spread("documents"), "documents", "text")


@query("scan_pages", _text_scan("pages", "html"))
def scan_pages(t):
    return leaks.scan_text(t.spread("pages"), "pages", "html")


@query("scan_conversations", _text_scan("conversations", "text"))
def scan_conversations(t):
    return leaks.scan_text(t.spread("conversations"), "conversations", "text")


@query(
    "scan_by_source",
    "SELECT 'documents' AS table_name, * FROM ("
    + " UNION ALL ".join(
        f"SELECT source AS grp, '{p}' AS pattern, count(*) FILTER (WHERE n > 0)::bigint AS row_count, coalesce(sum(n), 0)::bigint AS hits "
        f"FROM (SELECT source, len(regexp_extract_all(text, {q(rx)})) AS n FROM documents) GROUP BY source"
        for p, rx in LEAK_PATTERNS.items()
    )
    + ")",
)
def scan_by_source(t):
    return leaks.scan_text(t.spread("documents"), "documents", "text", group="source")


_SCANNED = ("aadhaar_no", "pan_no", "phone", "gstin", "credit_card", "email", "account_no", "balance")
_SCAN_TECH = {"pan_no": "HASHING", "phone": "MASKING", "gstin": "REDACTION", "email": "TOKENIZATION"}


@query(
    "scan_columns",
    cte("persons")
    + " UNION ALL ".join(
        f"SELECT 'persons' AS table_name, '{c}' AS column_name, '{_SCAN_TECH.get(c, 'NO_CHANGE')}' AS technique, '{p}' AS pattern, "
        f"count(*) FILTER (WHERE regexp_matches({c}::varchar, {q(rx)}))::bigint AS matches FROM persons"
        for c in _SCANNED
        if _SCAN_TECH.get(c) not in leaks.SKIPPED_TECHNIQUES
        for p, rx in LEAK_PATTERNS.items()
    ),
)
def scan_columns(t):
    """Columns x patterns in one aggregate; tokenized and masked columns are skipped."""
    return leaks.scan_columns(frame(t, "persons"), "persons", _SCANNED, _SCAN_TECH)


_DRAFT = {
    "customer": (("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), "c_custkey"),
    "supplier": (("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), "s_suppkey"),
}


@query(
    "draft_policy",
    "WITH cells AS ("
    + " UNION ALL ".join(
        f"SELECT '{tb}.{c}' AS c, {key} AS pos, {c}::varchar AS v FROM {tb}" for tb, (cols, key) in _DRAFT.items() for c in cols
    )
    + f"""){_VERDICT},
    k AS (SELECT DISTINCT split_part(c, '.', 1) AS table_name, split_part(c, '.', 2) AS column_name, c FROM cells),
    d AS (SELECT k.table_name, k.column_name, best.pii_type, coalesce(best.conf, 0.0) AS conf,
          best.c IS NULL AND {has_any("lower(k.column_name)", detect.SAFETY_NET_NAMES)} AS caught FROM k LEFT JOIN best ON best.c = k.c)
    SELECT table_name, column_name, pii_type IS NOT NULL OR caught AS is_pii,
    CASE WHEN caught THEN upper(column_name) WHEN pii_type IS NULL THEN 'NON_PII' ELSE upper(pii_type) END AS pii_type,
    CASE WHEN caught THEN 'TOKENIZATION' WHEN pii_type IS NULL THEN 'NO_CHANGE' ELSE 'OTHER' END AS technique
    FROM d""",
)
def draft_policy_query(t):
    """From whole tables to a proposed policy: verdicts, safety net, types, techniques."""
    from ..sources.catalog import catalog, columns_of, declared_keys

    tables = {"customer": t.customer, "supplier": t.supplier}
    keys = declared_keys(t.spark, [("customer", "c_custkey", True, None, None, True)])
    positions = {"customer": "c_custkey", "supplier": "s_suppkey"}
    drafted = draft_policy(tables, catalog(columns_of(t.spark, tables), keys), positions)
    return drafted.select("table_name", "column_name", "is_pii", "pii_type", "technique")
