"""Audit trail, run history, validation and reports."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..operators import leaks, search, stats
from ..operators.apply import apply_policy
from ..operators.ordered import even_buckets
from ..plans import audit, risk, validate
from ..plans.reports import compliance_report
from ..sources import sinks
from .derived import cte, frame
from .policy_queries import _EXPOSED
from .registry import SECRET, SETTINGS, q, query
from .scalar_queries import rule


def _pads() -> tuple[str, str]:
    raw = SECRET.encode().ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in raw).hex(), bytes(b ^ 0x5C for b in raw).hex()


def hmac_sql(text: str) -> str:
    inner, outer = _pads()
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({text}))))"


_SIGNED = "timestamp || ':' || user_id || ':' || run_id || ':' || action || ':' || coalesce(details, 'None')"

@query("audit_sign", cte("audit") + f"SELECT id, {hmac_sql(_SIGNED)} AS audit_hash FROM audit")
def audit_sign(t):
    return audit.sign(frame(t, "audit"), SECRET).select("id", "audit_hash")


@query("audit_verify", cte("audit") + "SELECT id, action FROM audit WHERE level = 'error'")
def audit_verify(t):
    """Entries altered after signing are found by their signature."""
    signed = audit.sign(frame(t, "audit"), SECRET)
    altered = signed.withColumn(
        "details", F.when(F.col("level") == "error", F.concat("details", F.lit("!"))).otherwise(F.col("details"))
    )
    return audit.tampered(altered, SECRET).select("id", "action")


@query(
    "audit_search",
    cte("audit")
    + """SELECT id, timestamp, user_id, level FROM audit WHERE user_id = 'user_42'
    AND (contains(lower(category), 'policy') OR contains(lower(concat_ws(' ', action, step_name, details)), 'policy'))
    AND contains(level, 'err') AND contains(lower(concat_ws(' ', action, details, step_name, run_id)), 'run-42')""",
)
def audit_search(t):
    """Audit rows by user, category, level and free text, newest first."""
    rows = search.search_logs(frame(t, "audit"), user="USER_42", category="policy", level="ERR", search="Run-42")
    return rows.select("id", "timestamp", "user_id", "level")


@query(
    "audit_run",
    cte("audit") + "SELECT id, timestamp, action FROM audit WHERE run_id = 'RUN-7' AND level = 'warning'",
)
def audit_run(t):
    return search.search_logs(frame(t, "audit"), run_id="RUN-7", level="warning").select("id", "timestamp", "action")


@query(
    "audit_elapsed",
    cte("audit")
    + """, e AS (SELECT id, epoch_us(timestamp::timestamp) - epoch_us(min(timestamp) OVER (PARTITION BY run_id)::timestamp) AS us FROM audit)
    SELECT id, us // 1000 AS elapsed_ms, CASE WHEN us // 1000 < 1000 THEN '+' || (us // 1000)::varchar || 'ms'
      ELSE '+' || ((us + 5000) // 1000000)::varchar || '.' || lpad(((us + 5000) // 10000 % 100)::varchar, 2, '0') || 's' END AS elapsed_text FROM e""",
)
def audit_elapsed(t):
    """Time since the start of the run."""
    return audit.elapsed(frame(t, "audit")).select("id", "elapsed_ms", "elapsed_text")


@query(
    "audit_dedupe",
    cte("audit")
    + """SELECT id, run_id, action FROM (SELECT *, lag(action) OVER (PARTITION BY run_id ORDER BY seq) AS p,
      row_number() OVER (PARTITION BY run_id ORDER BY seq) AS rn FROM audit) WHERE rn = 1 OR p IS DISTINCT FROM action""",
)
def audit_dedupe(t):
    """Entries that do not repeat the message before them in their run."""
    logs = frame(t, "audit")
    bucket = even_buckets(logs, F.col("seq"), rows_per_bucket=100_000)
    kept = audit.drop_repeats(logs, "action", ["run_id"], ["seq"], bucket)
    return kept.select("id", "run_id", "action")


@query(
    "audit_export",
    cte("audit")
    + f"""SELECT id AS "ID", timestamp AS "Timestamp", user_id AS "User ID", run_id AS "Run ID", step_index AS "Step Index", step_name AS "Step Name",
    category AS "Category", level AS "Level", action AS "Action", details AS "Details", {hmac_sql(_SIGNED)} AS "HMAC Hash" FROM audit""",
)
def audit_export(t):
    return sinks.audit_export(audit.sign(frame(t, "audit"), SECRET))


_VERSIONS = """, v AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp, run_id) AS version_no,
   count(*) OVER (PARTITION BY user_id) AS n FROM runs)
"""


@query(
    "run_versions",
    cte("runs")
    + _VERSIONS
    + """SELECT user_id, run_id, version_no, version_no = n AS is_current,
    'v' || version_no::varchar || CASE WHEN version_no = n THEN ' (Current Active)' ELSE ' (Previous History)' END AS version_label,
    CASE WHEN version_no = n THEN 'active_current' ELSE 'history_previous_version' END AS status FROM v""",
)
def run_versions(t):
    """Version numbers of every user's runs; the newest is current."""
    done = audit.run_versions(frame(t, "runs"))
    return done.select("user_id", "run_id", "version_no", "is_current", "version_label", "status")


@query(
    "run_upsert",
    cte("runs")
    + """, n AS (SELECT user_id, run_id, '2030-01-01' AS timestamp, table_name, 1 AS records FROM runs WHERE risk_score > 60)
    SELECT user_id, run_id, timestamp, table_name, records FROM n
    UNION ALL SELECT user_id, run_id, timestamp, table_name, records FROM runs WHERE NOT risk_score > 60""",
)
def run_upsert(t):
    """A recorded run replaces the earlier record of its id."""
    runs = frame(t, "runs")
    newer = runs.filter("risk_score > 60").withColumns({"timestamp": F.lit("2030-01-01"), "records": F.lit(1).cast("long")})
    done = audit.upsert_runs(runs, newer)
    return done.select("user_id", "run_id", "timestamp", "table_name", "records")


@query(
    "records_total",
    cte("runs")
    + _VERSIONS
    + """SELECT user_id, CASE WHEN sum(records) FILTER (WHERE version_no >= n - 1) = 0 THEN arg_max(records, version_no)
      ELSE sum(records) FILTER (WHERE version_no >= n - 1) END::bigint AS records FROM v GROUP BY user_id""",
)
def records_total(t):
    """Records of the current runs of each user (here the last two count as current)."""
    versions = audit.run_versions(frame(t, "runs"), total="n")
    current = versions.withColumn("is_current", F.col("version_no") >= F.col("n") - 1)
    return audit.records_total(current, ["user_id"])


@query(
    "runs_recorded",
    cte("runs")
    + """, n AS (SELECT user_id, run_id, '2030-01-01' AS timestamp, 1 AS records FROM runs WHERE risk_score > 60),
    a AS (SELECT * FROM n UNION ALL SELECT user_id, run_id, timestamp, records FROM runs WHERE NOT risk_score > 60),
    v AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp, run_id) AS version_no, count(*) OVER (PARTITION BY user_id) AS k FROM a)
    SELECT user_id, run_id, records, version_no, version_no = k AS is_current,
    CASE WHEN version_no = k THEN 'active_current' ELSE 'history_previous_version' END AS status FROM v""",
)
def runs_recorded(t):
    """Recording runs again: they move to the end, the newest of each user is current, the others are demoted."""
    runs = frame(t, "runs")
    new = runs.filter("risk_score > 60").withColumns({"timestamp": F.lit("2030-01-01"), "records": F.lit(1).cast(runs.schema["records"].dataType)})
    return audit.record_runs(runs, new).select("user_id", "run_id", "records", "version_no", "is_current", "status")


@query(
    "mean_scores",
    cte("runs")
    + "SELECT table_name, round_even(avg(privacy_score), 1) AS privacy_score, round_even(avg(risk_score), 1) AS risk_score FROM runs GROUP BY table_name",
)
def mean_scores(t):
    return stats.mean_scores(frame(t, "runs"), ["table_name"])


@query(
    "kpis",
    cte("runs", "audit", "fields")
    + _EXPOSED.format(by="policy_id")
    + """, r AS (SELECT user_id, CASE WHEN sum(records) FILTER (WHERE rn = 1) = 0 THEN arg_max(records, -rn) ELSE sum(records) FILTER (WHERE rn = 1) END::bigint AS records,
      count(*) AS runs FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, run_id DESC) AS rn FROM runs) GROUP BY user_id),
    l AS (SELECT split_part(user_id, '_', 2)::bigint AS user_id, count(*) AS audit_events FROM audit GROUP BY 1),
    u AS (SELECT user_id FROM r UNION SELECT user_id FROM l UNION SELECT policy_id FROM pts)
    SELECT u.user_id, coalesce(records, 0) AS records, coalesce(runs, 0) AS runs,
    CASE WHEN runs IS NULL THEN 0.0::double ELSE 100.0::double - coalesce(risk_score, 0.0::double) END AS privacy_score,
    CASE WHEN runs IS NULL THEN 0.0::double ELSE coalesce(risk_score, 0.0::double) END AS risk_score,
    CASE WHEN runs IS NULL THEN 'NOT_EVALUATED' WHEN coalesce(risk_score, 0) = 0 THEN 'LOW' WHEN risk_score < 50 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level,
    CASE WHEN runs IS NULL THEN 'DATABASE CONNECTED (PIPELINE NOT STARTED)'
      WHEN 100.0 - coalesce(risk_score, 0) >= 80 THEN 'PRIVACY PROTECTED (PASS)' ELSE 'ACTION REQUIRED (UNPROTECTED PII)' END AS compliance_status,
    coalesce(audit_events, 0) AS audit_events
    FROM u LEFT JOIN r ON r.user_id = u.user_id LEFT JOIN pts ON pts.policy_id = u.user_id LEFT JOIN l ON l.user_id = u.user_id WHERE u.user_id IS NOT NULL""",
)
def kpis(t):
    """Dashboard row per user of runs, audit entries or policies; users without a run are not evaluated."""
    runs = audit.run_versions(frame(t, "runs"))
    logs = frame(t, "audit").withColumn("user_id", F.split("user_id", "_")[1].cast("long"))
    snapshots = frame(t, "fields").withColumn("user_id", F.col("policy_id"))
    return audit.kpis(runs, logs, snapshots)


@query(
    "global_kpis",
    cte("fields", "audit")
    + _EXPOSED.format(by="policy_id")
    + """, p AS (SELECT pts.policy_id, risk_score, 100.0 - risk_score AS privacy_score, c.n FROM pts JOIN (SELECT policy_id, count(*) AS n FROM fields GROUP BY policy_id) c
      ON c.policy_id = pts.policy_id),
    m AS (SELECT sum(n)::bigint AS records, count(*) AS runs, round_even(avg(privacy_score), 1) AS privacy_score, round_even(avg(risk_score), 1) AS risk_score FROM p)
    SELECT *, CASE WHEN risk_score <= 20 THEN 'LOW' WHEN risk_score <= 50 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level,
    CASE WHEN privacy_score >= 80 THEN 'ENTERPRISE COMPLIANT (PASS)' ELSE 'ACTION REQUIRED (UNPROTECTED PII)' END AS compliance_status,
    (SELECT count(*) FROM audit) AS audit_events FROM m""",
)
def global_kpis(t):
    """The same over all tenants."""
    fields = frame(t, "fields")
    scored = risk.policy_risk(fields, ["policy_id"])
    records = fields.groupBy("policy_id").agg(F.count(F.lit(1)).alias("records"))
    events = frame(t, "audit").agg(F.count(F.lit(1)).alias("n")).scalar()
    return audit.global_kpis(scored.join(records, "policy_id"), events)


def _metrics(where: str) -> str:
    return f"""SELECT {where} AS table_name, count(*) FILTER (WHERE kind = 'batch') AS batches, coalesce(sum(rows) FILTER (WHERE kind = 'batch'), 0)::bigint AS total_rows,
    round(coalesce(sum(seconds) FILTER (WHERE kind = 'batch'), 0), 4) AS total_seconds, round(coalesce(avg(seconds) FILTER (WHERE kind = 'batch'), 0), 6) AS avg_seconds,
    round(coalesce(sum(rows) FILTER (WHERE kind = 'batch') / nullif(sum(seconds) FILTER (WHERE kind = 'batch'), 0), 0), 4) AS avg_throughput,
    round(coalesce(max(rows / seconds) FILTER (WHERE kind = 'batch' AND seconds > 0), 0), 4) AS peak_throughput,
    count(*) FILTER (WHERE kind = 'deadlock') AS deadlocks, count(*) FILTER (WHERE kind = 'readonly') AS readonly_events,
    round(coalesce(sum(seconds) FILTER (WHERE kind = 'readonly'), 0), 4) AS readonly_seconds,
    round(coalesce(avg(seconds) FILTER (WHERE kind = 'readonly'), 0), 6) AS avg_readonly_seconds,
    count(*) FILTER (WHERE kind = 'resume') AS resumes FROM batches"""


@query(
    "batch_metrics",
    cte("batches") + _metrics("table_name") + " GROUP BY table_name UNION ALL " + _metrics("NULL"),
)
def batch_metrics(t):
    """Throughput and events of a batch log, per table and in total."""
    done = stats.batch_metrics(frame(t, "batches"))
    digits = {
        "total_seconds": 4, "avg_seconds": 6, "avg_throughput": 4, "peak_throughput": 4, "readonly_seconds": 4,
        "avg_readonly_seconds": 6,
    }
    return done.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query(
    "conformance",
    cte("persons")
    + """SELECT count(*) AS row_count, count(*) FILTER (WHERE NOT regexp_full_match(pincode, '\\d{6}')) AS bad_pincode,
    count(*) FILTER (WHERE NOT starts_with(phone, '+91')) AS bad_phone, count(*) FILTER (WHERE NOT contains(email, '@')) AS bad_email FROM persons""",
)
def conformance(t):
    """Rows that break the format rules of anonymized persons."""
    return audit.conformance(frame(t, "persons").drop("full_name"))


@query(
    "conformance_after",
    "SELECT count(*) AS row_count, 0::bigint AS bad_full_name, 0::bigint AS bad_pincode, 0::bigint AS bad_phone, 0::bigint AS bad_email FROM customer",
)
def conformance_after(t):
    """Anonymized persons conform: names fit, pin codes, phones and e-mails have their form."""
    persons = frame(t, "persons").select(
        "customer_id", "full_name", F.col("full_name").alias("first_name"), F.col("full_name").alias("last_name"),
        "pincode", "phone", "email",
    )
    names = ("full_name", "first_name", "last_name", "pincode", "phone", "email")
    from ..functions.techniques import Settings

    settings = Settings(SECRET, row_names=True)
    done = apply_policy(persons, "persons", [rule("persons", n, "TOKENIZATION") for n in names], settings, ["customer_id"])
    return audit.conformance(done)


@query(
    "changed_values",
    "SELECT 'c_acctbal' AS column_name, 0::bigint AS changed UNION ALL SELECT 'c_mktsegment', 0::bigint UNION ALL SELECT 'c_name', count(*)::bigint FROM customer",
)
def changed_values(t):
    """Columns without a rule keep their values, the masked one does not."""
    done = apply_policy(t.spread("customer"), "customer", [rule("customer", "c_name", "MASKING")], SETTINGS)
    return audit.changed_values(t.customer, done, "c_custkey", ["c_acctbal", "c_mktsegment", "c_name"])


@query(
    "row_count_check",
    """SELECT 'orders' AS table_name, 'ROW_COUNT_MISMATCH' AS code, (SELECT count(*) FROM orders) - (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS matches""",
)
def row_count_check(t):
    """A copy that lost rows is found; the complete one is not reported."""
    source = {"orders": t.orders, "customer": t.customer}
    target = {"orders": t.orders.filter("o_orderstatus <> 'P'"), "customer": t.customer}
    return validate.row_count_findings(validate.table_counts(source, target)).select("table_name", "code", "matches")


@query(
    "schema_check",
    cte("fields")
    + """SELECT table_name, column_name, CASE WHEN policy_id % 7 = 3 THEN 'COLUMN_MISSING' ELSE 'TYPE_MISMATCH' END AS code FROM fields
    WHERE policy_id % 7 = 3 OR (CASE WHEN technique = 'NO_CHANGE' THEN data_type WHEN technique = 'DIFFERENTIAL_PRIVACY' AND data_type <> 'date' THEN 'double'
      WHEN technique = 'DIFFERENTIAL_PRIVACY' THEN data_type ELSE 'string' END) <> data_type""",
)
def schema_check(t):
    """Expected types (source type through its technique) against the actual ones."""
    fields = frame(t, "fields")
    actual = fields.filter(F.col("policy_id") % 7 != 3)
    return validate.schema_findings(fields, fields, actual).select("table_name", "column_name", "code")


@query(
    "exposure_check",
    cte("persons")
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c})::bigint AS matches FROM persons" for c in ("aadhaar_no", "phone")
    ),
)
def exposure_check(t):
    """Personal columns copied as they are, with the number of exposed values."""
    rules = [
        ("persons", "aadhaar_no", "NO_CHANGE", "AADHAAR", True), ("persons", "phone", "NO_CHANGE", "PHONE", True),
        ("persons", "email", "MASKING", "EMAIL", True), ("persons", "city", "NO_CHANGE", "NON_PII", True),
        ("persons", "ref", "NO_CHANGE", "OTHER", False),
    ]
    pol = t.spark.createDataFrame(rules, "table_name string, column_name string, technique string, pii_type string, is_pii boolean")
    persons = frame(t, "persons")
    counts = leaks.non_null_counts(persons, "persons", persons.columns)
    return validate.exposure_findings(pol, counts).select("column_name", "matches")


@query(
    "exploit_check",
    cte("fields")
    + """SELECT table_name, column_name FROM fields WHERE technique = 'NO_CHANGE' AND (is_pii OR upper(coalesce(pii_type, 'NONE')) NOT IN ('NON_PII', 'NONE', 'NULL'))""",
)
def exploit_check(t):
    return validate.exploit_findings(frame(t, "fields")).select("table_name", "column_name")


@query(
    "exploit_check_parity",
    cte("fields")
    + "SELECT table_name, column_name FROM fields WHERE technique = 'NO_CHANGE' AND (is_pii OR pii_type IS NULL OR pii_type <> 'NONE')",
)
def exploit_check_parity(t):
    """The literal rule, which also flags columns typed NON_PII."""
    return validate.exploit_findings(frame(t, "fields"), strict_parity=True).select("table_name", "column_name")


# --- validation of a text corpus: every source is a table ------------------------------------

_BY_LANG = {"en": "NO_CHANGE", "fr": "HASHING"}
_TECH = "CASE lang WHEN 'en' THEN 'NO_CHANGE' WHEN 'fr' THEN 'HASHING' ELSE 'REDACTION' END"


def _lang_findings(t):
    """Findings of the leak scan over whole documents, one column per language."""
    technique = F.when(F.col("grp") == "en", "NO_CHANGE").when(F.col("grp") == "fr", "HASHING").otherwise("REDACTION")
    scanned = leaks.scan_text(t.spread("documents"), "documents", "text", group="lang")
    scan = scanned.select(
        F.col("grp").alias("table_name"), F.lit("text").alias("column_name"), technique.alias("technique"), "pattern",
        F.col("row_count").alias("matches"),
    )
    return validate.leak_findings(scan)


def _scan_sql() -> str:
    return "scan AS (" + " UNION ALL ".join(
        f"SELECT lang, {q(p)} AS pattern, count(*) FILTER (WHERE regexp_matches(text, {q(rx)}))::bigint AS matches FROM documents GROUP BY lang"
        for p, rx in leaks.LEAK_PATTERNS.items()
    ) + f"""), f AS (SELECT lang AS table_name, pattern, matches, {_TECH} AS technique,
    CASE lang WHEN 'en' THEN 'CRITICAL' WHEN 'fr' THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
    CASE lang WHEN 'en' THEN 'FAIL' ELSE 'WARNING' END AS status FROM scan WHERE matches > 0)"""


@query(
    "leak_findings",
    f"WITH {_scan_sql()} "
    + """SELECT table_name, 'REGEX_' || pattern || '_LEAK' AS code, severity, status, matches,
    'Detected ' || matches::varchar || ' raw ' || pattern || ' pattern matches in ''' || table_name || '.text'' (Technique: ' || technique || ').' AS message FROM f""",
)
def leak_findings(t):
    return _lang_findings(t).select("table_name", "code", "severity", "status", "matches", "message")


_RESULTS = """, tabs AS (SELECT DISTINCT lang AS table_name FROM documents),
 res AS (SELECT t.table_name, coalesce(max(CASE status WHEN 'FAIL' THEN 2 WHEN 'WARNING' THEN 1 END), 0) AS rk, count(f.status) AS findings
   FROM tabs t LEFT JOIN f ON f.table_name = t.table_name GROUP BY t.table_name),
 sc AS (SELECT res.table_name, rk, findings, least(greatest(CASE rk WHEN 2 THEN 25 WHEN 1 THEN 10 ELSE 0 END + coalesce(sv, 0), 1.5), 100.0)::double AS risk
   FROM res LEFT JOIN (SELECT table_name, sum(CASE severity WHEN 'CRITICAL' THEN 15 WHEN 'HIGH' THEN 8 WHEN 'MEDIUM' THEN 3 ELSE 1 END) AS sv FROM f GROUP BY table_name) s
   ON s.table_name = res.table_name)
"""


def _lang_results(t, findings):
    tables = t.documents.select(F.col("lang").alias("table_name")).distinct().withColumn("validator", F.lit("leak_scan"))
    return validate.validator_results(tables, findings, ["table_name"])


@query(
    "validation_rollup",
    f"WITH {_scan_sql()}{_RESULTS}"
    + """SELECT table_name, CASE rk WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARNING' ELSE 'PASS' END AS status, 1::bigint AS rules_checked,
    (rk = 0)::bigint AS rules_passed, greatest(round_even(100.0 - risk, 0), 0)::int AS privacy_score, risk AS risk_score FROM sc""",
)
def validation_rollup(t):
    """Status and scores per language of the corpus, from the findings of the leak scan."""
    findings = _lang_findings(t)
    results = _lang_results(t, findings)
    status = validate.overall_status(results, ["table_name"])
    return status.join(validate.scores(results, findings, ["table_name"]), "table_name")


@query(
    "validation_totals",
    f"WITH {_scan_sql()}{_RESULTS}"
    + """SELECT (SELECT coalesce(sum(matches), 0)::bigint FROM f) AS leak_count, 0::bigint AS successful_exploits, (SELECT count(*) FROM f) AS findings,
    count(*) AS rules_checked, count(*) FILTER (WHERE rk = 0) AS rules_passed FROM res""",
)
def validation_totals(t):
    findings = _lang_findings(t)
    return validate.validation_totals(_lang_results(t, findings), findings)


@query(
    "validation_scan",
    r"""WITH c AS (SELECT count(*) AS n, count(text) AS k, count(source) AS s,
      count(*) FILTER (WHERE regexp_matches(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}')) AS mail FROM documents)
    SELECT 'documents' AS table_name, n AS rows_scanned, 2::bigint AS columns_scanned, (k + s)::bigint AS values_scanned, mail AS email_rows FROM c""",
)
def validation_scan(t):
    """What one pass over a written table counts for all its checks: rows, columns, values, and matches."""
    profile = leaks.profile_table(t.documents.select("text", "lang", "source"), "documents", {"lang": "MASKING"})
    mail = profile.filter("column_name = 'text' and pattern = 'EMAIL'").select("matches").scalar()
    return validate.scan_metrics(profile).select("table_name", "rows_scanned", "columns_scanned", "values_scanned", mail.alias("email_rows"))


@query(
    "validation_messages",
    f"WITH {_scan_sql()} "
    + """SELECT CASE WHEN severity IN ('HIGH', 'CRITICAL') THEN 'error' ELSE 'warning' END AS kind,
    '[REGEX_' || pattern || '_LEAK] ' || severity || ': Detected ' || matches::varchar || ' raw ' || pattern || ' pattern matches in ''' || table_name || '.text'' (Technique: ' || technique || ').' AS line FROM f""",
)
def validation_messages(t):
    return validate.split_messages(_lang_findings(t))


def _table_reports(t):
    findings = _lang_findings(t)
    results = _lang_results(t, findings)
    scored = validate.scores(results, findings, ["table_name"])
    rows = t.documents.groupBy(F.col("lang").alias("table_name")).agg(F.count(F.lit(1)).alias("rows"))
    joined = results.join(scored, "table_name").join(rows, "table_name")
    return joined.select(
        "table_name", F.lit(True).alias("row_counts_match"), (F.col("status") != "FAIL").alias("checks_passed"), "risk_score", "rows"
    )


@query(
    "certificate",
    f"WITH {_scan_sql()}{_RESULTS}"
    + """SELECT round_even(avg(risk), 2) AS overall_risk_score,
    CASE WHEN bool_or(rk = 2 OR risk >= 70) THEN 'REJECTED / EXPOSURES DETECTED [FAIL]' ELSE 'APPROVED / SECURE [PASS]' END AS certification_status,
    count(*) AS tables_processed FROM sc""",
)
def certificate(t):
    """Certificate over the table reports of the corpus."""
    return validate.certify(_table_reports(t))


@query(
    "report_values",
    f"WITH {_scan_sql()}{_RESULTS}"
    + """, c AS (SELECT round_even(avg(risk), 2) AS r, CASE WHEN bool_or(rk = 2 OR risk >= 70) THEN 'REJECTED / EXPOSURES DETECTED [FAIL]' ELSE 'APPROVED / SECURE [PASS]' END AS s,
      count(*) AS n FROM sc)
    SELECT 'compliance_law' AS "Metric", 'DPDP Act 2023' AS "Value" UNION ALL SELECT 'certification_status', s FROM c
    UNION ALL SELECT 'tables_processed_count', n::varchar FROM c UNION ALL SELECT 'total_rows_anonymized', '0'""",
)
def report_values(t):
    """The scalar fields of the report as metric and value."""
    report = compliance_report(_table_reports(t), {}, "Admin", "DPDP Act 2023")
    flat = report.select(
        "compliance_metadata.compliance_law", "compliance_metadata.certification_status",
        "execution_summary.tables_processed_count", "execution_summary.total_rows_anonymized", "table_compliance_details",
    )
    return sinks.key_values(flat)


