"""Validation of a clean and of a leaky run, reports, audit trail."""

import json

import pytest
from pyspark.sql import functions as F

from veilwork.functions.techniques import Settings
from veilwork.operators import search, stats
from veilwork.plans import audit, reports, run, validate
from veilwork.sources import sinks
from veilwork.sources.catalog import catalog, columns_of, declared_keys

SETTINGS = Settings("unit-secret")
POLICY = (
    "table_name string, column_name string, technique string, pii_type string, is_pii boolean, is_pk boolean, fk_table string, fk_column string"
)


@pytest.fixture(scope="module")
def customers(spark):
    rows = [
        (1, "Asha Rao", "1234 5678 9012", "asha@mail.test", "calm client"),
        (2, "Ravi Das", "2234 5678 9012", "ravi@mail.test", "gave id 4321 8765 2109"),
        (3, "Mina Jain", "3234 5678 9012", "mina@mail.test", None),
    ]
    return spark.createDataFrame(rows, "customer_id int, full_name string, aadhaar_no string, email string, comments string")


def policy(spark, leaky):
    keep = "NO_CHANGE"
    rows = [
        ("customers", "customer_id", "HASHING", "IDENTIFIER", True, True, None, None),
        ("customers", "full_name", keep if leaky else "TOKENIZATION", "NAME", True, False, None, None),
        ("customers", "aadhaar_no", "MASKING", "AADHAAR", True, False, None, None),
        ("customers", "email", "TOKENIZATION", "EMAIL", True, False, None, None),
        ("customers", "comments", keep if leaky else "MASKING", "QUASI_IDENTIFIER", True, False, None, None),
    ]
    return spark.createDataFrame(rows, POLICY)


def execute(spark, customers, tmp_path, leaky, status="APPROVED"):
    keys = declared_keys(spark, [("customers", "customer_id", True, None, None, True)])
    statuses = spark.createDataFrame([("p1", status)], "policy_id string, status string")
    return run.anonymize_tables(
        spark, {"customers": customers}, policy(spark, leaky), statuses, "p1", SETTINGS, str(tmp_path / "out"), keys
    )


def test_clean_run(spark, customers, tmp_path):
    result = execute(spark, customers, tmp_path, leaky=False)
    assert result.findings.count() == 0
    assert validate.overall_status(result.results).first()["status"] == "PASS"
    score = validate.scores(result.results, result.findings).first()
    assert (score["privacy_score"], score["risk_score"]) == (98, 1.5)
    written = spark.read.parquet(str(tmp_path / "out" / "customers.parquet"))
    assert written.count() == 3
    assert {f.dataType.simpleString() for f in written.schema.fields} == {"string"}


def test_leaky_run(spark, customers, tmp_path):
    result = execute(spark, customers, tmp_path, leaky=True)
    found = {(r["code"], r["column_name"]): r for r in result.findings.collect()}
    assert found["RAW_PII_UNANONYMIZED_EXPOSURE", "full_name"]["matches"] == 3
    assert found["RAW_PII_UNANONYMIZED_EXPOSURE", "comments"]["matches"] == 2
    leak = found["REGEX_AADHAAR_LEAK", "comments"]
    assert (leak["severity"], leak["status"], leak["matches"]) == ("CRITICAL", "FAIL", 1)
    assert validate.overall_status(result.results).first()["status"] == "FAIL"
    score = validate.scores(result.results, result.findings).first()
    assert (score["privacy_score"], score["risk_score"]) == (0, 100.0)
    totals = validate.validation_totals(result.results, result.findings).first()
    assert (totals["leak_count"], totals["successful_exploits"]) == (6, 2)


def test_gate_stops_before_writing(spark, customers, tmp_path):
    with pytest.raises(PermissionError):
        execute(spark, customers, tmp_path, leaky=False, status="DRAFT")
    assert not (tmp_path / "out").exists()


def _run(spark, customers, **more):
    cat = catalog(columns_of(spark, {"customers": customers}), declared_keys(spark, []))
    return validate.Run(spark, {"customers": customers}, {"customers": customers}, policy(spark, True), [], cat, cat, **more)


def test_a_failing_validator_does_not_stop_the_others(spark, customers):
    @validate.register_validator("broken")
    def broken(_):
        raise RuntimeError("boom")

    @validate.register_validator("broken_later")
    def broken_later(r):
        return validate.empty_findings(r.spark).withColumn("message", F.raise_error(F.lit("late"))).unionByName(
            r.spark.createDataFrame([(None,) * 9], validate.FINDING).withColumn("message", F.raise_error(F.lit("late")))
        )

    try:
        results, findings = validate.run_validators(_run(spark, customers, disabled=frozenset({"schema", "compliance"})))
    finally:
        validate._VALIDATORS.pop("broken")
        validate._VALIDATORS.pop("broken_later")
    status = {r["validator"]: r["status"] for r in results.collect()}
    assert status["broken"] == status["broken_later"] == "FAIL" and status["row_count"] == "PASS"
    assert "schema" not in status and "compliance" not in status
    assert findings.filter("code = 'VALIDATOR_ERROR' and severity = 'CRITICAL'").count() == 2


def test_row_count_schema_and_compliance_findings(spark, customers):
    lost = validate.table_counts({"t": customers, "u": customers}, {"t": customers.limit(1), "v": customers})
    got = {r["table_name"]: (r["status"], r["matches"]) for r in validate.row_count_findings(lost).collect()}
    assert got == {"t": ("FAIL", 2), "u": ("FAIL", 3), "v": ("FAIL", 3)}
    src = catalog(columns_of(spark, {"customers": customers}), declared_keys(spark, []))
    dst = catalog(columns_of(spark, {"customers": customers.drop("email").withColumn("new", F.lit(1))}), declared_keys(spark, []))
    codes = {r["column_name"]: r["code"] for r in validate.schema_findings(src, policy(spark, True), dst).collect()}
    assert codes == {"customer_id": "TYPE_MISMATCH", "email": "COLUMN_MISSING", "new": "COLUMN_UNEXPECTED"}
    assert validate.compliance_findings(spark, "APPROVED").count() == 0
    assert validate.compliance_findings(spark, "DRAFT").first()["status"] == "FAIL"


def test_linkage(spark):
    cat = spark.createDataFrame(
        [("a", "birth_date"), ("a", "zip"), ("a", "gender"), ("b", "dob"), ("b", "zip")], "table_name string, column_name string"
    )
    got = validate.linkage_findings(cat).collect()
    assert [(r["table_name"], r["severity"], r["status"]) for r in got] == [("a", "MEDIUM", "WARNING")]


def test_exploit_parity_switch(spark):
    pol = spark.createDataFrame([("t", "a", "NO_CHANGE", "NON_PII", False, False, None, None)], POLICY)
    assert validate.exploit_findings(pol).count() == 0
    assert validate.exploit_findings(pol, strict_parity=True).count() == 1


def test_report_and_certificate(spark, customers, tmp_path):
    reports_in = spark.createDataFrame(
        [("customers", True, True, 0.0, 5000)], "table_name string, row_counts_match boolean, checks_passed boolean, risk_score double, rows long"
    )
    stats_in = {"duration_seconds": 12.451, "total_rows": 5000, "start_time": "s", "end_time": "e"}
    report = reports.compliance_report(reports_in, stats_in, "Officer", "DPDP Act 2023")
    row = json.loads(report.toJSON().first())
    assert row["compliance_metadata"]["certification_status"].startswith("APPROVED")
    assert row["compliance_metadata"]["overall_privacy_risk_score"] == 0.0
    assert row["execution_summary"] == {
        "start_time": "s", "end_time": "e", "duration_seconds": 12.45, "tables_processed_count": 1, "total_rows_anonymized": 5000,
    }
    lines = reports.certificate_lines(report, policy(spark, False), validate.empty_findings(spark))
    reports.write_certificate(lines, str(tmp_path / "cert"))
    text = [r["value"] for r in spark.read.text(str(tmp_path / "cert")).collect()]
    assert text[1] == "DATA PRIVACY COMPLIANCE AUDIT REPORT" and "Rows Processed       : 5,000" in text
    assert any("email" in line and "TOKENIZATION" in line for line in text)
    bad = validate.certify(reports_in.withColumn("risk_score", F.lit(70.0))).first()
    assert bad["certification_status"].startswith("REJECTED")
    for form, first in {"csv": "Metric,Value", "sql": "-- overall_risk_score: 0.0", "txt": "overall_risk_score: 0.0"}.items():
        sinks.write_key_values(validate.certify(reports_in), str(tmp_path / form), form)
        assert spark.read.text(str(tmp_path / form)).first()[0] == first


def test_table_reports(spark, customers, tmp_path):
    result = execute(spark, customers, tmp_path, leaky=True)
    counts = validate.table_counts({"customers": customers}, {"customers": customers})
    row = run.table_reports(result.results, result.findings, counts).first()
    assert (row["row_counts_match"], row["checks_passed"], row["rows"]) == (True, False, 3)


LOG = "id string, timestamp string, user_id string, run_id string, step_index int, step_name string, category string, level string, action string, details string"


@pytest.fixture(scope="module")
def log(spark):
    rows = [
        (f"log_{i}", f"2024-01-01T00:00:{i:02d}.500000", "u1" if i % 2 else "U2", "R1", i, "Load", "pipeline", "info", f"act {i // 2}", None if i == 3 else "d")
        for i in range(8)
    ]
    return spark.createDataFrame(rows, LOG)


def test_audit_trail(spark, log, tmp_path):
    signed = audit.sign(log, "secret")
    assert audit.tampered(signed, "secret").count() == 0
    assert audit.tampered(signed, "other").count() == 8
    assert audit.tampered(signed.withColumn("details", F.lit("d")), "secret").count() == 1
    assert [r["id"] for r in search.search_logs(log, user="u2", level="INF", category="all").collect()] == ["log_6", "log_4", "log_2", "log_0"]
    assert search.search_logs(log, category="LOAD").count() == 8
    assert search.search_logs(log, run_id="nope").count() == 0
    kept = audit.drop_repeats(log, "action", ["run_id"], ["id"])
    assert {r["id"] for r in kept.collect()} == {"log_0", "log_2", "log_4", "log_6"}
    took = {r["id"]: (r["elapsed_ms"], r["elapsed_text"]) for r in audit.elapsed(log).collect()}
    assert took["log_0"] == (0, "+0ms") and took["log_5"] == (5000, "+5.00s")
    sinks.write_audit(signed, str(tmp_path / "csv"), "csv")
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns[-1] == "HMAC Hash"
    sinks.write_audit(signed, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 8


def test_run_history(spark):
    schema = "user_id string, run_id string, timestamp string, table_name string, records long"
    history = spark.createDataFrame([("u", f"r{i}", f"2024-01-0{i}", "t", i) for i in range(1, 5)], schema)
    new = spark.createDataFrame([("u", "r2", "2024-02-01", "t", 20)], schema)
    merged = audit.upsert_runs(history, new)
    got = {r["run_id"]: (r["version_no"], r["is_current"]) for r in audit.run_versions(merged).collect()}
    assert got == {"r1": (1, False), "r3": (2, False), "r4": (3, False), "r2": (4, True)}
    versions = audit.run_versions(merged)
    assert audit.records_total(versions).first()["records"] == 20
    assert audit.records_total(versions.withColumn("records", F.when(F.col("is_current"), 0).otherwise(F.col("records")))).first()["records"] == 0


def test_batch_metrics_golden(spark):
    log = spark.createDataFrame([("t", "batch", 1000, 0.1)] * 5 + [("t", "readonly", None, 2.0), (None, "deadlock", None, None)],
                                "table_name string, kind string, rows long, seconds double")
    total = [r for r in stats.batch_metrics(log).collect() if r["table_name"] is None][0]
    assert (total["batches"], total["total_rows"], round(total["avg_seconds"], 6), total["peak_throughput"]) == (5, 5000, 0.1, 10000.0)
    assert (total["readonly_events"], total["readonly_seconds"], total["deadlocks"]) == (1, 2.0, 1)


def test_conformance_and_changes(spark):
    df = spark.createDataFrame([("A", "B", "A B", "123456", "+91 9", "a@b"), ("A", "B", "B A", "12", "9", "ab")],
                               "first_name string, last_name string, full_name string, pincode string, phone string, email string")
    assert tuple(audit.conformance(df).first()) == (2, 1, 1, 1, 1)


def test_kpis_of_users_without_runs(spark):
    runs = spark.createDataFrame([("a", "r1", 5, 1, True)], "user_id string, run_id string, records long, timestamp int, is_current boolean")
    logs = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "user_id string")
    fields = "user_id string, table_name string, column_name string, technique string, pii_type string, is_pii boolean"
    got = {r["user_id"]: r for r in audit.kpis(runs, logs, spark.createDataFrame([], fields)).collect()}
    assert set(got) == {"a", "b"} and got["a"]["runs"] == 1 and got["a"]["risk_level"] == "LOW"
    b = got["b"]
    assert (b["records"], b["runs"], b["privacy_score"], b["risk_score"], b["audit_events"]) == (0, 0, 0.0, 0.0, 2)
    assert b["risk_level"] == "NOT_EVALUATED" and b["compliance_status"] == audit.IDLE_TEXT


def test_written_tables_are_read_once(spark, customers, monkeypatch):
    """All validators share one profile; what was scanned and tried is reported."""
    calls = []
    real = validate.profile_table
    monkeypatch.setattr(validate, "profile_table", lambda *a: calls.append(a[1]) or real(*a))
    run = _run(spark, customers)
    results, findings = validate.run_validators(run)
    assert calls == ["customers"] and results.count() > 4
    metrics = validate.scan_metrics(run.profile).first()
    assert metrics["rows_scanned"] == customers.count() and metrics["columns_scanned"] == len(customers.columns)
    assert metrics["patterns_tried"] > metrics["values_scanned"] > 0
    tried = validate.exploit_metrics(run.policy, findings).first()
    assert tried["attempts"] == run.policy.count() + 1
    assert tried["successful_exploits"] == findings.filter("validator in ('exploit', 'linkage')").count()


def test_validators_need_no_shared_folder(spark, customers, monkeypatch):
    import veilwork.session

    def refuse(*_):
        raise RuntimeError("set spark.checkpoint.dir")

    monkeypatch.setattr(veilwork.session, "shared_root", refuse)
    results, findings = validate.run_validators(_run(spark, customers))
    assert findings.filter("code = 'VALIDATOR_ERROR'").count() == 0


def test_dates_under_noise_keep_their_type(spark):
    import datetime as dt

    from veilwork.functions.techniques import ColumnRule, Settings
    from veilwork.operators.apply import apply_policy
    from veilwork.sources.catalog import catalog, columns_of, declared_keys
    from veilwork.sources.sinks import conform

    rows = [(i, dt.date(2020, 1, 1), dt.datetime(2020, 1, 1, 7, 30)) for i in range(50)]
    df = spark.createDataFrame(rows, "id int, day date, at timestamp").withColumn("local", F.col("at").cast("timestamp_ntz"))
    rules = [ColumnRule("t", "id", "NO_CHANGE", is_primary_key=True)] + [ColumnRule("t", c, "DIFFERENTIAL_PRIVACY", "DOB") for c in ("day", "at", "local")]
    done = conform(apply_policy(df, "t", rules, Settings("s", date_noise_days=30.0)), rules)
    assert done.dtypes == df.dtypes
    assert done.filter("date_format(at, 'HH:mm') = '07:30' and date_format(local, 'HH:mm') = '07:30'").count() == 50
    assert done.select("day").distinct().count() > 10
    noisy = spark.createDataFrame([("t", c, "DIFFERENTIAL_PRIVACY") for c in ("day", "at", "local")], "table_name string, column_name string, technique string")
    keys = declared_keys(spark, [("t", "id", True, None, None, True)])
    source, target = (catalog(columns_of(spark, {"t": d}), keys) for d in (df, done))
    assert validate.schema_findings(source, noisy, target).count() == 0


def test_certificate_says_what_was_checked(spark, customers, tmp_path):
    rows = [(t, True, True, 0.0, 10) for t in ("customers", "clean")]
    report = reports.compliance_report(
        spark.createDataFrame(rows, "table_name string, row_counts_match boolean, checks_passed boolean, risk_score double, rows long"), {}, "Officer", "DPDP Act 2023"
    )
    of = lambda validator, code: (validator, "X", "customers", "c", code, "HIGH", "FAIL", 1, f"about {code}")
    findings = spark.createDataFrame([of("leak_scan", "A"), of("leak_scan", "B"), of("exploit", "C"), of("linkage", "D")], validate.FINDING)
    lines = [r["line"] for r in reports.certificate_lines(report, policy(spark, False), findings, "2026-01-02").collect()]
    assert "Date of Verification : 2026-01-02" in lines and lines[-2] == "END OF CERTIFICATE" and lines[-1] == lines[0]
    clean, dirty = lines[lines.index("Table: 'clean'") : lines.index("Table: 'customers'")], lines[lines.index("Table: 'customers'") :]
    strip = lambda part: {x.split(":", 1)[0].strip(): x.split(":", 1)[1].strip() for x in part if x.startswith("  ") and ":" in x}
    assert (strip(clean)["Raw values"], strip(clean)["Attack status"], strip(clean)["Linkage level"]) == ("PASSED (none found)", "SECURE [PASS]", "LOW")
    assert (strip(dirty)["Raw values"], strip(dirty)["Attack status"], strip(dirty)["Linkage level"]) == ("FAILED (2 found)", "BROKEN [FAIL]", "HIGH")
    assert strip(dirty)["Note"] == "about D"
    unseen = [r["line"] for r in reports.certificate_lines(report, policy(spark, False), findings, attacked=False).collect()]
    assert sum("UNVERIFIED" in x for x in unseen) == 2 and not any("Linkage level" in x for x in unseen)
