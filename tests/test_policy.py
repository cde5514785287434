"""Policies: generation, review, documents, risk."""

import json

import pytest
from pyspark.sql import functions as F

from veilwork.plans import classify, policy, risk
from veilwork.sources import policy_docs

FIELDS = "table_name string, column_name string, is_pii boolean, pii_type string, technique string"


def columns(spark, *rows):
    return spark.createDataFrame([("t", *r) for r in rows], FIELDS)


@pytest.mark.parametrize(
    ("rows", "score", "level", "flag"),
    [
        ([("email", True, "EMAIL", "HASHING"), ("phone", True, "PHONE", "MASKING")], 0, "LOW", "GREEN"),
        ([("email", True, "EMAIL", "NO_CHANGE"), ("phone", True, "PHONE", "NO_CHANGE")], 50, "HIGH", "RED"),
        ([("dob", True, "DOB", "NO_CHANGE"), ("address", True, "ADDRESS", "NO_CHANGE")], 40, "MEDIUM", "YELLOW"),
        (
            [("email", True, "EMAIL", "HASHING"), ("phone", True, "PHONE", "NO_CHANGE"), ("dob", True, "DOB", "NO_CHANGE")],
            40, "MEDIUM", "YELLOW",
        ),
        ([("employee_id", True, "IDENTIFIER", "HASHING"), ("full_name", True, "NAME", "NO_CHANGE")], 25, "MEDIUM", "YELLOW"),
        ([("employee_id", True, "IDENTIFIER", "HASHING"), ("full_name", True, "NAME", "TOKENIZATION")], 0, "LOW", "GREEN"),
        ([("salary", True, "FINANCIAL", "DIFFERENTIAL_PRIVACY")], 2, "MEDIUM", "YELLOW"),
        ([("x", False, "NON_PII", "NO_CHANGE")], 0, "LOW", "GREEN"),
        ([], 0, "LOW", "GREEN"),
    ],
)
def test_policy_risk(spark, rows, score, level, flag):
    row = risk.policy_risk(columns(spark, *rows)).first()
    assert (row["risk_score"], row["privacy_score"], row["risk_level"], row["risk_flag"]) == (score, 100 - score, level, flag)


def test_risk_is_capped(spark):
    row = risk.policy_risk(columns(spark, *[(f"email{i}", True, "EMAIL", "NO_CHANGE") for i in range(9)])).first()
    assert (row["risk_score"], row["privacy_score"]) == (100.0, 0.0)


def test_vulnerability_lines(spark):
    df = columns(spark, ("dob", True, "DOB", "NO_CHANGE"), ("zip", True, "X", "NO_CHANGE"), ("email", True, "", "NO_CHANGE"))
    lines = sorted(r["line"] for r in risk.vulnerabilities(df).collect())
    assert len(lines) == 4
    assert lines[0] == "CRITICAL: Direct PII column 't.email' (email) left un-anonymized (NO_CHANGE)."
    assert risk.LINKAGE_LINE in lines


def test_other_scores(spark):
    df = columns(spark, ("a", True, "X", "NO_CHANGE"), ("b", True, "X", "HASHING"), ("c", False, "X", "NO_CHANGE"))
    assert risk.ratio_risk(df).first()["risk_score"] == 50.0
    assert risk.ratio_risk(df.filter("not is_pii")).first()["risk_score"] == 0.0
    assert risk.review_score(df).first()["review_score"] == 72  # (30 + 5 + 30) / 90
    assert risk.review_score(df.limit(0)).first()["review_score"] == 78
    assert risk.sensitive_count_risk(df.withColumn("technique", F.lit("none"))).first()["risk_score"] == 0.0


@pytest.mark.parametrize(
    ("name", "kind", "technique"),
    [
        ("contact_id", "PHONE", "TOKENIZATION"), ("company", "PAN", "MASKING"), ("shipping_x", "LOCATION", "MASKING"),
        ("paid", "IDENTIFIER", "HASHING"), ("stage", "SENSITIVE", "DIFFERENTIAL_PRIVACY"), ("qty", "SENSITIVE", "MASKING"),
    ],
)
def test_name_rules(spark, name, kind, technique):
    df = spark.createDataFrame([(name,)], "c string")
    got = df.select(policy.normalize_type(F.col("c"), F.lit(None).cast("string"), F.lit(True)).alias("k"))
    assert got.first()["k"] == kind
    assert df.select(policy.default_technique(F.col("c"), F.lit(kind)).alias("t")).first()["t"] == technique


def catalog_of(spark, *rows):
    return spark.createDataFrame(
        list(rows), "table_name string, column_name string, data_type string, is_pk boolean, fk_table string, fk_column string"
    )


def test_generate_and_extend(spark):
    cat = catalog_of(
        spark, ("t", "id", "int", True, None, None), ("t", "owner_id", "int", False, "u", "id"), ("t", "email", "string", False, None, None),
    )
    det = spark.createDataFrame(
        [("t", "id", True, None, 0.0), ("t", "owner_id", True, "identifier", 0.75), ("t", "email", False, None, 0.2)],
        "table_name string, column_name string, is_pii boolean, pii_type string, confidence double",
    )
    got = {r["column_name"]: r for r in policy.generate_policy(det, cat).collect()}
    assert (got["id"]["technique"], got["id"]["confidence"], got["id"]["is_pk"]) == ("HASHING", 0.9, True)
    assert got["id"]["reason"].endswith("Lower confidence detection - manual review recommended.")
    assert (got["owner_id"]["fk_table"], got["owner_id"]["pii_type"]) == ("u", "IDENTIFIER")
    assert got["owner_id"]["reason"].endswith("Medium confidence detection.")
    assert (got["email"]["pii_type"], got["email"]["technique"], got["email"]["confidence"]) == ("NON_PII", "NO_CHANGE", 0.2)
    known = policy.generate_policy(det.filter("column_name = 'id'"), cat)
    assert policy.missing_columns(cat, known).count() == 2
    grown = policy.extend_policy(known, det.filter("column_name <> 'id'"), cat)
    assert {r["column_name"] for r in grown.collect()} == {"id", "owner_id", "email"}


def test_overrides(spark):
    base = columns(spark, ("a", True, "X", "MASKING"), ("b", True, "X", "MASKING")).withColumns(
        {"admin_override": F.lit(False), "admin_comment": F.lit("")}
    )
    over = spark.createDataFrame(
        [("t", "a", "hashing", "one", 1), ("t", "a", "redaction", "two", 2), ("t", "zzz", "hashing", "no", 3)],
        "table_name string, column_name string, new_technique string, comment string, seq int",
    )
    got = {r["column_name"]: r for r in policy.apply_overrides(base, over).collect()}
    assert len(got) == 2
    assert (got["a"]["technique"], got["a"]["admin_override"], got["a"]["admin_comment"]) == ("REDACTION", True, "two")
    assert (got["b"]["technique"], got["b"]["admin_override"]) == ("MASKING", False)
    with pytest.raises(ValueError, match="DRAFT"):
        policy.require_draft("APPROVED")


def fold(events):
    state, seen = "DRAFT", []
    for action, comment in events:
        new = None
        if action == "reset" and state != "DRAFT":
            new = "DRAFT"
        elif action == "approve" and state == "DRAFT":
            new = "APPROVED"
        elif action == "reject" and state == "DRAFT" and comment:
            new = "REJECTED"
        seen.append(new is not None)
        state = new or state
    return state, seen


@pytest.mark.parametrize("width", [1, 7, 1000, None])
def test_status_machine_equals_a_fold(spark, width):
    """Whatever the bucket width, and with one policy that owns most events."""
    import random

    draw = random.Random(width or 0)
    histories = {p: [] for p in range(6)}
    rows = []
    for i in range(400):
        p = 0 if draw.random() < 0.6 else draw.randrange(6)
        e = (draw.choice(["approve", "reject", "reset", "approve"]), draw.choice([None, "", "why"]))
        histories[p].append(e)
        rows.append((p, i, i, *e))
    df = spark.createDataFrame(rows, "policy_id int, ts int, event_id int, action string, comment string")
    bucket = F.floor(F.col("ts") / width) if width else None
    status = {r["policy_id"]: r["status"] for r in policy.current_status(df, bucket=bucket).collect()}
    assert status == {p: fold(h)[0] for p, h in histories.items() if h}
    judged = policy.judge_events(df, bucket=bucket).orderBy("policy_id", "ts").collect()
    expected = [ok for p in sorted(histories) for ok in fold(histories[p])[1]]
    assert [r["accepted"] for r in judged] == expected


def test_gate(spark):
    statuses = spark.createDataFrame([("p", "APPROVED"), ("q", "DRAFT")], "policy_id string, status string")
    policy.require_approved(statuses, "p")
    for name in ("q", "unknown"):
        with pytest.raises(PermissionError):
            policy.require_approved(statuses, name)


def test_key_report(spark):
    df = spark.createDataFrame(
        [("u", "id", "HASHING", True, None, None), ("t", "owner", "TOKENIZATION", False, "u", "id"), ("t", "ok", "HASHING", False, "u", "id"),
         ("t", "raw", "NO_CHANGE", False, None, None)],
        "table_name string, column_name string, technique string, is_pk boolean, fk_table string, fk_column string",
    )
    got = {r["column_name"]: (r["key_kind"], r["mismatch"]) for r in policy.key_report(df).collect()}
    assert got == {"id": ("PK", False), "owner": ("FK", True), "ok": ("FK", False)}


def test_classify(spark):
    cat = spark.createDataFrame([("accounts", "balance"), ("accounts", "loan_id"), ("x", "y")], "table_name string, column_name string")
    row = classify.classify(cat).first()
    assert (row["industry"], row["score"], row["confidence"]) == ("BANKING", 3, 0.3)
    none = classify.classify(cat.filter("table_name = 'x'")).first()
    assert (none["industry"], none["confidence"], none["compliance_law"]) == ("GENERAL", None, "DPDP Act 2023")
    assert {r["column_name"] for r in classify.evidence(cat, "BANKING").collect()} == {"balance", "loan_id"}


def test_policy_documents_from_files(spark, tmp_path):
    docs = {
        "list.json": {"column_policies": [{"table_name": "t", "column_name": "a", "is_pii": True, "pii_type": "EMAIL",
                                            "confidence": 0.8, "anonymization_technique": "hashing", "reason": "r",
                                            "foreign_key_details": {"referred_table": "u", "referred_columns": ["id"]}}]},
        "map.json": {"tables": {"t": {"a": {"technique": "mask"}, "b": {}}}},
        "nested.json": {"policy_metadata": {"target_table": "main"}, "tables": [{"columns": [{"column_name": "c"}]}, {"table_name": "n", "columns": []}]},
        "empty.json": {"column_policies": []},
    }
    for name, doc in docs.items():
        (tmp_path / name).write_text(json.dumps(doc))
    got = {(r["policy_id"], r["column_name"]): r for r in policy_docs.flatten(policy_docs.read_documents(spark, str(tmp_path))).collect()}
    assert len(got) == 4
    assert got["list.json", "a"]["technique"] == "HASHING"
    assert (got["map.json", "a"]["technique"], got["map.json", "b"]["technique"], got["map.json", "a"]["pii_type"]) == ("MASK", "MASKING", "A")
    nested = got["nested.json", "c"]
    assert (nested["table_name"], nested["is_pii"], nested["pii_type"], nested["confidence"], nested["technique"]) == ("main", True, "PII", 0.9, "MASKING")
