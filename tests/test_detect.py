"""Identifier rules and column verdicts."""

import pytest
from pyspark.sql import functions as F

from veilwork.functions.patterns import LEAK_PATTERNS, best_match, leak_count, leak_hit, matches_of
from veilwork.operators import detect, leaks
from veilwork.sources.sampling import head_sample, random_sample, sample_texts

CASES = [
    ("4123 4567 8901", None, {"aadhaar": 0.95}, "aadhaar"),
    ("123456789012", None, {"aadhaar": 0.95, "uan": 0.85}, "aadhaar"),
    ("919876543210", None, {"aadhaar": 0.95, "indian_phone": 0.90, "uan": 0.85}, "aadhaar"),
    ("+91 9876543210", None, {"indian_phone": 0.90}, "indian_phone"),
    ("9876543210", None, {"indian_phone": 0.90}, "indian_phone"),
    ("abcde1234f", None, {"pan": 0.98}, "pan"),
    ("22ABCDE1234F1Z5", None, {"gstin": 0.95}, "gstin"),
    ("k1234567", None, {"indian_passport": 0.60}, "indian_passport"),
    ("MH12AB1234", None, {"driving_license": 0.75}, "driving_license"),
    ("DL-01-20230012345", None, {"driving_license": 0.75}, "driving_license"),
    ("DL-01-2023001234", None, {}, None),
    ("abc1234567", None, {"voter_id": 0.80}, "voter_id"),
    ("hello", None, {}, None),
    ("", None, {}, None),
    (None, None, {}, None),
    ("NULL", None, {}, None),
    ("123456789012\n", None, {}, None),
    ("123456789012", "aadhaar_no", {"aadhaar": 0.99, "uan": 0.55}, "aadhaar"),
    ("123456789012", "UAN_no", {"aadhaar": 0.65, "uan": 0.95}, "uan"),
]


@pytest.mark.parametrize(("text", "name", "expected", "best"), CASES)
def test_values(spark, text, name, expected, best):
    df = spark.createDataFrame([(text, name)], "v string, c string")
    column = F.col("c") if name else None
    row = df.select(matches_of(F.col("v"), column).alias("m"), best_match(F.col("v"), column).alias("b")).first()
    assert {m["pii_type"]: round(m["confidence"], 4) for m in (row["m"] or [])} == expected
    assert (row["b"]["pii_type"] if row["b"] else None) == best


def verdict(spark, name, values, n=10):
    cells = spark.createDataFrame(
        [("t", name, i, v) for i, v in enumerate(values)], "table_name string, column_name string, position long, value string"
    )
    return detect.column_verdicts(detect.first_values(cells, n)).first()


def test_column_ties_go_to_the_first_seen(spark):
    row = verdict(spark, "uan_no", ["123456789012"] * 10)
    assert (row["pii_type"], round(row["confidence"], 4), row["matches"]) == ("aadhaar", 0.65, 10)
    assert round(verdict(spark, "aadhaar_no", ["123456789012"] * 10)["confidence"], 4) == 0.99
    assert round(verdict(spark, "ref", ["123456789012"] * 10)["confidence"], 4) == 0.95


def test_only_the_first_samples_count(spark):
    values = ["word"] * 10 + ["ABCDE1234F"] * 10
    assert verdict(spark, "x", values)["is_pii"] is False
    assert verdict(spark, "x", values, n=20)["pii_type"] == "pan"


def test_mixed_column_takes_the_most_frequent(spark):
    row = verdict(spark, "x", ["ABCDE1234F", "9876543210", "9876543210", "none"])
    assert (row["pii_type"], row["technique"], row["matches"]) == ("indian_phone", "tokenization", 2)


def test_whole_column_equals_brute_force(spark):
    import random

    draw = random.Random(5)
    forms = ["ABCDE1234F", "9876543210", "123456789012", "K1234567", "word", None, ""]
    values = [draw.choice(forms) for _ in range(500)]
    row = verdict(spark, "x", values, n=500)
    counts = {
        "pan": values.count("ABCDE1234F"), "indian_phone": values.count("9876543210"),
        "aadhaar": values.count("123456789012"), "indian_passport": values.count("K1234567"),
    }
    assert counts[row["pii_type"]] == max(counts.values()) == row["matches"]


def test_merge(spark):
    schema = "table_name string, column_name string, is_pii boolean, pii_type string, confidence double, technique string"
    ext = spark.createDataFrame(
        [("t", "a", True, "EMAIL", 0.97, "tokenization"), ("t", "b", True, "NAME", 0.6, "hashing"),
         ("t", "c", False, None, 0.0, None), ("t", "d", False, None, 0.0, None)], schema,
    )
    rgx = spark.createDataFrame(
        [("t", "a", True, "pan", 0.98, "masking"), ("t", "b", False, None, 0.0, None),
         ("t", "c", True, "pan", 0.1, "masking"), ("t", "d", False, None, 0.0, None)], schema,
    )
    got = {r["column_name"]: r for r in detect.merge_detections(ext, rgx).collect()}
    assert (got["a"]["pii_type"], got["a"]["confidence"], got["a"]["method"]) == ("EMAIL", 0.99, "combined")
    assert (got["b"]["confidence"], got["b"]["method"]) == (0.6, "external")
    assert (got["c"]["confidence"], got["c"]["technique"], got["c"]["method"]) == (0.0, "masking", "regex")
    assert (got["d"]["is_pii"], got["d"]["technique"]) == (False, "no_change")


def test_missing_answers_and_safety_net(spark):
    schema = "table_name string, column_name string, is_pii boolean, pii_type string, confidence double, technique string"
    cols = spark.createDataFrame([("t", "a"), ("t", "b")], "table_name string, column_name string")
    ext = spark.createDataFrame([("t", "a", False, None, 0.0, None)], schema)
    got = {r["column_name"]: r for r in detect.fill_missing_answers(cols, ext).collect()}
    assert got["a"]["is_pii"] is False
    assert (got["b"]["is_pii"], got["b"]["pii_type"], got["b"]["technique"]) == (True, "unknown", "tokenization")
    net = spark.createDataFrame([("t", "nick_name", False, None, 0.0, None), ("t", "qty", False, None, 0.0, None)], schema)
    got = {r["column_name"]: r for r in detect.safety_net(net).collect()}
    assert (got["nick_name"]["pii_type"], got["nick_name"]["technique"]) == ("NICK_NAME", "MASKING")
    assert got["qty"]["is_pii"] is False


LEAKS = {
    "AADHAAR": "id 1234 5678 9012 ok", "PAN": "x ABCDE1234F y", "EMAIL": "to a.b@c.in now", "PHONE": "call 98765 43210",
    "GSTIN": "no 22ABCDE1234F1Z5.", "SSN": "ssn 123-45-6789", "CREDIT_CARD": "1 2 3 4 5 6 7 8 9 0 1 2 3",
}


@pytest.mark.parametrize("pattern", LEAK_PATTERNS)
def test_leak_patterns_and_their_guards(spark, pattern):
    """The guard before a pattern never hides a hit."""
    texts = [*LEAKS.values(), "nothing", "", None, "1234", "a@b", *[f"{t} {t}" for t in LEAKS.values()]]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    v = F.col("v")
    plain = F.coalesce(F.regexp_count(v, F.lit(LEAK_PATTERNS[pattern])), F.lit(0))
    bad = df.filter((F.coalesce(leak_count(v, pattern), F.lit(0)) != plain) | (F.coalesce(leak_hit(v, pattern), F.lit(False)) != (plain > 0)))
    assert bad.count() == 0
    assert df.filter(v == LEAKS[pattern]).select(leak_hit(v, pattern)).first()[0] is True


def test_scan_columns_skips_realistic_tokens(spark):
    df = spark.createDataFrame([(LEAKS["EMAIL"], LEAKS["EMAIL"], 1)], "a string, b string, n int")
    got = leaks.scan_columns(df, "t", techniques={"a": "TOKENIZATION", "b": "hashing"}).filter("matches > 0").collect()
    assert [(r["column_name"], r["technique"], r["pattern"], r["matches"]) for r in got] == [("b", "HASHING", "EMAIL", 1)]
    assert leaks.scan_columns(df.select("a"), "t", techniques={"a": "MASKING"}).count() == 0


def test_scan_limit_is_optional(spark):
    df = spark.createDataFrame([("x",)] * 600 + [(LEAKS["SSN"],)], "a string").coalesce(1)
    assert leaks.scan_columns(df, "t").filter("matches > 0").count() == 1
    assert leaks.scan_columns(df.limit(500), "t").filter("matches > 0").count() == 0


def test_samples(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 2 == 0, F.col("id")).alias("v"))
    a = [tuple(r) for r in random_sample(df, 20, 3, ["id"]).collect()]
    b = [tuple(r) for r in random_sample(df.repartition(9), 20, 3, ["id"]).collect()]
    assert a == b and len(a) == 20 and a != [tuple(r) for r in random_sample(df, 20, 4, ["id"]).collect()]
    assert random_sample(df, 20, 3).count() == 20
    assert {r["v"] for r in sample_texts(df, 20, 3, ["id"]).collect()} >= {"NULL"}
    assert [r["id"] for r in head_sample(df, "id", 3, ["id"]).collect()] == [0, 1, 2]


def test_detectors_are_merged_by_one_rule(spark):
    import pyarrow.compute as pc

    from veilwork.operators import detect

    detect.register_detector("at")(detect.expression_detector("EMAIL", lambda v: v.contains("@"), "TOKENIZATION", 0.6))
    detect.register_detector("tax")(detect.batch_detector("pan", lambda a: pc.equal(pc.utf8_length(a), 10), "HASHING", 0.5))
    try:
        rows = [(i, "ABCDE1234F", f"u{i}@x.org" if i % 3 else "none", None, "9876543210x") for i in range(30)]
        cells = detect.long_form(spark.createDataFrame(rows, "id long, pan string, mail string, empty string, other string"), "t", F.col("id"), ["pan", "mail", "empty", "other"])
        got = {r["column_name"]: r for r in detect.detect_with(cells, ["patterns", "at", "tax"]).collect()}
        assert set(got) == {"pan", "mail", "empty", "other"}
        assert (got["pan"]["pii_type"], got["pan"]["detectors"]) == ("pan", "patterns,tax") and got["pan"]["confidence"] >= 0.99
        assert (got["mail"]["pii_type"], got["mail"]["detectors"]) == ("email", "at") and abs(got["mail"]["confidence"] - 20 / 30) < 1e-9
        assert (got["empty"]["is_pii"], got["other"]["is_pii"]) == (False, False)
        alone = {r["column_name"]: r["confidence"] for r in detect.detect_with(cells, ["patterns", "at"]).collect()}
        assert abs(alone["pan"] - (0.98 - detect.LONE_RULE_PENALTY)) < 0.02
        assert detect.known_detectors()[:1] == ("patterns",)
    finally:
        detect._DETECTORS.pop("at"), detect._DETECTORS.pop("tax")
