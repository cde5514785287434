"""Golden values of the column functions."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from veilwork.functions import digests, generalize, masks, noise, tokens
from veilwork.functions.techniques import ColumnRule, Settings, destination_type
from veilwork.operators.apply import apply_policy, preview

SETTINGS = Settings("unit-secret")


def value(spark, column, text):
    df = spark.createDataFrame([(text,)], "v string")
    return df.select(column(F.col("v")).alias("r")).first()[0]


@pytest.mark.parametrize(
    ("kind", "name", "text", "expected"),
    [
        ("AADHAAR", "x", "1234 5678 9012", "1234 5678 XXXX"),
        ("AADHAAR", "x", "1234-5678-9012", "12345678XXXX"),
        ("AADHAAR", "x", "123456789012", "12345678XXXX"),
        ("AADHAAR", "x", "12 3", "XXX"),
        (None, "aadhaar_no", "12345", "1XXXX"),
        ("PAN", "x", "ABCDE1234F", "ABCDE1XXXX"),
        (None, "company", "Acme Ltd", "AcmXXXX"),
        ("GSTIN", "x", "22ABCDE1234F1Z5", "22ABCDE123XXXXX"),
        ("GSTIN", "x", "1234", "XXXX"),
        ("CREDIT_CARD", "x", "4111 1111-1111 1234", "XXXXXXXXXXXX1234"),
        ("BANK_ACCOUNT", "x", "12345678", "XXXX5678"),
        (None, "credit_account", "123", "XXX"),
        ("DRIVING_LICENSE", "x", "DL-01-20230012345", "DL012023001XXXX"),
        ("UAN", "x", "100200300400", "10020030XXXX"),
        ("OTHER", "note", "a b-c", "XXXXX"),
    ],
)
def test_masks(spark, kind, name, text, expected):
    assert value(spark, lambda v: masks.mask(v, kind, name), text) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [("alice@mail.in", "a***e@mail.in"), ("a@mail.in", "a***@mail.in"), ("bob", "b***b"), ("b", "b***")],
)
def test_edge_mask(spark, text, expected):
    assert value(spark, masks.edge_mask, text) == expected


def test_masker_order():
    assert masks.masker_for(None, "company") == "PAN"
    assert masks.masker_for(None, "credit_account") == "CREDIT_CARD"
    assert masks.masker_for("UAN", "account") == "BANK_ACCOUNT"
    assert masks.masker_for(None, "note") is None


def test_digests(spark):
    sha = hashlib.sha256(b"12345").hexdigest()
    assert value(spark, digests.sha256_hex, "12345") == sha
    assert value(spark, digests.short_hash, "12345") == sha[:16]
    assert value(spark, digests.short_token, "12345") == "TOK-" + sha[:8].upper()
    assert value(spark, digests.digest52, "12345") == int(sha[:13], 16)
    key = digests.derive_key("s")
    assert value(spark, lambda v: digests.keyed_digest(v, key), "é") == hashlib.sha256((key + "é").encode()).hexdigest()


@pytest.mark.parametrize("secret", ["k", "k" * 64, "k" * 100])
def test_hmac(spark, secret):
    expected = hmac.new(secret.encode(), "a:b:ç".encode(), hashlib.sha256).hexdigest()
    assert value(spark, lambda v: digests.hmac_sha256(v, secret), "a:b:ç") == expected


def test_seal_round_trip_and_repeatable(spark):
    sealed = [value(spark, lambda v: digests.seal(v, "k"), "naïve") for _ in range(2)]
    assert sealed[0] == sealed[1]
    assert value(spark, lambda v: digests.unseal(v, "k"), sealed[0]) == "naïve"
    assert value(spark, lambda v: digests.seal(v, "other"), "naïve") != sealed[0]


@pytest.mark.parametrize(
    ("kind", "name", "text", "expected"),
    [
        (None, "city", "Pune", "CITY"),
        (None, "state", "Goa", "STATE"),
        ("ADDRESS", "pincode", "411001", "LOCATION"),
        (None, "home_pincode", "411001", "411XXX"),
        (None, "pincode", "41", "XXXXXX"),
        ("DATE_OF_BIRTH", "x", "1990-05-01", "1990-XX-XX"),
        (None, "dob", "199", "XXXX-XX-XX"),
        (None, "x", "abc", "GENERALIZED"),
    ],
)
def test_generalize(spark, kind, name, text, expected):
    assert value(spark, lambda v: generalize.generalize(v, kind, name), text) == expected


def test_token_kinds():
    assert tokens.token_kind("FULL_NAME", "x") == "full_name"
    assert tokens.token_kind("FULL_NAME", "first_name") == "first_name"
    assert tokens.token_kind(None, "beneficiary_name") == "full_name"
    assert tokens.token_kind(None, "work_email") == "email"
    assert tokens.token_kind(None, "contact_id") == "phone"
    assert tokens.token_kind(None, "pincode") == "pincode"
    assert tokens.token_kind("LOCATION", "x") == "city"
    assert tokens.token_kind(None, "home_address") == "address"
    assert tokens.token_kind(None, "other") == "word"
    assert tokens.pseudonym_kind(None, "nickname") == "full_name"


def test_token_forms(spark):
    for kind, pattern in {
        "phone": r"\+91 [6-9]\d{9}", "pincode": r"[1-9]\d{5}", "email": r"[a-z]+\.[a-z]+\d+@example\.(com|net|org)",
        "full_name": r"\w+ \w+",
    }.items():
        import re

        token = value(spark, lambda v, k=kind: tokens.build(k, v, "key", "t.c"), "x1")
        assert re.fullmatch(pattern, token), (kind, token)


def test_noise_bounds_and_age(spark):
    df = spark.range(2000).select("id", (F.col("id") % 90).cast("double").alias("age"))
    rules = [ColumnRule("t", "age", "DIFFERENTIAL_PRIVACY")]
    done = apply_policy(df, "t", rules, SETTINGS, ["id"])
    low, same, mean = done.join(df.select("id", F.col("age").alias("raw")), "id").agg(
        F.min("age"), F.count_if(F.col("age") == F.col("raw")), F.avg(F.abs(F.col("age") - F.col("raw")))
    ).first()
    assert low >= 0 and same < 1000 and 0.5 < mean < 10


def test_noise_on_text_and_nan(spark):
    df = spark.createDataFrame([(1, "10.5"), (2, "x"), (3, None), (4, "")], "id int, amount string")
    done = apply_policy(df, "t", [ColumnRule("t", "amount", "DIFFERENTIAL_PRIVACY")], SETTINGS, ["id"])
    got = {r["id"]: r["amount"] for r in done.collect()}
    assert got[1] is not None and got[2] is None and got[3] is None and got[4] is None


def test_noise_scale_default(spark):
    df = spark.createDataFrame([(1, None)], "id int, v double")
    assert df.agg(noise.noise_scale(F.col("v"))).first()[0] == 1.0


def test_preview_shift(spark):
    df = spark.createDataFrame([(100.0,)], "v double")
    share = (sum(map(ord, "salary")) % 20 - 10) / 100
    got = df.select(noise.preview_shift(F.col("v"), "salary")).first()[0]
    assert got == float(int(100 * (1 + share) + 0.5))


def test_destination_types():
    assert destination_type("int", "NO_CHANGE") == "int"
    assert destination_type("int", None) == "int"
    assert destination_type("int", " passthrough ") == "int"
    assert destination_type("int", "differential_privacy") == "NUMERIC"
    assert destination_type("int", "anything") == "TEXT"


def test_preview(spark):
    df = spark.range(20).select("id", F.lit("abc").alias("note"))
    shown = preview(df, "t", [ColumnRule("t", "note", "REDACTION")], SETTINGS, ["id"], limit=3)
    assert shown.columns == ["id", "note__before", "note"]
    assert [tuple(r) for r in shown.collect()] == [(i, "abc", "REDACTED") for i in range(3)]
