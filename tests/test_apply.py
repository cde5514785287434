"""Properties of policy application."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilwork.functions.techniques import ColumnRule, Settings, known_techniques, register_technique
from veilwork.operators.apply import apply_policy, frozen_scales, resolve_scopes

SETTINGS = Settings("unit-secret")
TEXTS = ("HASHING", "MASKING", "TOKENIZATION", "PSEUDONYMIZATION", "GENERALIZATION", "REDACTION")


@pytest.fixture(scope="module")
def people(spark):
    rows = [(i, f"name {i % 7}" if i % 5 else ("" if i % 2 else None), float(i)) for i in range(300)]
    return spark.createDataFrame(rows, "id bigint, note string, amount double").cache()


@pytest.mark.parametrize("technique", TEXTS)
def test_null_and_empty_pass_through(people, technique):
    done = apply_policy(people, "t", [ColumnRule("t", "note", technique)], SETTINGS)
    both = people.select("id", F.col("note").alias("raw")).join(done, "id")
    bad = both.filter(
        F.when(F.col("raw").isNull(), F.col("note").isNotNull()).when(F.col("raw") == "", F.col("note") != "").otherwise(F.col("note").isNull())
    )
    assert bad.count() == 0


@pytest.mark.parametrize("technique", TEXTS)
def test_same_in_same_out_under_repartitioning(people, technique):
    rule = [ColumnRule("t", "note", technique)]
    one = apply_policy(people.coalesce(1), "t", rule, SETTINGS)
    many = apply_policy(people.repartition(11), "t", rule, SETTINGS)
    assert one.exceptAll(many).count() == 0
    pairs = people.select("id", F.col("note").alias("raw")).join(one, "id").select("raw", "note").distinct()
    assert pairs.groupBy("raw").count().filter("count > 1").count() == 0


def test_noise_is_stable_under_repartitioning(people):
    rule = [ColumnRule("t", "amount", "DIFFERENTIAL_PRIVACY", "FINANCIAL")]
    one = apply_policy(people.coalesce(1), "t", rule, SETTINGS, ["id"])
    many = apply_policy(people.repartition(13), "t", rule, SETTINGS, ["id"])
    assert one.exceptAll(many).count() == 0
    frozen = frozen_scales(people, rule)
    again = apply_policy(people.repartition(3), "t", rule, SETTINGS, ["id"], scales=frozen)
    assert one.exceptAll(again).count() == 0


def test_secret_changes_tokens(people):
    rule = [ColumnRule("t", "note", "TOKENIZATION", "EMAIL")]
    a = apply_policy(people, "t", rule, SETTINGS).filter("note <> ''").select("note")
    b = apply_policy(people, "t", rule, Settings("other")).filter("note <> ''").select("note")
    assert a.intersect(b).count() == 0


def test_no_rules_means_no_change(people):
    assert apply_policy(people, "t", [], SETTINGS) is people
    assert apply_policy(people, "t", [ColumnRule("other", "note", "HASHING")], SETTINGS) is people


def test_unknown_technique(people):
    rule = [ColumnRule("t", "note", "SCRAMBLE")]
    with pytest.raises(ValueError, match="unknown technique"):
        apply_policy(people, "t", rule, SETTINGS)
    lax = apply_policy(people, "t", rule, Settings("s", strict=False))
    assert lax.exceptAll(people).count() == 0


@pytest.mark.parametrize("technique", ["MASKING", "GENERALIZATION", "REDACTION", "DIFFERENTIAL_PRIVACY"])
def test_key_merging_is_refused(people, technique):
    rule = [ColumnRule("t", "id", technique, is_primary_key=True)]
    with pytest.raises(ValueError, match="merge"):
        apply_policy(people, "t", rule, SETTINGS, ["id"])


def test_float_keys_are_refused(people):
    with pytest.raises(TypeError, match="cast to decimal"):
        apply_policy(people, "t", [ColumnRule("t", "amount", "HASHING")], SETTINGS)


def test_date_noise_needs_days(spark):
    df = spark.sql("select 1 as id, date'2020-01-01' as d")
    rule = [ColumnRule("t", "d", "DIFFERENTIAL_PRIVACY")]
    with pytest.raises(ValueError, match="date_noise_days"):
        apply_policy(df, "t", rule, SETTINGS, ["id"])
    done = apply_policy(df, "t", rule, Settings("s", date_noise_days=3), ["id"])
    assert done.schema["d"].dataType.simpleString() == "date"


@pytest.mark.parametrize("technique", ["HASHING", "TOKENIZATION", "PSEUDONYMIZATION"])
def test_foreign_keys_keep_their_joins(spark, technique):
    """Columns of other names share the referenced column's scope, through chains too."""
    parent = spark.createDataFrame([(f"k{i}",) for i in range(200)], "code string")
    child = spark.createDataFrame([(f"k{i % 150}",) for i in range(600)], "assigned_to string")
    grand = spark.createDataFrame([(f"k{i % 90}",) for i in range(100)], "holder string")
    rules = resolve_scopes(
        [
            ColumnRule("parent", "code", technique, is_primary_key=True),
            ColumnRule("child", "assigned_to", technique, fk_table="parent", fk_column="code"),
            ColumnRule("grand", "holder", technique, fk_table="child", fk_column="assigned_to"),
        ]
    )
    p, c, g = (apply_policy(df, n, rules, SETTINGS) for n, df in (("parent", parent), ("child", child), ("grand", grand)))
    assert p.distinct().count() == 200
    assert c.join(p, c.assigned_to == p.code).count() == 600
    assert g.join(p, g.holder == p.code).count() == 100


def test_integer_key_has_no_token_form(spark):
    with pytest.raises(ValueError, match="no token form"):
        apply_policy(spark.range(3), "t", [ColumnRule("t", "id", "TOKENIZATION", is_primary_key=True)], SETTINGS)


def test_row_names_agree(spark):
    df = spark.range(50).select("id", *[F.concat(F.lit(n), F.col("id")).alias(n) for n in ("first_name", "last_name", "full_name")])
    rules = [ColumnRule("t", n, "TOKENIZATION") for n in ("first_name", "last_name", "full_name")]
    done = apply_policy(df, "t", rules, Settings("s", row_names=True), ["id"])
    assert done.filter(F.col("full_name") != F.concat_ws(" ", "first_name", "last_name")).count() == 0


def test_registering_a_technique(people):
    @register_technique("SHOUT")
    def shout(site):
        return F.upper(site.shown)

    assert "SHOUT" in known_techniques()
    done = apply_policy(people, "t", [ColumnRule("t", "note", "shout")], SETTINGS)
    assert done.filter("note = 'NAME 1'").count() > 0


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(min_size=0, max_size=30), min_size=1, max_size=20))
def test_mask_keeps_length_of_plain_text(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    done = apply_policy(df.withColumn("raw", F.col("v")), "t", [ColumnRule("t", "v", "MASKING")], SETTINGS)
    assert done.filter(F.length("raw") != F.length("v")).count() == 0
    assert done.filter((F.col("raw") != "") & F.col("v").rlike("[^X]")).count() == 0


def test_reference_chains_keep_their_keys(spark):
    """Children of other names, a referenced unique column and a chain of three tables still join."""
    from veilwork.operators.apply import apply_policy

    parent = spark.createDataFrame([(1, "a@x.org"), (2, "b@x.org")], "id long, email string")
    child = spark.createDataFrame([(10, "a@x.org"), (11, "b@x.org"), (12, "a@x.org")], "id long, owner string")
    third = spark.createDataFrame([(20, "b@x.org")], "id long, holder string")
    for technique in ("TOKENIZATION", "PSEUDONYMIZATION", "HASHING"):
        rules = [
            ColumnRule("parent", "email", technique),
            ColumnRule("child", "owner", technique, "FULL_NAME", fk_table="parent", fk_column="email"),
            ColumnRule("third", "holder", technique, fk_table="child", fk_column="owner"),
        ]
        p, c, h = (apply_policy(d, n, rules, SETTINGS) for d, n in ((parent, "parent"), (child, "child"), (third, "third")))
        assert c.join(p, c["owner"] == p["email"]).count() == 3
        assert h.join(c, h["holder"] == c["owner"]).join(p, c["owner"] == p["email"]).count() == 1
    with pytest.raises(ValueError, match="its reference"):
        apply_policy(child, "child", [ColumnRule("parent", "email", "HASHING"), ColumnRule("child", "owner", "TOKENIZATION", fk_table="parent", fk_column="email")], SETTINGS)


def test_noise_survives_bad_values(spark):
    from veilwork.functions import noise

    rows = [(float(v),) for v in (1, 2, 3, 4)] + [(float("nan"),), (float("inf"),), (None,)]
    df = spark.createDataFrame(rows, "v double")
    assert df.select(noise.noise_scale(F.col("v"))).first()[0] == 0.111803
    tiny = spark.createDataFrame([(1e-9 * i,) for i in range(5)], "v double")
    assert 0 < tiny.select(noise.noise_scale(F.col("v"))).first()[0] < 1e-9
    out = df.select("v", noise.add_noise(F.col("v"), F.lit("t"), F.lit(0.1), None, "v").alias("n")).collect()
    assert [r["n"] is None for r in out] == [False] * 4 + [True] * 3


def test_timestamps_and_decimals_hash_alike_everywhere(spark):
    from veilwork.functions import digests

    df = spark.sql("SELECT timestamp_micros(1000000) AS t, cast(5 AS decimal(10,2)) AS d")
    shown = lambda: tuple(df.select(*[digests.text_of(F.col(f.name), f.dataType) for f in df.schema.fields]).first())
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert shown() == ("1000000", "5")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert shown() == ("1000000", "5") and "hunter2" not in repr(Settings("hunter2"))
