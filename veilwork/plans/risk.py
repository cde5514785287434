"""Risk scores of a policy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import any_of

# What counts as a direct identifier and as a quasi-identifier.
DIRECT_TYPES = (
    "EMAIL", "PHONE", "AADHAAR", "PAN", "GSTIN", "SSN", "CREDIT_CARD", "NAME", "FULL_NAME", "IDENTIFIER",
)
DIRECT_NAMES = ("email", "phone", "mobile", "aadhaar", "pan", "ssn", "card", "credit_card")
QUASI_TYPES = (
    "QUASI_IDENTIFIER", "DOB", "DATE_OF_BIRTH", "AGE", "GENDER", "LOCATION", "ADDRESS", "SALARY", "BALANCE",
    "FINANCIAL",
)
QUASI_NAMES = ("dob", "birth", "address", "city", "state", "pincode", "zip", "salary", "balance", "amount")

# Points of a column left as it is, of a noisy column, and of linkage.
DIRECT_POINTS, QUASI_POINTS, NOISE_POINTS, LINKAGE_POINTS = 25.0, 15.0, 2.0, 10.0
LINKAGE_LINE = "High linkage attack risk: Multiple quasi-identifiers left unprotected."

# Weights of the review score.
REVIEW_WEIGHTS = {
    "NO_CHANGE": 30, "PERTURBATION": 8, "MASK_EMAIL": 4, "HASH_HMAC": 3, "TOKENIZATION": 2, "REDACTION": 1,
}
REVIEW_OTHER, REVIEW_EMPTY = 5, 78


def exposure(column_name: Column, pii_type: Column, technique: Column, is_pii: Column) -> Column:
    """How a column is exposed: ``direct``, ``quasi``, ``noise`` or null."""
    low = F.lower(column_name)
    kind = F.upper(F.coalesce(pii_type, F.lit("")))
    name = F.upper(F.when(technique != "", technique).otherwise("NO_CHANGE"))
    direct = kind.isin(*DIRECT_TYPES) | any_of(low, DIRECT_NAMES)
    quasi = kind.isin(*QUASI_TYPES) | any_of(low, QUASI_NAMES) | F.coalesce(is_pii, F.lit(False))
    left = name == "NO_CHANGE"
    return (
        F.when(left & direct, "direct")
        .when(left & quasi, "quasi")
        .when(name == "DIFFERENTIAL_PRIVACY", "noise")
    )


def _exposed(policy: DataFrame) -> DataFrame:
    return policy.withColumn(
        "_exposure",
        exposure(F.col("column_name"), F.col("pii_type"), F.col("technique"), F.col("is_pii")),
    )


def risk_level(score: Column) -> Column:
    return F.when(score == 0.0, "LOW").when(score < 50.0, "MEDIUM").otherwise("HIGH")


def risk_flag(score: Column) -> Column:
    return F.when(score == 0.0, "GREEN").when(score < 50.0, "YELLOW").otherwise("RED")


def policy_risk(policy: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Risk and privacy score per policy; an empty policy scores 0 / 100 / LOW."""
    kind = F.col("_exposure")
    points = (
        F.when(kind == "direct", DIRECT_POINTS)
        .when(kind == "quasi", QUASI_POINTS)
        .when(kind == "noise", NOISE_POINTS)
        .otherwise(0.0)
    )
    sums = _exposed(policy).groupBy(*by).agg(
        F.coalesce(F.sum(points), F.lit(0.0)).alias("_points"), F.count_if(kind == "quasi").alias("_quasi")
    )
    raw = F.col("_points") + F.when(F.col("_quasi") >= 2, LINKAGE_POINTS).otherwise(0.0)
    score = F.bround(F.least(F.lit(100.0), raw), 1)
    scored = sums.select(*by, score.alias("risk_score"))
    return scored.select(
        *by,
        "risk_score",
        F.bround(F.lit(100.0) - F.col("risk_score"), 1).alias("privacy_score"),
        risk_level(F.col("risk_score")).alias("risk_level"),
        risk_flag(F.col("risk_score")).alias("risk_flag"),
    )


def vulnerabilities(policy: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One line per exposed column, and one linkage line per policy with two or more quasi-identifiers."""
    kind = F.col("_exposure")
    place = F.concat(F.lit("'"), "table_name", F.lit("."), "column_name", F.lit("'"))
    shown = F.coalesce(F.when(F.col("pii_type") != "", F.upper("pii_type")), F.col("column_name"))
    direct = F.concat(
        F.lit("CRITICAL: Direct PII column "), place, F.lit(" ("), shown, F.lit(") left un-anonymized (NO_CHANGE).")
    )
    quasi = F.concat(
        F.lit("WARNING: Quasi-identifier column "), place, F.lit(" left un-anonymized (NO_CHANGE).")
    )
    exposed = _exposed(policy)
    lines = exposed.filter(kind.isin("direct", "quasi")).select(
        *by, F.when(kind == "direct", direct).otherwise(quasi).alias("line")
    )
    linkage = (
        exposed.groupBy(*by)
        .agg(F.count_if(kind == "quasi").alias("n"))
        .filter("n >= 2")
        .select(*by, F.lit(LINKAGE_LINE).alias("line"))
    )
    return lines.unionByName(linkage)


def ratio_risk(policy: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Fallback score: share of personal columns left as they are."""
    pii = F.count_if("is_pii")
    left = F.count_if(F.col("is_pii") & (F.upper(F.coalesce("technique", F.lit(""))) == "NO_CHANGE"))
    share = F.coalesce(F.try_divide(left, pii), F.lit(0.0))  # a policy without personal columns scores 0
    score = F.bround(F.least(F.lit(100.0), share * 100), 1)
    scored = policy.groupBy(*by).agg(score.alias("risk_score"))
    level = F.when(F.col("risk_score") <= 20, "LOW").when(F.col("risk_score") <= 50, "MEDIUM").otherwise("HIGH")
    return scored.select(
        *by,
        "risk_score",
        F.bround(F.lit(100.0) - F.col("risk_score"), 1).alias("privacy_score"),
        level.alias("risk_level"),
    )


def sensitive_count_risk(policy: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Two points per column whose technique is not ``none``, at most 100."""
    sensitive = F.count_if(~F.col("technique").eqNullSafe("none"))
    return policy.groupBy(*by).agg(
        F.least(F.lit(100.0), (sensitive * 2).cast("double")).alias("risk_score")
    )


def review_score(policy: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Weighted technique score shown during review, between 8 and 95; 78 without columns."""
    weight = F.lit(REVIEW_OTHER)
    for name, points in REVIEW_WEIGHTS.items():
        weight = F.when(F.col("technique") == name, F.lit(points)).otherwise(weight)
    n = F.count(F.lit(1))
    rounded = F.floor(F.sum(weight) / (n * 30) * 100 + F.lit(0.5)).cast("long")
    clamped = F.least(F.greatest(rounded, F.lit(8)), F.lit(95))
    return policy.groupBy(*by).agg(F.when(n > 0, clamped).otherwise(F.lit(REVIEW_EMPTY)).alias("review_score"))


def review_metadata(policy: DataFrame, by: Sequence[str] = (), status: Column | None = None) -> DataFrame:
    """What a reviewer sees first: counts, overrides and the risk forecast."""
    approvable = (status if status is not None else F.lit("DRAFT")) == "DRAFT"
    counts = policy.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_columns"),
        F.count_if("is_pii").alias("pii_columns"),
        F.count_if("admin_override").alias("admin_overrides"),
    )
    risk = policy_risk(policy, by)
    if not by:
        risk_row = risk.select(F.struct("risk_score", "risk_flag")).scalar()
        joined = counts.select("*", risk_row["risk_score"].alias("risk_score"), risk_row["risk_flag"].alias("risk_flag"))
    else:
        joined = counts.join(risk.select(*by, "risk_score", "risk_flag"), list(by))
    return joined.withColumn("is_approvable", approvable)
