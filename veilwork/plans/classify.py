"""Industry of a schema from keywords in its table and column names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import any_of

# Keywords per industry; the earlier industry wins a tie.
INDUSTRY_KEYWORDS = {
    "BANKING": ("account", "transaction", "loan", "credit", "ifsc", "emi", "balance", "bank"),
    "HEALTHCARE": ("patient", "doctor", "prescription", "diagnosis", "blood", "ward", "medical"),
    "HR": ("employee", "payroll", "attendance", "leave", "uan", "designation", "joining", "salary"),
    "ECOMMERCE": ("order", "product", "cart", "delivery", "wishlist", "review", "customer"),
    "INSURANCE": ("policy", "claim", "premium", "nominee", "coverage"),
    "TELECOM": ("subscriber", "call", "data", "recharge", "sim"),
}

# Compliance law per industry.
COMPLIANCE_LAWS = {
    "BANKING": "RBI Guidelines + DPDP Act 2023",
    "HEALTHCARE": "DPDP Act 2023 + Indian Medical Council guidelines",
    "HR": "DPDP Act 2023 + Labour Code compliance",
    "ECOMMERCE": "DPDP Act 2023 + Consumer Protection Act",
    "INSURANCE": "IRDAI Guidelines + DPDP Act 2023",
    "TELECOM": "TRAI Guidelines + DPDP Act 2023",
    "GENERAL": "DPDP Act 2023",
}


def compliance_law(industry: Column) -> Column:
    laws = F.create_map(*[F.lit(x) for pair in COMPLIANCE_LAWS.items() for x in pair])
    return F.coalesce(laws[industry], F.lit(COMPLIANCE_LAWS["GENERAL"]))


def _hits(name: Column, words: Sequence[str]) -> Column:
    total = F.lit(0)
    for word in words:
        total = total + name.contains(word).cast("int")
    return total


def industry_scores(catalog: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Keyword hits per industry: every column name, and every table name once.

    A fixed list of tests per row instead of a join with the keyword list, so
    the aggregate is one partial pass.
    """
    columns = catalog.select(*by, F.lower("column_name").alias("_name"))
    tables = catalog.select(*by, F.lower("table_name").alias("_name")).distinct()
    names = columns.unionByName(tables)
    return names.groupBy(*by).agg(
        *[F.sum(_hits(F.col("_name"), words)).alias(k) for k, words in INDUSTRY_KEYWORDS.items()]
    )


def classify(catalog: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Best industry, its score, the confidence and the compliance law."""
    ranked = F.array(
        *[
            F.struct(F.col(k).alias("score"), F.lit(-i).alias("rank"), F.lit(k).alias("name"))
            for i, k in enumerate(INDUSTRY_KEYWORDS)
        ]
    )
    best = industry_scores(catalog, by).select(*by, F.array_max(ranked).alias("best"))
    score = F.col("best.score")
    industry = F.when(score > 0, F.col("best.name")).otherwise(F.lit("GENERAL"))
    confidence = F.when(score > 0, F.bround(F.least(F.lit(0.7), score / F.lit(10.0)), 2))
    return best.select(
        *by,
        industry.alias("industry"),
        score.alias("score"),
        confidence.alias("confidence"),
        compliance_law(industry).alias("compliance_law"),
    )


def evidence(catalog: DataFrame, industry: str) -> DataFrame:
    """The columns that speak for an industry."""
    return catalog.filter(any_of(F.lower("column_name"), INDUSTRY_KEYWORDS[industry]))
