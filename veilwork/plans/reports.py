"""Compliance report and certificate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .validate import certify

# Meaning of the flags.
LEGEND = (
    "GREEN  (0): every personal column is protected",
    "YELLOW (1-69): protected, but quasi-identifiers could be linked",
    "RED    (70-100): personal data is exposed or easily linked",
)


def compliance_report(
    table_reports: DataFrame, stats: dict[str, object], approved_by: str, law: str, version: str = "1.0"
) -> DataFrame:
    """One nested row: metadata, execution summary, and the table details as an array.

    The details hold one entry per table of the schema, not per data row.
    """
    head = certify(table_reports)
    details = table_reports.agg(
        F.array_sort(F.collect_list(F.struct("table_name", "row_counts_match", "checks_passed", "risk_score", "rows")))
    ).scalar()
    return head.select(
        F.struct(
            F.lit(law).alias("compliance_law"),
            "certification_status",
            F.lit(approved_by).alias("auditor_signature"),
            F.col("overall_risk_score").alias("overall_privacy_risk_score"),
            F.lit(version).alias("policy_version"),
        ).alias("compliance_metadata"),
        F.struct(
            F.lit(str(stats.get("start_time", ""))).alias("start_time"),
            F.lit(str(stats.get("end_time", ""))).alias("end_time"),
            F.lit(round(float(stats.get("duration_seconds", 0.0)), 2)).alias("duration_seconds"),
            F.col("tables_processed").alias("tables_processed_count"),
            F.lit(int(stats.get("total_rows", 0))).cast("long").alias("total_rows_anonymized"),
        ).alias("execution_summary"),
        details.alias("table_compliance_details"),
    )


def _line(df: DataFrame, section: int, table: Column, rank: int, text: Column) -> DataFrame:
    return df.select(
        F.lit(section).alias("section"), table.alias("tbl"), F.lit(rank).alias("rank"), text.alias("line")
    )


def table_checks(tables: DataFrame, findings: DataFrame) -> DataFrame:
    """Per table what the attacker's checks found: raw leaks, exploits, linkage level, and the first linkage note."""
    of = lambda name: F.count_if(F.col("validator") == name)
    note = F.min(F.when(F.col("validator") == "linkage", F.col("message")))
    found = findings.filter("table_name is not null").groupBy("table_name").agg(
        of("leak_scan").alias("leaks"), of("exploit").alias("exploits"), of("linkage").alias("links"), note.alias("note")
    )
    none = lambda c: F.coalesce(c, F.lit(0))
    return tables.select("table_name").distinct().join(found, "table_name", "left").select(
        "table_name", none("leaks").alias("leaks"), none("exploits").alias("exploits"),
        F.when(none("exploits") > 0, "HIGH").when(none("links") > 0, "MEDIUM").otherwise("LOW").alias("linkage_level"), "note",
    )


def certificate_lines(
    report: DataFrame, policy: DataFrame, findings: DataFrame, date: str | None = None, attacked: bool = True
) -> DataFrame:
    """The certificate as text lines in print order.

    ``date`` is the day of verification; without ``attacked`` the attacker's
    checks did not run and their status is unverified.
    """
    none = F.lit("")
    m, e = "compliance_metadata", "execution_summary"
    rule = F.lit("=" * 72)
    heads = [
        (0, rule),
        (1, F.lit("DATA PRIVACY COMPLIANCE AUDIT REPORT")),
        (2, F.upper(f"{m}.compliance_law")),
        (3, rule),
        (4, F.concat(F.lit("Certification Status : "), F.col(f"{m}.certification_status"))),
        (5, F.concat(F.lit("Authorized Auditor   : "), F.col(f"{m}.auditor_signature"))),
        (6, F.concat(F.lit("Overall Risk Score   : "), F.col(f"{m}.overall_privacy_risk_score").cast("string"), F.lit(" / 100"))),
        (7, F.concat(F.lit("Policy Version Used  : "), F.col(f"{m}.policy_version"))),
        *([(8, F.lit(f"Date of Verification : {date}"))] if date else []),
        *[(10 + i, F.lit(text)) for i, text in enumerate(LEGEND)],
        (20, F.concat(F.lit("Start Time           : "), F.col(f"{e}.start_time"))),
        (21, F.concat(F.lit("End Time             : "), F.col(f"{e}.end_time"))),
        (22, F.concat(F.lit("Tables Synced        : "), F.col(f"{e}.tables_processed_count").cast("string"))),
        (23, F.concat(F.lit("Rows Processed       : "), F.format_number(F.col(f"{e}.total_rows_anonymized"), 0))),
        (24, F.concat(F.lit("Process Duration     : "), F.col(f"{e}.duration_seconds").cast("string"), F.lit(" seconds"))),
    ]
    head = report.select(
        F.lit(0).alias("section"),
        none.alias("tbl"),
        F.inline(F.array(*[F.struct(F.lit(i).alias("rank"), text.alias("line")) for i, text in heads])),
    )
    tables = report.select(F.inline("table_compliance_details"))
    name = F.col("table_name")
    passed = F.when(F.col("row_counts_match"), "PASSED").otherwise("FAILED")
    checks = table_checks(tables, findings)
    leaks = F.when(F.col("leaks") > 0, F.concat(F.lit("FAILED ("), F.col("leaks").cast("string"), F.lit(" found)"))).otherwise("PASSED (none found)")
    broken = F.when(F.col("exploits") > 0, "BROKEN [FAIL]").otherwise("SECURE [PASS]") if attacked else F.lit("UNVERIFIED")
    tail = report.select(F.lit(2).alias("section"), none.alias("tbl"), F.inline(F.array(
        F.struct(F.lit(0).alias("rank"), rule.alias("line")), F.struct(F.lit(1).alias("rank"), F.lit("END OF CERTIFICATE").alias("line")),
        F.struct(F.lit(2).alias("rank"), rule.alias("line")),
    )))
    per_table = [
        _line(checks, 1, name, 3, F.concat(F.lit("  Raw values         : "), leaks)),
        _line(checks, 1, name, 5, F.concat(F.lit("  Attack status      : "), broken)),
        *([_line(checks, 1, name, 6, F.concat(F.lit("  Linkage level      : "), F.col("linkage_level")))] if attacked else []),
        *([_line(checks.filter("note is not null"), 1, name, 7, F.concat(F.lit("  Note               : "), F.col("note")))] if attacked else []),
        _line(tables, 1, name, 0, F.concat(F.lit("Table: '"), name, F.lit("'"))),
        _line(tables, 1, name, 1, F.concat(F.lit("  Count validation : "), passed)),
        _line(tables, 1, name, 2, F.concat(F.lit("  Table Risk Score : "), F.col("risk_score").cast("string"), F.lit(" / 100"))),
        _line(findings.filter("table_name is not null"), 1, name, 4, F.concat(F.lit("  * ["), "code", F.lit("] "), "message")),
        _line(
            policy, 1, name, 8,
            F.concat(F.lit("  "), F.rpad("column_name", 20, " "), F.lit(" -> Type: "),
                     F.rpad(F.coalesce("pii_type", F.lit("NONE")), 15, " "), F.lit(" | Technique: "), "technique"),
        ),
    ]
    lines = head.unionByName(tail)
    for part in per_table:
        lines = lines.unionByName(part)
    return lines.orderBy("section", "tbl", "rank", "line")


def write_certificate(lines: DataFrame, target: str) -> None:
    """One text file; the certificate has a line per table and column, so a single task writes it."""
    lines.coalesce(1).sortWithinPartitions("section", "tbl", "rank", "line").select(
        F.col("line").alias("value")
    ).write.mode("overwrite").text(target)
