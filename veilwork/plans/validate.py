"""Validation of an anonymized copy: findings, status, scores."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.techniques import ColumnRule, destination_type_column
from ..operators.integrity import union_all
from ..operators.leaks import profile_table

FINDING = (
    "validator string, category string, table_name string, column_name string, code string,"
    "severity string, status string, matches long, message string"
)
PROFILE = (
    "table_name string, rows long, column_name string, records long, technique string, scanned boolean, pattern string, matches long"
)
FINDING_COLUMNS = tuple(part.strip().split(" ")[0] for part in FINDING.split(","))

# Points of a validator's status and of a finding's severity, and the floor of a clean run.
STATUS_POINTS = {"FAIL": 25.0, "WARNING": 10.0}
SEVERITY_POINTS = {"CRITICAL": 15.0, "HIGH": 8.0, "MEDIUM": 3.0, "LOW": 1.0}
CLEAN_RISK, REJECT_RISK = 1.5, 70.0
NOT_PII = ("NON_PII", "NONE", "NULL")


# The codes and sentences of the findings below; reports are read by their wording.


def _finding(df: DataFrame, validator: str, category: str, **columns: Column) -> DataFrame:
    values = {
        "validator": F.lit(validator),
        "category": F.lit(category),
        "column_name": F.lit(None).cast("string"),
        "matches": F.lit(None).cast("long"),
    } | columns
    return df.select(*[values[c].alias(c) if c in values else F.col(c) for c in FINDING_COLUMNS])


def row_count_findings(counts: DataFrame) -> DataFrame:
    """``counts``: ``table_name, source_rows, target_rows``.  Every difference is critical."""
    differ = counts.filter(
        F.coalesce("source_rows", F.lit(-1)) != F.coalesce("target_rows", F.lit(-1))
    )
    message = F.concat(
        F.lit("Row count mismatch in '"), "table_name", F.lit("': source "),
        F.coalesce(F.col("source_rows").cast("string"), F.lit("missing")), F.lit(", target "),
        F.coalesce(F.col("target_rows").cast("string"), F.lit("missing")),
    )
    return _finding(
        differ, "row_count", "INTEGRITY",
        code=F.lit("ROW_COUNT_MISMATCH"), severity=F.lit("CRITICAL"), status=F.lit("FAIL"),
        matches=F.abs(F.coalesce("source_rows", F.lit(0)) - F.coalesce("target_rows", F.lit(0))),
        message=message,
    )


def table_counts(source: Mapping[str, DataFrame], target: Mapping[str, DataFrame]) -> DataFrame:
    """Source and target rows per table."""

    def counts(tables: Mapping[str, DataFrame], out: str) -> DataFrame:
        return union_all(
            df.agg(F.count(F.lit(1)).alias(out)).select(F.lit(t).alias("table_name"), out)
            for t, df in tables.items()
        )

    return counts(source, "source_rows").join(counts(target, "target_rows"), "table_name", "full_outer")


def _family(type_name: Column) -> Column:
    """Types that hold the same values under different names."""
    low = F.lower(type_name)
    return (
        F.when(low.isin("text", "string") | low.startswith("varchar"), "text")
        .when(low.isin("numeric", "double", "float") | low.startswith("decimal"), "number")
        .otherwise(low)
    )


def schema_findings(source_catalog: DataFrame, policy: DataFrame, target_catalog: DataFrame) -> DataFrame:
    """Expected column types (source type through its technique) against the actual ones."""
    keys = ["table_name", "column_name"]
    live = source_catalog.select(*keys, "data_type")
    expected = live.join(policy.select(*keys, "technique"), keys, "left").select(
        *keys, destination_type_column(F.col("data_type"), F.col("technique")).alias("expected")
    )
    actual = target_catalog.select(*keys, F.col("data_type").alias("actual"))
    both = expected.join(actual, keys, "full_outer")
    code = (
        F.when(F.col("actual").isNull(), "COLUMN_MISSING")
        .when(F.col("expected").isNull(), "COLUMN_UNEXPECTED")
        .when(_family(F.col("expected")) != _family(F.col("actual")), "TYPE_MISMATCH")
    )
    message = F.concat_ws(
        "", F.lit("Column '"), "table_name", F.lit("."), "column_name", F.lit("': expected "),
        F.coalesce("expected", F.lit("none")), F.lit(", found "), F.coalesce("actual", F.lit("none")),
    )
    differ = both.withColumn("code", code).filter("code is not null")
    return _finding(
        differ, "schema", "INTEGRITY", column_name=F.col("column_name"),
        severity=F.lit("HIGH"), status=F.lit("FAIL"), message=message,
    )


def exposure_findings(policy: DataFrame, records: DataFrame) -> DataFrame:
    """Personal columns that were copied as they are, with the number of exposed values."""
    exposed = policy.filter(
        F.col("is_pii")
        & (F.upper(F.coalesce("technique", F.lit("NO_CHANGE"))) == "NO_CHANGE")
        & ~F.upper(F.coalesce("pii_type", F.lit("NON_PII"))).isin(*NOT_PII)
    ).join(records, ["table_name", "column_name"])
    message = F.concat(
        F.lit("CRITICAL LEAK: Raw PII column '"), "table_name", F.lit("."), "column_name", F.lit("' ("),
        F.upper("pii_type"), F.lit(") left un-anonymized (NO_CHANGE) across "),
        F.col("records").cast("string"), F.lit(" destination records."),
    )
    return _finding(
        exposed, "leak_scan", "PRIVACY", column_name=F.col("column_name"),
        code=F.lit("RAW_PII_UNANONYMIZED_EXPOSURE"), severity=F.lit("CRITICAL"), status=F.lit("FAIL"),
        matches=F.col("records"), message=message,
    )


def leak_findings(scan: DataFrame) -> DataFrame:
    """Pattern hits of ``leaks.scan_columns``; the technique decides how bad a hit is."""
    t = F.col("technique")
    severity = F.when(t == "NO_CHANGE", "CRITICAL").when(t == "HASHING", "HIGH").otherwise("MEDIUM")
    message = F.concat(
        F.lit("Detected "), F.col("matches").cast("string"), F.lit(" raw "), "pattern",
        F.lit(" pattern matches in '"), "table_name", F.lit("."), "column_name",
        F.lit("' (Technique: "), t, F.lit(")."),
    )
    return _finding(
        scan.filter(F.col("matches") > 0), "leak_scan", "PRIVACY",
        column_name=F.col("column_name"), code=F.concat(F.lit("REGEX_"), "pattern", F.lit("_LEAK")),
        severity=severity, status=F.when(t == "NO_CHANGE", "FAIL").otherwise("WARNING"),
        matches=F.col("matches"), message=message,
    )


def exploit_findings(policy: DataFrame, strict_parity: bool = False) -> DataFrame:
    """Unprotected personal columns from an attacker's view.

    ``strict_parity`` also flags columns typed NON_PII, as a literal reading of
    the rule "type is not NONE" does.
    """
    kind = F.col("pii_type")
    typed = kind.isNull() | (kind != "NONE") if strict_parity else ~F.upper(F.coalesce(kind, F.lit("NONE"))).isin(*NOT_PII)
    open_columns = policy.filter(
        (F.upper(F.coalesce("technique", F.lit("NO_CHANGE"))) == "NO_CHANGE")
        & (F.coalesce("is_pii", F.lit(False)) | typed)
    )
    message = F.concat(
        F.lit("Red-Teaming Exploit: Unprotected raw PII column '"), "table_name", F.lit("."), "column_name",
        F.lit("' (NO_CHANGE) exposed to adversary."),
    )
    return _finding(
        open_columns, "exploit", "SECURITY", column_name=F.col("column_name"),
        code=F.lit("UNPROTECTED_PII_EXPLOIT"), severity=F.lit("CRITICAL"), status=F.lit("FAIL"), message=message,
    )


def linkage_tables(catalog: DataFrame, keys: Sequence[str] = ("table_name",)) -> DataFrame:
    """Tables whose columns together link persons: birth-like, zip-like and gender-like."""
    low = F.lower("column_name")
    flags = catalog.groupBy(*keys).agg(
        F.bool_or(low.rlike("dob|birth|date")).alias("has_birth"),
        F.bool_or(low.rlike("zip|pin|postal")).alias("has_zip"),
        F.bool_or(low.rlike("gender|sex")).alias("has_gender"),
    )
    return flags.filter("has_birth and has_zip and has_gender").select(*keys)


def linkage_findings(catalog: DataFrame) -> DataFrame:
    message = F.concat(
        F.lit("Quasi-identifier linkage vulnerability detected in table '"), "table_name",
        F.lit("': DOB + Zipcode + Gender combined."),
    )
    return _finding(
        linkage_tables(catalog), "linkage", "SECURITY",
        code=F.lit("QUASI_IDENTIFIER_LINKAGE_RISK"), severity=F.lit("MEDIUM"), status=F.lit("WARNING"), message=message,
    )


def compliance_findings(spark: SparkSession, status: str) -> DataFrame:
    """One finding when the policy was never approved."""
    rows = [] if status == "APPROVED" else [(f"Policy is {status}; execution needs an approved policy.",)]
    base = spark.createDataFrame(rows, "message string").withColumn("table_name", F.lit(None).cast("string"))
    return _finding(
        base, "compliance", "COMPLIANCE", code=F.lit("POLICY_NOT_APPROVED"),
        severity=F.lit("CRITICAL"), status=F.lit("FAIL"),
    )


@dataclass
class Run:
    """What validators look at."""

    spark: SparkSession
    source: Mapping[str, DataFrame]
    target: Mapping[str, DataFrame]
    policy: DataFrame
    rules: Sequence[ColumnRule]
    source_catalog: DataFrame
    target_catalog: DataFrame
    policy_status: str = "APPROVED"
    disabled: frozenset[str] = field(default_factory=frozenset)

    @cached_property
    def profile(self) -> DataFrame:
        """``leaks.profile_table`` of every written table: read once, whichever validators ask.

        The rows (one per column and pattern) are kept by the driver as values
        of the plan, so that no validator scans a table again.
        """
        parts = [profile_table(df, t, _techniques(self, t)) for t, df in self.target.items()]
        if not parts:
            return self.spark.createDataFrame([], PROFILE)
        return self.spark.createDataFrame(union_all(parts).collect(), PROFILE)


Validator = Callable[[Run], DataFrame]
_VALIDATORS: dict[str, Validator] = {}


def register_validator(name: str) -> Callable[[Validator], Validator]:
    def add(build: Validator) -> Validator:
        _VALIDATORS[name] = build
        return build

    return add


def _techniques(run: Run, table: str) -> dict[str, str]:
    return {r.column_name: r.technique for r in run.rules if r.table_name == table}


@register_validator("row_count")
def _row_count(run: Run) -> DataFrame:
    written = run.profile.groupBy("table_name").agg(F.max("rows").alias("target_rows"))
    source = union_all(df.agg(F.count(F.lit(1)).alias("source_rows")).select(F.lit(t).alias("table_name"), "source_rows") for t, df in run.source.items())
    return row_count_findings(source.join(written, "table_name", "full_outer"))


@register_validator("schema")
def _schema(run: Run) -> DataFrame:
    return schema_findings(run.source_catalog, run.policy, run.target_catalog)


@register_validator("leak_scan")
def _leak_scan(run: Run) -> DataFrame:
    records = run.profile.select("table_name", "column_name", "records").distinct()
    return exposure_findings(run.policy, records).unionByName(leak_findings(run.profile.filter("scanned")))


def scan_metrics(profile: DataFrame) -> DataFrame:
    """What the leak scan looked at per table: rows, columns, values that are not null, and patterns tried on them."""
    per_column = profile.groupBy("table_name", "column_name").agg(
        F.max("rows").alias("rows"), F.max("records").alias("records"), F.count_if("scanned").alias("tried"),
        F.coalesce(F.sum("matches"), F.lit(0)).alias("matches"),
    )
    seen = F.col("tried") > 0
    return per_column.groupBy("table_name").agg(
        F.max("rows").alias("rows_scanned"),
        F.count_if(seen).alias("columns_scanned"),
        F.coalesce(F.sum(F.when(seen, F.col("records"))), F.lit(0)).alias("values_scanned"),
        F.coalesce(F.sum(F.when(seen, F.col("records") * F.col("tried"))), F.lit(0)).alias("patterns_tried"),
        F.sum("matches").alias("matches"),
    )


def exploit_metrics(policy: DataFrame, findings: DataFrame) -> DataFrame:
    """Attempts and successes of the attacker's view: every policy column is tried once, every linkable table once."""
    tried = policy.select("table_name", "column_name").distinct().agg(F.count(F.lit(1)).alias("n"), F.count_distinct("table_name").alias("t"))
    worked = findings.filter(F.col("validator").isin("exploit", "linkage")).agg(F.count(F.lit(1)).alias("successful_exploits"))
    attempts = tried.select((F.col("n") + F.col("t")).alias("n")).scalar()
    return worked.select(attempts.alias("attempts"), "successful_exploits")


@register_validator("exploit")
def _exploit(run: Run) -> DataFrame:
    return exploit_findings(run.policy)


@register_validator("linkage")
def _linkage(run: Run) -> DataFrame:
    return linkage_findings(run.target_catalog)


@register_validator("compliance")
def _compliance(run: Run) -> DataFrame:
    return compliance_findings(run.spark, run.policy_status)


def run_validators(run: Run) -> tuple[DataFrame, DataFrame]:
    """All enabled validators: ``(results, findings)``.

    Each one is executed and its findings are kept (they follow the schema,
    not the rows), so a validator that fails turns into a finding of its own
    and the others still run.
    """
    parts, names = [], []
    for name, build in _VALIDATORS.items():
        if name in run.disabled:
            continue
        names.append((name,))
        try:
            kept = build(run).persist()
            kept.count()
            parts.append(kept)
        except Exception as error:  # isolation is the point: any failure becomes a finding
            text = f"Validator failed: {type(error).__name__}: {error}"
            failed = (name, "SYSTEM", None, None, "VALIDATOR_ERROR", "CRITICAL", "FAIL", None, text)
            parts.append(run.spark.createDataFrame([failed], FINDING))
    findings = union_all(parts)
    return validator_results(run.spark.createDataFrame(names, "validator string"), findings), findings


def _rank(status: Column) -> Column:
    return F.when(status == "FAIL", 2).when(status == "WARNING", 1).otherwise(0)


def _status(rank: Column) -> Column:
    return F.when(rank == 2, "FAIL").when(rank == 1, "WARNING").otherwise("PASS")


def validator_results(validators: DataFrame, findings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Worst status of each validator; one without findings passes."""
    worst = findings.groupBy(*by, "validator").agg(
        F.max(_rank(F.col("status"))).alias("_rank"), F.count(F.lit(1)).alias("findings")
    )
    return validators.join(worst, [*by, "validator"], "left").select(
        *by,
        "validator",
        _status(F.coalesce("_rank", F.lit(0))).alias("status"),
        F.coalesce("findings", F.lit(0)).alias("findings"),
    )


def overall_status(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return results.groupBy(*by).agg(
        _status(F.max(_rank(F.col("status")))).alias("status"),
        F.count(F.lit(1)).alias("rules_checked"),
        F.count_if(F.col("status") == "PASS").alias("rules_passed"),
    )


def split_messages(findings: DataFrame) -> DataFrame:
    """Findings as report lines: severe ones are errors, the others warnings."""
    text = F.concat(F.lit("["), "code", F.lit("] "), "severity", F.lit(": "), "message")
    kind = F.when(F.col("severity").isin("HIGH", "CRITICAL"), "error").when(
        F.col("severity").isin("MEDIUM", "LOW"), "warning"
    )
    return findings.select(kind.alias("kind"), text.alias("line")).filter("kind is not null")


def _points(column: str, table: Mapping[str, float]) -> Column:
    value = F.lit(0.0)
    for name, points in table.items():
        value = F.when(F.col(column) == name, F.lit(points)).otherwise(value)
    return F.coalesce(F.sum(value), F.lit(0.0))


def scores(results: DataFrame, findings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Risk (1.5 to 100) and privacy score of a validation run."""
    status = results.groupBy(*by).agg(_points("status", STATUS_POINTS).alias("_status"))
    severity = findings.groupBy(*by).agg(_points("severity", SEVERITY_POINTS).alias("_severity"))
    if by:
        joined = status.join(severity, list(by), "left")
    else:
        joined = status.withColumn("_severity", severity.scalar())
    raw = F.col("_status") + F.coalesce("_severity", F.lit(0.0))
    risk = F.bround(F.least(F.greatest(raw, F.lit(CLEAN_RISK)), F.lit(100.0)), 1)
    privacy = F.greatest(F.bround(F.lit(100.0) - risk, 0), F.lit(0.0)).cast("int")
    return joined.select(*by, privacy.alias("privacy_score"), risk.alias("risk_score"))


def validation_totals(results: DataFrame, findings: DataFrame) -> DataFrame:
    """One row of totals over a run."""
    of = findings.agg(
        F.coalesce(F.sum(F.when(F.col("validator") == "leak_scan", F.col("matches"))), F.lit(0)).alias("leak_count"),
        F.count_if(F.col("validator").isin("exploit", "linkage")).alias("successful_exploits"),
        F.count(F.lit(1)).alias("findings"),
    )
    rules = results.agg(
        F.struct(
            F.count(F.lit(1)).alias("checked"), F.count_if(F.col("status") == "PASS").alias("passed")
        ).alias("r")
    ).scalar()
    return of.select("*", rules["checked"].alias("rules_checked"), rules["passed"].alias("rules_passed"))


def certify(table_reports: DataFrame) -> DataFrame:
    """Certificate over table reports (``risk_score, checks_passed``): mean risk and the verdict."""
    bad = ~F.coalesce("checks_passed", F.lit(True)) | (F.coalesce("risk_score", F.lit(0.0)) >= REJECT_RISK)
    rejected = F.coalesce(F.bool_or(bad), F.lit(False))
    return table_reports.agg(
        F.coalesce(F.bround(F.avg(F.coalesce("risk_score", F.lit(0.0))), 2), F.lit(0.0)).alias("overall_risk_score"),
        F.when(rejected, "REJECTED / EXPOSURES DETECTED [FAIL]").otherwise("APPROVED / SECURE [PASS]").alias("certification_status"),
        F.count(F.lit(1)).alias("tables_processed"),
    )


def empty_findings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FINDING)


def merge_findings(parts: Iterable[DataFrame]) -> DataFrame:
    return union_all(parts)
