"""Audit trail and run history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digests import hmac_sha256
from ..operators.ordered import per_group_value, previous_value, row_numbers
from . import risk

SIGNED_FIELDS = ("timestamp", "user_id", "run_id", "action", "details")  # fixed values, in this order
# From which privacy score on a run counts as safe, and the two status texts.
SAFE_PRIVACY = 80.0
PASS_TEXT, FAIL_TEXT = "PRIVACY PROTECTED (PASS)", "ACTION REQUIRED (UNPROTECTED PII)"
IDLE_TEXT = "DATABASE CONNECTED (PIPELINE NOT STARTED)"


def signed_text() -> Column:
    """The signed form of an entry; a missing field is written out, so it cannot be moved unnoticed."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in SIGNED_FIELDS]
    return F.concat_ws(":", *parts)


def sign(logs: DataFrame, secret: str | bytes) -> DataFrame:
    return logs.withColumn("audit_hash", hmac_sha256(signed_text(), secret))


def tampered(logs: DataFrame, secret: str | bytes) -> DataFrame:
    """Entries whose signature does not fit their content."""
    return logs.filter(~F.col("audit_hash").eqNullSafe(hmac_sha256(signed_text(), secret)))


def elapsed(logs: DataFrame, salts: int | None = None) -> DataFrame:
    """Milliseconds since the first entry of the run, and the same as text.

    The run's start is one aggregate per run, looked up with salted keys: a run
    that wrote a third of the log does not end up in one task.
    """
    # microseconds as a number: a text minimum would need a sort-based aggregate
    moment = F.unix_micros(F.col("timestamp").cast("timestamp"))
    started = per_group_value(logs, ["run_id"], F.min(moment), "_start", salts)
    micros = moment - F.col("_start")
    millis = F.floor(F.greatest(micros, F.lit(0)) / 1000).cast("long")
    # hundredths of a second in whole numbers: a formatted double rounds differently between engines
    hundredths = F.floor((F.greatest(micros, F.lit(0)) + 5000) / 10_000).cast("long")
    seconds = F.concat(
        F.floor(hundredths / 100).cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0")
    )
    text = F.when(millis < 1000, F.concat(F.lit("+"), millis.cast("string"), F.lit("ms"))).otherwise(
        F.concat(F.lit("+"), seconds, F.lit("s"))
    )
    return started.select(*logs.columns, millis.alias("elapsed_ms"), text.alias("elapsed_text"))


def drop_repeats(
    logs: DataFrame, message: str, keys: Sequence[str], order: Sequence[str], bucket: Column | None = None
) -> DataFrame:
    """Drop entries that repeat the message just before them in their run."""
    seen = previous_value(logs, keys, order, message, "_before", bucket)
    keep = ~F.col("_before_exists") | ~F.col("_before").eqNullSafe(F.col(message))
    return seen.filter(keep).select(*logs.columns)


def run_versions(
    runs: DataFrame, keys: Sequence[str] = ("user_id",), bucket: Column | None = None, total: str | None = None
) -> DataFrame:
    """Version number (oldest is 1), newest is current, label as shown in the history; with ``total`` also the number of versions."""
    full = row_numbers(runs, keys, ["timestamp", "run_id"], "version_no", bucket, "_n")
    current = F.col("version_no") == F.col("_n")
    label = F.concat(
        F.lit("v"), F.col("version_no").cast("string"),
        F.when(current, " (Current Active)").otherwise(" (Previous History)"),
    )
    return full.select(
        *runs.columns,
        "version_no",
        current.alias("is_current"),
        label.alias("version_label"),
        F.when(current, "active_current").otherwise("history_previous_version").alias("status"),
        *([F.col("_n").alias(total)] if total else []),
    )


def upsert_runs(history: DataFrame, new: DataFrame, keys: Sequence[str] = ("user_id", "run_id")) -> DataFrame:
    """One row per run: the latest record of a run id wins; versions are renumbered afterwards.

    Of records with the same time the new one wins, then that with the greatest digest.
    """
    both = history.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in history.columns if c not in keys]
    latest = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("timestamp", "_new", F.xxhash64(*rest))).alias("r"))
    return latest.select(*keys, "r.*").select(*history.columns)


def record_runs(history: DataFrame, new: DataFrame, keys: Sequence[str] = ("user_id",)) -> DataFrame:
    """History after new records: a known run is replaced, the newest of each user is current, all others are demoted.

    Versions are counted anew over the whole history, as a replaced record
    moves to the end of it.
    """
    return run_versions(upsert_runs(history, new, (*keys, "run_id")), keys)


def records_total(runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Records of current runs; when they hold none, those of the latest run."""
    current = F.coalesce(F.sum(F.when(F.col("is_current"), F.col("records"))), F.lit(0))
    latest = F.max_by("records", F.struct("timestamp", "run_id"))
    return runs.groupBy(*by).agg(F.when(current == 0, latest).otherwise(current).alias("records"))


def kpis(runs: DataFrame, logs: DataFrame, snapshots: DataFrame, by: str = "user_id") -> DataFrame:
    """Dashboard row per user: totals, scores of the active policy, level, status text, audit events.

    ``snapshots`` holds the column policies frozen with each user's active run.
    Every user of any of the three has a row; one without a run is not evaluated.
    """
    totals = records_total(runs, [by])
    executed = runs.groupBy(by).agg(F.count(F.lit(1)).alias("runs"))
    events = logs.groupBy(by).agg(F.count(F.lit(1)).alias("audit_events"))
    scored = risk.policy_risk(snapshots, [by]).select(by, "risk_score", "privacy_score", "risk_level")
    users = executed.select(by).union(events.select(by)).union(scored.select(by)).filter(F.col(by).isNotNull()).distinct()
    joined = users.join(totals, by, "left").join(executed, by, "left").join(scored, by, "left").join(events, by, "left")
    ran = F.col("runs").isNotNull()
    privacy = F.coalesce("privacy_score", F.lit(100.0))
    status = F.when(privacy >= SAFE_PRIVACY, PASS_TEXT).otherwise(FAIL_TEXT)
    return joined.select(
        by,
        F.when(ran, F.col("records")).otherwise(0).alias("records"),
        F.coalesce("runs", F.lit(0)).alias("runs"),
        F.when(ran, privacy).otherwise(0.0).alias("privacy_score"),
        F.when(ran, F.coalesce("risk_score", F.lit(0.0))).otherwise(0.0).alias("risk_score"),
        F.when(ran, F.coalesce("risk_level", F.lit("LOW"))).otherwise("NOT_EVALUATED").alias("risk_level"),
        F.when(ran, status).otherwise(IDLE_TEXT).alias("compliance_status"),
        F.coalesce("audit_events", F.lit(0)).alias("audit_events"),
    )


def global_kpis(scored_policies: DataFrame, total_events: Column) -> DataFrame:
    """The same over all tenants: means of the tenants' scores, level by the 20 / 50 bands."""
    means = scored_policies.agg(
        F.sum("records").alias("records"),
        F.count(F.lit(1)).alias("runs"),
        F.coalesce(F.bround(F.avg("privacy_score"), 1), F.lit(0.0)).alias("privacy_score"),
        F.coalesce(F.bround(F.avg("risk_score"), 1), F.lit(100.0)).alias("risk_score"),
    )
    level = F.when(F.col("risk_score") <= 20, "LOW").when(F.col("risk_score") <= 50, "MEDIUM").otherwise("HIGH")
    status = F.when(F.col("privacy_score") >= SAFE_PRIVACY, "ENTERPRISE COMPLIANT (PASS)").otherwise(FAIL_TEXT)
    return means.select(
        "*", level.alias("risk_level"), status.alias("compliance_status"), total_events.alias("audit_events")
    )


def conformance(df: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Rows that break the format rules of anonymized persons (one aggregate)."""
    checks = {
        "full_name": F.col("full_name") == F.concat_ws(" ", "first_name", "last_name"),
        "pincode": F.col("pincode").rlike(r"\A\d{6}\z"),
        "phone": F.col("phone").startswith("+91"),
        "email": F.col("email").contains("@"),
    }
    have = set(df.columns)
    needed = {"full_name": {"full_name", "first_name", "last_name"}}
    usable = {n: c for n, c in checks.items() if needed.get(n, {n}) <= have}
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.count_if(~F.coalesce(c, F.lit(True))).alias(f"bad_{n}") for n, c in usable.items()],
    )


def changed_values(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Number of rows whose value changed, for columns that should have stayed as they were."""
    b = before.select(key, *[F.col(c).alias(f"_b_{c}") for c in columns])
    joined = after.join(b, key)
    return joined.agg(
        *[F.count_if(~F.col(c).eqNullSafe(F.col(f"_b_{c}"))).alias(c) for c in columns]
    ).unpivot([], list(columns), "column_name", "changed")
