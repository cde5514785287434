"""A whole batch run: detect, decide, gate, rewrite, write, validate, report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.techniques import Settings
from ..operators import detect
from ..operators.apply import apply_policy, frozen_scales, row_text, rules_from
from ..operators.ordered import position
from ..session import keep_methods_compiled
from ..sources import sinks
from ..sources.catalog import catalog, columns_of
from ..sources.tables import require_distinct
from . import policy as policies
from . import validate


@dataclass(frozen=True)
class RunResult:
    """What a run leaves behind."""

    findings: DataFrame
    results: DataFrame
    scales: Mapping[str, Mapping[str, float]]


def draft_policy(
    tables: Mapping[str, DataFrame],
    catalog_df: DataFrame,
    positions: Mapping[str, str],
    external: DataFrame | None = None,
) -> DataFrame:
    """Policy proposed for whole tables: pattern verdicts, external answers, name safety net.

    ``positions`` names a column per table that orders its values (a key of any
    type).  Every catalog column of the tables has a row, also of empty ones.
    The draft can be run: keys get a technique that keeps them apart.
    """
    cells = detect.long_forms({t: (df, position(df, positions[t])) for t, df in tables.items()})
    known = catalog_df.filter(F.col("table_name").isin(*tables)).select("table_name", "column_name")
    verdicts = known.join(detect.column_verdicts(cells), ["table_name", "column_name"], "left").select(
        "table_name", "column_name", F.coalesce("is_pii", F.lit(False)).alias("is_pii"), "pii_type",
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "technique", F.coalesce("matches", F.lit(0)).alias("matches"),
    )
    if external is not None:
        answers = detect.fill_missing_answers(catalog_df, external)
        verdicts = detect.merge_detections(answers, verdicts)
    found = detect.upper_labels(detect.safety_net(verdicts))
    return policies.keep_keys_apart(policies.generate_policy(found, catalog_df))


def anonymize_tables(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    policy: DataFrame,
    statuses: DataFrame,
    policy_id: str,
    settings: Settings,
    target: str,
    keys: DataFrame,
    row_keys: Mapping[str, Sequence[str]] | None = None,
    sources: Sequence[str] = (),
) -> RunResult:
    """Rewrite and write every table, then validate what was written.

    Nothing is written unless the policy is approved.  Noise scales are taken
    once and returned, so that a later stream can use the same ones.
    """
    policies.require_approved(statuses, policy_id)
    keep_methods_compiled(spark)
    for source in sources:
        require_distinct(source, target)
    rules = rules_from(policy, strict=settings.strict)
    scales: dict[str, dict[str, float]] = {}
    for name, df in tables.items():
        own = [r for r in rules if r.table_name == name]
        scales[name] = frozen_scales(df, own)
        done = apply_policy(df, name, own, settings, (row_keys or {}).get(name, ()), scales[name])
        sinks.recreate_table(done, f"{target}/{name}.parquet", own)
    written = {name: spark.read.parquet(f"{target}/{name}.parquet") for name in tables}
    run = validate.Run(
        spark, tables, written, policy, rules,
        catalog(columns_of(spark, tables), keys), catalog(columns_of(spark, written), keys),
    )
    results, findings = validate.run_validators(run)
    return RunResult(findings, results, scales)


def resume_table(
    source: DataFrame,
    name: str,
    loaded: DataFrame,
    policy: DataFrame,
    settings: Settings,
    key: str,
    scales: Mapping[str, float] | None = None,
) -> DataFrame:
    """The anonymized rows a half-done load still lacks.

    The destination's key column holds rewritten keys; the same expression maps
    the source keys before the comparison.
    """
    rules = rules_from(policy, name, settings.strict)
    marked = source.withColumn("_row", row_text([key]))
    done = apply_policy(marked, name, rules, settings, [key], scales)
    return sinks.rows_to_resume(done, loaded, key, F.col(key)).drop("_row")


def table_reports(results: DataFrame, findings: DataFrame, counts: DataFrame) -> DataFrame:
    """Per table: did counts match, did its checks pass, its risk."""
    points = F.lit(0.0)
    for name, value in validate.SEVERITY_POINTS.items():
        points = F.when(F.col("severity") == name, F.lit(value)).otherwise(points)
    per_table = findings.filter("table_name is not null").groupBy("table_name").agg(
        F.sum(points).alias("_points"), F.count_if(F.col("status") == "FAIL").alias("_failed")
    )
    joined = counts.join(per_table, "table_name", "left")
    return joined.select(
        "table_name",
        F.col("source_rows").eqNullSafe(F.col("target_rows")).alias("row_counts_match"),
        (F.coalesce("_failed", F.lit(0)) == 0).alias("checks_passed"),
        F.least(F.lit(100.0), F.coalesce("_points", F.lit(0.0))).alias("risk_score"),
        F.coalesce("target_rows", F.lit(0)).alias("rows"),
    )
