"""Sinks.  Data goes from executors to storage; nothing is collected."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.techniques import ColumnRule, destination_type
from .tables import require_distinct

AUDIT_EXPORT = (
    ("id", "ID"), ("timestamp", "Timestamp"), ("user_id", "User ID"), ("run_id", "Run ID"),
    ("step_index", "Step Index"), ("step_name", "Step Name"), ("category", "Category"), ("level", "Level"),
    ("action", "Action"), ("details", "Details"), ("audit_hash", "HMAC Hash"),
)


def append_rows(df: DataFrame, target: str, source: str | None = None) -> None:
    if source is not None:
        require_distinct(source, target)
    df.write.mode("append").parquet(target)


def append_jdbc(df: DataFrame, options: Mapping[str, str], batch_size: int = 10_000) -> None:
    """Append to a database table, ``batch_size`` rows per round trip; each task writes its own share.

    ``options`` come from ``tables.jdbc_options``.  A retried task may write
    rows twice: load into an empty table and check keys with ``key_violations``.
    """
    df.write.format("jdbc").options(**options).option("batchsize", batch_size).mode("append").save()


def conform(df: DataFrame, rules: Sequence[ColumnRule]) -> DataFrame:
    """Cast an anonymized table to its destination types (text, number, or unchanged)."""
    technique = {r.column_name: r.technique for r in rules}
    columns = []
    for f in df.schema.fields:
        kind = destination_type(f.dataType.simpleString(), technique.get(f.name))
        column = F.col(f.name)
        if kind == "TEXT" and not isinstance(f.dataType, T.StringType):
            column = column.cast("string")
        elif kind == "NUMERIC" and not isinstance(f.dataType, T.DoubleType):
            column = column.cast("double")
        columns.append(column.alias(f.name))
    return df.select(*columns)


def recreate_table(df: DataFrame, target: str, rules: Sequence[ColumnRule], source: str | None = None) -> None:
    """Replace the destination with mapped types; keys are verified after the load."""
    if source is not None:
        require_distinct(source, target)
    conform(df, rules).write.mode("overwrite").parquet(target)


def rows_to_insert(new: DataFrame, existing: DataFrame, key: Sequence[str]) -> DataFrame:
    """Insert-if-absent: one row per unseen key; of several new rows that with the least digest, so reruns agree."""
    rest = [c for c in new.columns if c not in key]
    fresh = new.distinct()
    if rest:
        fresh = new.groupBy(*key).agg(F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("_r")).select(*key, "_r.*").select(*new.columns)
    return fresh.join(existing.select(*key).distinct(), list(key), "left_anti")


def rows_to_resume(source: DataFrame, loaded_keys: DataFrame, key: str, mapped: Column) -> DataFrame:
    """Rows a half-done load still lacks.

    The destination holds rewritten keys, so the source key goes through the
    same key expression before the comparison.  Counting rows would be unsafe:
    a scan has no order.
    """
    seen = loaded_keys.select(F.col(key).alias("_seen")).distinct()
    return source.withColumn("_key", mapped).join(seen, F.col("_key") == F.col("_seen"), "left_anti").drop("_key")


def write_batch(df: DataFrame, target: str, batch_id: int) -> None:
    """Write one micro-batch to its own partition; a replay replaces it instead of adding to it."""
    df.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("batch_id").parquet(target)


def key_values(report: DataFrame) -> DataFrame:
    """The scalar fields of a report as (Metric, Value) rows; nested fields are left out."""
    simple = [
        f.name
        for f in report.schema.fields
        if not isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType)
    ]
    texts = report.select(*[F.col(c).cast("string").alias(c) for c in simple])
    return texts.unpivot([], simple, "Metric", "Value").filter("Value is not null")


def write_key_values(report: DataFrame, target: str, form: str) -> None:
    """A report as ``csv``, ``sql`` (comment lines) or ``txt``."""
    pairs = key_values(report)
    if form == "csv":
        pairs.coalesce(1).write.mode("overwrite").csv(target, header=True)
        return
    text = F.concat_ws(": ", "Metric", "Value")
    lines = {"sql": F.concat(F.lit("-- "), text), "txt": text}
    if form not in lines:
        raise ValueError("form must be csv, sql or txt")
    pairs.select(lines[form].alias("value")).coalesce(1).write.mode("overwrite").text(target)


def audit_export(logs: DataFrame) -> DataFrame:
    return logs.select(*[F.col(name).alias(title) for name, title in AUDIT_EXPORT])


def write_audit(logs: DataFrame, target: str, form: str = "json") -> None:
    if form == "csv":
        audit_export(logs).write.mode("overwrite").csv(target, header=True)
    elif form == "json":
        logs.write.mode("overwrite").json(target)
    else:
        raise ValueError("form must be csv or json")


def write_without(mapping: DataFrame, target: str, scopes: Mapping[str, str]) -> None:
    """Write a mapping table without the given scopes to a new location."""
    keep = F.lit(True)
    for column, value in scopes.items():
        keep = keep & (F.col(column) != value)
    mapping.filter(keep).write.mode("overwrite").partitionBy("scope").parquet(target)
