"""What changed, and applying it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.integrity import union_all, unseen_rows

# Columns that hold a row's last change, the first one present is used.
TIME_COLUMNS = ("updated_at", "modified_at", "last_modified", "timestamp")
STATE = ("table_name", "row_count", "max_id", "max_time")


def time_column(df: DataFrame) -> str | None:
    names = {c.lower(): c for c in df.columns}
    return next((names[c] for c in TIME_COLUMNS if c in names), None)


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.IntegralType | T.DecimalType)


def sync_mode(df: DataFrame, key: str | None, time: str | None = None) -> str:
    """``key`` for a numeric key, else ``time``, else ``diff``."""
    if key and is_numeric(df, key):
        return "key"
    if time or time_column(df):
        return "time"
    if key:
        return "diff"
    raise ValueError("a table without key and time column cannot be synced")


def table_state(df: DataFrame, name: str, key: str | None, time: str | None = None) -> DataFrame:
    """High-water marks of a table in one aggregate: rows, greatest numeric key, latest change."""
    time = time or time_column(df)
    max_id = F.max(key).cast("long") if key and is_numeric(df, key) else F.lit(None).cast("long")
    max_time = F.max(time).cast("timestamp") if time else F.lit(None).cast("timestamp")
    return df.agg(F.count(F.lit(1)).alias("row_count"), max_id.alias("max_id"), max_time.alias("max_time")).select(
        F.lit(name).alias("table_name"), "row_count", "max_id", "max_time"
    )


def table_states(tables: Mapping[str, tuple[DataFrame, str | None, str | None]]) -> DataFrame:
    return union_all(table_state(df, n, key, time) for n, (df, key, time) in tables.items())


def change_reasons(old: DataFrame, new: DataFrame) -> DataFrame:
    """First reason per table: row count, then greatest key, then latest change; unchanged tables drop out."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.table_name") == F.col("n.table_name"), "full_outer")

    def moved(column: str) -> Column:
        before, now = F.col(f"o.{column}"), F.col(f"n.{column}")
        return now.isNotNull() & (before.isNull() | (now > before))

    known = F.col("o.table_name").isNotNull() & F.col("n.table_name").isNotNull()
    reason = (
        F.when(known & (F.col("o.row_count") != F.col("n.row_count")), "row_count")
        .when(known & moved("max_id"), "max_id")
        .when(known & moved("max_time"), "max_time")
    )
    return both.select(
        F.coalesce("o.table_name", "n.table_name").alias("table_name"), reason.alias("reason")
    ).filter("reason is not null")


def extract_by_key(df: DataFrame, key: str, mark: int | None) -> DataFrame:
    """Rows above the mark; all rows without one.  The comparison reaches the scan."""
    return df if mark is None else df.filter(F.col(key) > F.lit(mark))


def extract_by_time(df: DataFrame, time: str, mark) -> DataFrame:
    return df if mark is None else df.filter(F.col(time) > F.lit(mark))


def extract_by_diff(df: DataFrame, key: str, seen: DataFrame, seen_key: str) -> DataFrame:
    return unseen_rows(df, key, seen, seen_key)


def extract_auto(df: DataFrame, key: str, key_mark: int | None, time: str, time_mark) -> DataFrame:
    """New keys or later changes: a numeric key alone would never show an update."""
    if key_mark is None or time_mark is None:
        return df
    return df.filter((F.col(key) > F.lit(key_mark)) | (F.col(time) > F.lit(time_mark)))


def require_same_size(source: DataFrame, target: DataFrame, name: str) -> None:
    """Refuse a first checkpoint unless the copy is complete."""
    a, b = source.count(), target.count()
    if a != b:
        raise ValueError(f"no baseline for {name}: source has {a} rows, target {b}")


def upsert_checkpoints(old: DataFrame, new: DataFrame) -> DataFrame:
    """One mark per table, the later record wins."""
    rank = F.struct(F.coalesce("max_id", F.lit(-1)), F.coalesce("max_time", F.lit(0).cast("timestamp")))
    return (
        old.unionByName(new)
        .groupBy("table_name")
        .agg(F.max_by(F.struct("max_id", "max_time"), rank).alias("m"))
        .select("table_name", "m.max_id", "m.max_time")
    )


def latest_events(events: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last event per key.  ``max_by`` keeps one row per key and task, so a hot key is no burden."""
    rest = [c for c in events.columns if c not in key]
    last = events.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("e"))
    return last.select(*key, "e.*")


def apply_changes(
    destination: DataFrame, latest: DataFrame, key: Sequence[str], operation: str = "operation"
) -> DataFrame:
    """Destination after upserts and deletes.

    ``latest`` has one already anonymized row per key.  Old rows of every
    touched key go (one anti join on the key), new images come in.
    """
    kept = destination.join(latest.select(*key), list(key), "left_anti")
    images = latest.filter(F.col(operation) != "DELETE").select(*destination.columns)
    return kept.select(*destination.columns).unionByName(images)


def split_deletes(
    latest: DataFrame, key: str, children: DataFrame, child_key: str, operation: str = "operation"
) -> tuple[DataFrame, DataFrame]:
    """``(allowed, refused)``: a delete of a row that still has children is refused; only deletes are looked up."""
    parents = children.filter(F.col(child_key).isNotNull()).select(F.col(child_key).alias("_p")).distinct()
    is_delete = F.col(operation).eqNullSafe("DELETE")
    deletes, met = latest.filter(is_delete), F.col(key) == F.col("_p")
    allowed = latest.filter(~is_delete).unionByName(deletes.join(parents, met, "left_anti"))
    return allowed, deletes.join(parents, met, "left_semi")
