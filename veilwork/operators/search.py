"""Text search over tables and policies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def any_column_contains(df: DataFrame, term: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows where any column contains the term, whatever the case."""
    chosen = columns or df.columns
    if not term:
        return df
    text = F.concat_ws("\u0001", *[F.col(c).cast("string") for c in chosen])
    return df.filter(F.lower(text).contains(term.lower()))


def search_policy(policy: DataFrame, term: str = "", pii_type: str | None = None) -> DataFrame:
    """Policy rows by column name or type, with an exact type filter."""
    rows = policy
    if term:
        low = term.lower()
        rows = rows.filter(F.lower("column_name").contains(low) | F.lower("pii_type").contains(low))
    return rows.filter(F.col("pii_type") == pii_type) if pii_type else rows


def pii_columns(policy: DataFrame) -> DataFrame:
    """Personal columns in table and column order."""
    return policy.filter("is_pii").orderBy("table_name", "column_name")


def column_policy(policy: DataFrame, table_name: str, column_name: str) -> DataFrame:
    return policy.filter((F.col("table_name") == table_name) & (F.col("column_name") == column_name))


def search_logs(
    logs: DataFrame,
    user: str | None = None,
    category: str | None = None,
    level: str | None = None,
    run_id: str | None = None,
    search: str | None = None,
) -> DataFrame:
    """Audit rows by user, category (or text), level, run and free text; newest first.

    Rows come back as stored: rewriting a message would break its signature.
    """
    rows = logs
    if user:
        rows = rows.filter(F.lower(F.col("user_id").cast("string")) == user.lower())
    if category and category != "all":
        text = F.lower(F.concat_ws(" ", "action", "step_name", "details"))
        low = category.lower()
        rows = rows.filter(F.lower("category").contains(low) | text.contains(low))
    if level and level != "all":
        rows = rows.filter(F.lower("level").contains(level.lower()))
    if run_id:
        rows = rows.filter((F.col("run_id") == run_id) | F.col("id").startswith("log_init_"))
    if search:
        text = F.lower(F.concat_ws(" ", "action", "details", "step_name", "run_id"))
        rows = rows.filter(text.contains(search.lower()))
    return rows.orderBy(F.desc("timestamp"), F.desc("id"))
