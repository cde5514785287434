"""Leak scans: every pattern over every column in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import LEAK_PATTERNS, leak_count, leak_hit

SKIPPED_TECHNIQUES = ("TOKENIZATION", "MASKING")  # fixed values: their output looks real on purpose


def scan_columns(
    df: DataFrame,
    table_name: str,
    columns: Sequence[str] | None = None,
    techniques: Mapping[str, str] | None = None,
) -> DataFrame:
    """``(table_name, column_name, technique, pattern, matches)`` for columns x patterns.

    A single aggregate without grouping keys: one row per task is shuffled,
    whatever the size of the table.  The whole table is scanned.
    """
    techniques = {k: (v or "NO_CHANGE").upper() for k, v in (techniques or {}).items()}
    scanned = [
        c for c in (columns or df.columns) if techniques.get(c, "NO_CHANGE") not in SKIPPED_TECHNIQUES
    ]
    rows = df
    if not scanned:
        return rows.limit(0).select(
            F.lit(table_name).alias("table_name"), F.lit("").alias("column_name"),
            F.lit("").alias("technique"), F.lit("").alias("pattern"), F.lit(0).cast("long").alias("matches"),
        )
    texts = rows.select(*[F.col(c).cast("string").alias(c) for c in scanned])
    pairs = [(c, p) for c in scanned for p in LEAK_PATTERNS]
    counts = texts.agg(*[F.count_if(leak_hit(F.col(c), p)).alias(f"m{i}") for i, (c, p) in enumerate(pairs)])
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(techniques.get(c, "NO_CHANGE")).alias("technique"),
                F.lit(p).alias("pattern"),
                F.col(f"m{i}").alias("matches"),
            )
            for i, (c, p) in enumerate(pairs)
        ]
    )
    return counts.select(F.lit(table_name).alias("table_name"), F.inline(cells))


def scan_text(df: DataFrame, table_name: str, text: str, group: str | None = None) -> DataFrame:
    """Rows that hold each pattern and occurrences of it, over whole texts (optionally per group)."""
    keys = [F.col(group).alias("grp")] if group else []
    counted = df.select(*keys, *[leak_count(F.col(text), p).alias(p) for p in LEAK_PATTERNS])
    grouped = counted.groupBy(*(["grp"] if group else []))
    totals = grouped.agg(
        *[F.count_if(F.col(p) > 0).alias(f"{p}_rows") for p in LEAK_PATTERNS],
        *[F.coalesce(F.sum(F.col(p).cast("long")), F.lit(0)).alias(f"{p}_hits") for p in LEAK_PATTERNS],
    )
    cells = F.array(
        *[
            F.struct(F.lit(p).alias("pattern"), F.col(f"{p}_rows").alias("row_count"), F.col(f"{p}_hits").alias("hits"))
            for p in LEAK_PATTERNS
        ]
    )
    return totals.select(F.lit(table_name).alias("table_name"), *(["grp"] if group else []), F.inline(cells))


def non_null_counts(df: DataFrame, table_name: str, columns: Sequence[str]) -> DataFrame:
    """``(table_name, column_name, records)``: non-null values per column in one aggregate."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column_name", "records").select(
        F.lit(table_name).alias("table_name"), "column_name", "records"
    )


def profile_table(df: DataFrame, table_name: str, techniques: Mapping[str, str] | None = None) -> DataFrame:
    """Everything the checks of a written table need, from one pass over it.

    ``(table_name, rows, column_name, records, technique, scanned, pattern,
    matches)``: a row per column and leak pattern, ``matches`` null where the
    technique exempts the column.  A single aggregate without grouping keys.
    """
    techniques = {k: (v or "NO_CHANGE").upper() for k, v in (techniques or {}).items()}
    how = {c: techniques.get(c, "NO_CHANGE") for c in df.columns}
    cells = [(c, p) for c in df.columns for p in LEAK_PATTERNS]
    hits = {i: F.count_if(leak_hit(F.col(c).cast("string"), p)) for i, (c, p) in enumerate(cells) if how[c] not in SKIPPED_TECHNIQUES}
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(df.columns)],
        *[hit.alias(f"m{i}") for i, hit in hits.items()],
    )
    place = {c: i for i, c in enumerate(df.columns)}
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"), F.col(f"n{place[c]}").alias("records"), F.lit(how[c]).alias("technique"),
                F.lit(i in hits).alias("scanned"), F.lit(p).alias("pattern"),
                (F.col(f"m{i}") if i in hits else F.lit(None)).cast("long").alias("matches"),
            )
            for i, (c, p) in enumerate(cells)
        ]
    )
    return counted.select(F.lit(table_name).alias("table_name"), "rows", F.inline(rows))
