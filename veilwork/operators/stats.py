"""Operational statistics: technique mix, batch metrics, completeness, storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def technique_mix(policy: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Columns per technique and their share.  The window runs over one row per (group, technique)."""
    name = F.upper(F.coalesce("technique", F.lit("NO_CHANGE")))
    counts = policy.groupBy(*by, name.alias("technique")).agg(F.count(F.lit(1)).alias("columns"))
    if not by:
        total = policy.agg(F.count(F.lit(1)).alias("n")).scalar()
    else:
        total = F.sum("columns").over(Window.partitionBy(*by))
    return counts.select("*", F.bround(100 * F.col("columns") / total, 1).alias("percentage"))


def distinct_tables(policy: DataFrame) -> DataFrame:
    return policy.select("table_name").distinct()


def mean_scores(runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return runs.groupBy(*by).agg(
        F.bround(F.avg("privacy_score"), 1).alias("privacy_score"),
        F.bround(F.avg("risk_score"), 1).alias("risk_score"),
    )


def batch_metrics(log: DataFrame) -> DataFrame:
    """Metrics of a batch log per table, and over everything in the row with a null table.

    ``log``: ``table_name, kind (batch / deadlock / readonly / resume), rows, seconds``.
    One rollup; average throughput is rows over time, peak is the best batch.
    """
    batch = F.col("kind") == "batch"
    rows, seconds = F.when(batch, F.col("rows")), F.when(batch, F.col("seconds"))
    rate = F.when(batch & (F.col("seconds") > 0), F.col("rows") / F.col("seconds"))
    waits = F.when(F.col("kind") == "readonly", F.col("seconds"))
    # the grand total must stay apart from rows logged without a table
    named = log.withColumn("table_name", F.coalesce("table_name", F.lit("")))
    return named.rollup("table_name").agg(
        F.count_if(batch).alias("batches"),
        F.coalesce(F.sum(rows), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(seconds), F.lit(0.0)).alias("total_seconds"),
        F.coalesce(F.avg(seconds), F.lit(0.0)).alias("avg_seconds"),
        F.coalesce(F.try_divide(F.sum(rows), F.sum(seconds)), F.lit(0.0)).alias("avg_throughput"),
        F.coalesce(F.max(rate), F.lit(0.0)).alias("peak_throughput"),
        F.count_if(F.col("kind") == "deadlock").alias("deadlocks"),
        F.count_if(F.col("kind") == "readonly").alias("readonly_events"),
        F.coalesce(F.sum(waits), F.lit(0.0)).alias("readonly_seconds"),
        F.coalesce(F.avg(waits), F.lit(0.0)).alias("avg_readonly_seconds"),
        F.count_if(F.col("kind") == "resume").alias("resumes"),
    )


def completeness(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """Row counts against targets: state, percentage and what is missing."""
    joined = counts.join(targets, "table_name", "left")
    n, goal = F.col("row_count"), F.coalesce("target", F.lit(0))
    state = (
        F.when((goal > 0) & (n >= goal), "complete").when((goal > 0) & (n > 0), "partial").otherwise("not_started")
    )
    return joined.select(
        "table_name",
        "row_count",
        goal.alias("target"),
        state.alias("state"),
        F.when(goal > 0, F.bround(n / goal * 100, 1)).alias("percentage"),
        F.greatest(goal - n, F.lit(0)).alias("remaining"),
    )


def storage_projection(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Average row size over all tables times the target rows of each, with a total (null table)."""
    average = sizes.agg((F.sum("bytes") / F.sum("row_count")).alias("a")).scalar()
    projected = targets.select("table_name", "target", (F.col("target") * average).alias("bytes"))
    return projected.rollup("table_name").agg(
        F.sum("target").alias("target"), F.round(F.sum("bytes") / 1024 / 1024, 2).alias("estimated_mb")
    )


def text_bytes(df: DataFrame) -> Column:
    """Size of a row as text, used where the storage reports no size of its own."""
    return sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(0))
