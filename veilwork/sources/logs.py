"""Run logs: step and counters from log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Log keywords and the step they stand for, tested in this order.
STEP_KEYWORDS = (
    ("Connect Database", 1),
    ("Extract Schema", 2),
    ("Enterprise Detection", 3),
    ("Privacy-Safe Sampling", 4),
    ("PII Detection", 5),
    ("Policy Generation", 6),
    ("Admin Approval", 7),
    ("WAITING", 7),
    ("Change Detection", 8),
    ("Redis Hash Vault", 9),
    ("Crash Recovery", 10),
    ("Chunk Processing", 11),
    ("Data Anonymization", 12),
    ("Batch Loading", 13),
    ("Validation Approval", 14),
    ("Safe Database Generation", 15),
    ("Audit Report", 16),
    ("Output Delivery", 17),
    ("Loading and validating policy", 6),
    ("Connecting to databases", 1),
    ("Extracting source schema", 2),
    ("Determining table processing order", 2),
    ("Analyzing PK/FK relationships", 2),
    ("Creating destination schema", 15),
    ("Validating destination schema", 15),
    ("Processing table", 11),
    ("Initialize Redis mapping", 9),
    ("Chunk:", 11),
    ("Processed:", 13),
    ("to_sql", 13),
    ("append", 13),
    ("batch", 13),
    ("Validating results", 14),
    ("Validation passed", 14),
    ("Validation Engine", 14),
    ("Generating Audit & Compliance Report", 16),
    ("EXECUTION COMPLETED SUCCESSFULLY", 17),
    ("EXECUTION COMPLETED", 17),
    ("17-STEP PIPELINE COMPLETED", 17),
)


def step_of(line: Column) -> Column:
    return F.coalesce(*[F.when(line.contains(word), F.lit(step)) for word, step in STEP_KEYWORDS])


def _number(line: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(line, pattern, group).try_cast("long")


def parse_log_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """Adds step, rows processed, chunk position, batch number, table and percentage."""
    line = F.col(column)
    chunk = r"Chunk:\s*(\d+)/(\d+)"
    table = F.regexp_extract(line, r"(?i)(?:Processing|table)\s*[:]\s*(\w+)", 1)
    return lines.select(
        "*",
        step_of(line).alias("step"),
        _number(line, r"Processed:\s*(\d+)\s*rows?").alias("records_processed"),
        _number(line, chunk, 1).alias("current_chunk"),
        _number(line, chunk, 2).alias("total_chunks"),
        F.when(~line.rlike(chunk), _number(line, r"(?i)batch\s*(\d+)")).alias("batch_number"),
        F.when(table != "", table).alias("table_name"),
        _number(line, r"(\d+)%").cast("double").alias("progress"),
    )
