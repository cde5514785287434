"""Change events from SQL statement text (batch or streaming frames)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the table a data-changing statement writes to.
TABLE_REGEX = r"(?i)(?:INSERT\s+INTO|UPDATE|DELETE\s+FROM)\s+[\"`]?([a-zA-Z0-9_-]+)[\"`]?"
OPERATIONS = ("INSERT", "UPDATE", "DELETE")


def change_events(statements: DataFrame, text: str = "statement", key: str = "first_parameter") -> DataFrame:
    """``table_name, operation, primary_key`` of every INSERT, UPDATE and DELETE; others are dropped."""
    head = F.upper(F.trim(text))
    operation = F.coalesce(*[F.when(head.startswith(op), F.lit(op)) for op in OPERATIONS])
    table = F.lower(F.regexp_extract(text, TABLE_REGEX, 1))
    return (
        statements.select(
            "*",
            table.alias("table_name"),
            operation.alias("operation"),
            F.coalesce(F.col(key).cast("string"), F.lit("auto")).alias("primary_key"),
            F.lit("queued").alias("status"),
        )
        .filter(operation.isNotNull() & (table != ""))
    )
