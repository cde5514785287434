"""The catalog: one row per column, with declared keys joined on."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "table_name string, column_name string, ordinal int, data_type string, nullable boolean"
KEYS = "table_name string, column_name string, is_pk boolean, fk_table string, fk_column string, is_unique boolean"


def columns_of(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Columns read from the schemas (metadata only, no job)."""
    rows = [
        (name, field.name, position, field.dataType.simpleString(), field.nullable)
        for name, df in tables.items()
        for position, field in enumerate(df.schema.fields, start=1)
    ]
    return spark.createDataFrame(rows, COLUMNS)


def declared_keys(spark: SparkSession, keys: Iterable[tuple]) -> DataFrame:
    """Keys as declared by the caller; files carry none."""
    return spark.createDataFrame(list(keys), KEYS)


def catalog(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """Columns with their key flags; a column without a declaration is no key."""
    joined = columns.join(keys, ["table_name", "column_name"], "left")
    return joined.select(
        *columns.columns,
        F.coalesce("is_pk", F.lit(False)).alias("is_pk"),
        "fk_table",
        "fk_column",
        F.coalesce("is_unique", F.lit(False)).alias("is_unique"),
    )


def text_columns(catalog_df: DataFrame) -> DataFrame:
    """Character columns with their declared length (null when unbounded)."""
    kind = F.lower("data_type")
    is_text = kind.startswith("string") | kind.startswith("varchar") | kind.startswith("char")
    length = F.regexp_extract(kind, r"\((\d+)\)", 1).try_cast("int")
    return catalog_df.filter(is_text).select("table_name", "column_name", "data_type", length.alias("max_length"))


def type_listing(source: DataFrame, target: DataFrame) -> DataFrame:
    """Source and target type of every column, side by side."""
    left = source.select("table_name", "column_name", F.col("data_type").alias("source_type"))
    right = target.select("table_name", "column_name", F.col("data_type").alias("target_type"))
    return left.join(right, ["table_name", "column_name"], "full_outer")
