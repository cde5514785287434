"""Run-history files of all tenants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_SCHEMA = (
    "run_id string, version string, is_current boolean, timestamp string, table_name string, status string,"
    "records_anonymized long, privacy_score double, risk_score double, risk_level string,"
    "techniques_summary string, total_columns int, policy_snapshot struct<version:string,created_at:string,"
    "column_policies:array<struct<table_name:string,column_name:string,is_pii:boolean,pii_type:string,"
    "anonymization_technique:string>>>"
)


def read_histories(spark: SparkSession, pattern: str, prefix: str = "run_history_") -> DataFrame:
    """Every matching file; the part of the file name after ``prefix`` is the tenant."""
    runs = spark.read.schema(RUN_SCHEMA).json(pattern, multiLine=True)
    tenant = F.regexp_extract(F.input_file_name(), rf"{prefix}([^/]*)\.json$", 1)
    return runs.select(tenant.alias("user_id"), "*")


def snapshot_columns(runs: DataFrame) -> DataFrame:
    """The column policies frozen with each run, one row each."""
    return runs.select(
        "user_id", "run_id", "timestamp", F.explode("policy_snapshot.column_policies").alias("c")
    ).select(
        "user_id", "run_id", "timestamp", "c.table_name", "c.column_name", "c.is_pii", "c.pii_type",
        F.upper(F.coalesce("c.anonymization_technique", F.lit("NO_CHANGE"))).alias("technique"),
    )
