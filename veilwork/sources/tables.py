"""Table scans and the guards around them."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.integrity import union_all

# JDBC URL forms and driver classes of the supported databases.
JDBC_DIALECTS = {
    "postgresql": ("jdbc:postgresql://{host}:{port}/{database}", "org.postgresql.Driver", 5432),
    "mysql": ("jdbc:mysql://{host}:{port}/{database}", "com.mysql.cj.jdbc.Driver", 3306),
    "sqlserver": (
        "jdbc:sqlserver://{host}:{port};databaseName={database}",
        "com.microsoft.sqlserver.jdbc.SQLServerDriver",
        1433,
    ),
    "sqlite": ("jdbc:sqlite:{database}", "org.sqlite.JDBC", None),
}


def read_table(spark: SparkSession, folder: str, name: str, fmt: str = "parquet", **options) -> DataFrame:
    """Scan ``<folder>/<name>.<fmt>`` (a file or a directory of files)."""
    return spark.read.format(fmt).options(**options).load(f"{folder.rstrip('/')}/{name}.{fmt}")


def spread_small(df: DataFrame) -> DataFrame:
    """Redistribute a scan that is planned in fewer tasks than there are cores.

    A scan is split into at least as many tasks as cores once it holds 4 MB
    (``spark.sql.files.openCostInBytes``) per core, so only a tiny input is
    ever shuffled here; a large scan is returned as it is.  For plain scans
    before row-wise heavy work (digests, patterns).  Rows are placed by a hash
    of the whole row: repeatable after a lost executor, and even under hot keys.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    return df.repartition(cores, F.xxhash64(*plain))


def jdbc_options(
    kind: str,
    database: str,
    table: str,
    host: str | None = None,
    port: int | None = None,
    user: str | None = None,
    password: str | None = None,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int | None = None,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Options for ``spark.read.format('jdbc')``.

    Parallel reads split on ``partition_column`` between ``bounds``; offset
    paging is not offered, as its chunks are undefined without an order.
    """
    if kind not in JDBC_DIALECTS:
        raise ValueError(f"database kind must be one of {sorted(JDBC_DIALECTS)}")
    template, driver, default_port = JDBC_DIALECTS[kind]
    if kind != "sqlite" and not host:
        raise ValueError(f"{kind} needs a host")
    url = template.format(host=host, port=port or default_port, database=database)
    options = {"url": url, "driver": driver, "dbtable": table, "fetchsize": str(fetch_size)}
    if user is not None:
        options["user"] = user
    if password is not None:
        options["password"] = password
    if partition_column:
        if bounds is None or not partitions:
            raise ValueError("a partitioned read needs bounds and a number of partitions")
        options.update(
            partitionColumn=partition_column,
            lowerBound=str(bounds[0]),
            upperBound=str(bounds[1]),
            numPartitions=str(partitions),
        )
    return options


def _resolved(location: str) -> tuple[str, str, str]:
    parsed = urlparse(location)
    if parsed.scheme in ("", "file"):
        return ("file", "", os.path.realpath(parsed.path))
    return (parsed.scheme.lower(), parsed.netloc.lower(), parsed.path.rstrip("/"))


def require_distinct(source: str, target: str) -> None:
    """Refuse a run that would write into its own source (same place, or one inside the other)."""
    (s1, n1, a), (s2, n2, b) = _resolved(source), _resolved(target)
    same_store = (s1, n1) == (s2, n2)
    if same_store and (a == b or a.startswith(b + "/") or b.startswith(a + "/")):
        raise ValueError(f"source and target overlap: {source} / {target}")


def choose_tables(existing: Sequence[str], wanted: str | None) -> list[str]:
    """Tables named in a comma list that exist; all tables when none is named or none exists."""
    names = {part.strip().lower() for part in (wanted or "").split(",") if part.strip()}
    hits = [t for t in existing if t.lower() in names]
    return hits or list(existing)


def choose_tables_frame(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """The same choice over two ``table_name`` frames: intersection, else everything."""
    requested = wanted.select(F.lower("table_name").alias("_w")).distinct()
    hits = existing.join(requested, F.lower("table_name") == F.col("_w"), "left_semi")
    none_found = hits.agg(F.count(F.lit(1)).alias("n")).select(F.col("n") == 0).scalar()
    return hits.unionByName(existing.filter(none_found))


def iso_text(column: Column, dtype: T.DataType) -> Column:
    """Presentation form: dates and times as ISO text, complex values as JSON text."""
    if isinstance(dtype, T.TimestampType | T.TimestampNTZType):
        return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
    if isinstance(dtype, T.DateType | T.DecimalType):
        return column.cast("string")
    if isinstance(dtype, T.ArrayType | T.MapType | T.StructType):
        return F.to_json(column)
    return column


def latest_records(df: DataFrame, limit: int = 15, order_by: str | None = None) -> DataFrame:
    """The newest rows: top ``limit`` by the first column, newest first (a top-k, not a sort)."""
    first = order_by or df.columns[0]
    rest = [F.col(f.name).asc_nulls_last() for f in df.schema.fields
            if f.name != first and not isinstance(f.dataType, T.MapType)]
    top = df.orderBy(F.col(first).desc_nulls_last(), *rest).limit(limit)
    return top.select(*[iso_text(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def inspect_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and columns per table, and a grand total in the row with a null table name."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"),
            "row_count",
            F.lit(len(df.columns)).cast("long").alias("column_count"),
        )
        for name, df in tables.items()
    ]
    return union_all(parts).rollup("table_name").agg(
        F.sum("row_count").alias("row_count"), F.sum("column_count").alias("column_count")
    )
