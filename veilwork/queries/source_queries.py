"""Scans, inspection, search, logs and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import search, stats
from ..sources import logs, tables
from .derived import cte, frame
from .registry import q, query

NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)
WIDTHS = {
    "region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6,
    "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4,
}


@query("table_scan", "SELECT * FROM orders")
def table_scan(t):
    return t.orders


@query("column_scan", "SELECT c_name FROM customer")
def column_scan(t):
    return t.customer.select("c_name")


@query(
    "inspect_tables",
    "WITH s AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count, {w}::bigint AS column_count FROM {n}" for n, w in WIDTHS.items())
    + ") SELECT * FROM s UNION ALL SELECT NULL, sum(row_count)::bigint, sum(column_count)::bigint FROM s",
)
def inspect_tables(t):
    """Rows and columns of every table, and the totals."""
    return tables.inspect_tables({n: getattr(t, n) for n in NAMES})


@query(
    "latest_records",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, user_id, event_type, value, props FROM events ORDER BY event_id DESC LIMIT 15""",
)
def latest_records(t):
    """The newest 15 records of a table, presentation form (a top-k view)."""
    return tables.latest_records(t.events)


@query(
    "target_tables",
    """WITH e AS (SELECT DISTINCT source AS table_name FROM documents),
    w AS (SELECT DISTINCT upper(source) AS s FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND quality = 1)
    SELECT table_name FROM e WHERE upper(table_name) IN (SELECT s FROM w) OR NOT EXISTS (SELECT 1 FROM e WHERE upper(table_name) IN (SELECT s FROM w))""",
)
def target_tables(t):
    """Requested tables that exist; all when none does."""
    existing = t.documents.select(F.col("source").alias("table_name")).distinct()
    flagged = t.labels.filter("toxic = 1 and quality = 1").select("doc_id")
    wanted = t.documents.join(flagged, "doc_id", "left_semi").select(F.upper("source").alias("table_name"))
    return tables.choose_tables_frame(existing, wanted)


@query(
    "target_tables_fallback",
    "SELECT DISTINCT source AS table_name FROM documents",
)
def target_tables_fallback(t):
    """No requested table exists: all of them are taken."""
    existing = t.documents.select(F.col("source").alias("table_name")).distinct()
    wanted = t.part.select(F.col("p_brand").alias("table_name"))
    return tables.choose_tables_frame(existing, wanted)


@query(
    "any_column_search",
    """SELECT doc_id, lang, source FROM documents WHERE contains(lower(concat_ws(chr(1), doc_id, text, lang, source, n_chars)), 'mail5')""",
)
def any_column_search(t):
    return search.any_column_contains(t.documents, "Mail5").select("doc_id", "lang", "source")


_STEPS = " ".join(f"WHEN contains(line, {q(word)}) THEN {step}" for word, step in logs.STEP_KEYWORDS)


@query(
    "parse_log_lines",
    cte("log_lines")
    + rf"""SELECT seq, (CASE {_STEPS} END)::int AS step,
    try_cast(regexp_extract(line, 'Processed:\s*(\d+)\s*rows?', 1) AS bigint) AS records_processed,
    try_cast(regexp_extract(line, 'Chunk:\s*(\d+)/(\d+)', 1) AS bigint) AS current_chunk,
    try_cast(regexp_extract(line, 'Chunk:\s*(\d+)/(\d+)', 2) AS bigint) AS total_chunks,
    CASE WHEN NOT regexp_matches(line, 'Chunk:\s*(\d+)/(\d+)') THEN try_cast(regexp_extract(line, '(?i)batch\s*(\d+)', 1) AS bigint) END AS batch_number,
    nullif(regexp_extract(line, '(?i)(?:Processing|table)\s*[:]\s*(\w+)', 1), '') AS table_name,
    try_cast(regexp_extract(line, '(\d+)%', 1) AS double) AS progress FROM log_lines""",
)
def parse_log_lines(t):
    return logs.parse_log_lines(frame(t, "log_lines")).drop("line")


@query(
    "union_of_tenants",
    """SELECT 'customer' AS tenant, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier""",
)
def union_of_tenants(t):
    """Rows of all tenants in one frame."""
    parts = [
        t.customer.select(F.lit("customer").alias("tenant"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name")),
        t.supplier.select(F.lit("supplier").alias("tenant"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")),
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "completeness",
    """WITH c AS (SELECT source AS table_name, count(*) AS row_count FROM documents GROUP BY source),
    g AS (SELECT source AS table_name, count(*) FILTER (WHERE lang = 'en') * 2 AS target FROM documents WHERE n_chars > 500 GROUP BY source)
    SELECT c.table_name, row_count, coalesce(target, 0)::bigint AS target,
    CASE WHEN target > 0 AND row_count >= target THEN 'complete' WHEN target > 0 AND row_count > 0 THEN 'partial' ELSE 'not_started' END AS state,
    CASE WHEN target > 0 THEN round_even(row_count / target::double * 100, 1) END AS percentage,
    greatest(coalesce(target, 0) - row_count, 0)::bigint AS remaining FROM c LEFT JOIN g USING (table_name)""",
)
def completeness(t):
    """Row counts per source against a target per source."""
    counts = t.documents.groupBy(F.col("source").alias("table_name")).agg(F.count(F.lit(1)).alias("row_count"))
    targets = (
        t.documents.filter("n_chars > 500")
        .groupBy(F.col("source").alias("table_name"))
        .agg((F.count_if(F.col("lang") == "en") * 2).alias("target"))
    )
    return stats.completeness(counts, targets)


@query(
    "storage_projection",
    """WITH s AS (SELECT source AS table_name, count(*) AS row_count, sum(strlen(text))::bigint AS bytes FROM documents GROUP BY source),
    g AS (SELECT source AS table_name, count(*) * 1000 AS target FROM documents GROUP BY source),
    a AS (SELECT sum(bytes)::double / sum(row_count) AS a FROM s),
    p AS (SELECT table_name, target, target * a AS bytes FROM g, a)
    SELECT table_name, target::bigint AS target, round(bytes / 1024 / 1024, 2) AS estimated_mb FROM p
    UNION ALL SELECT NULL, sum(target)::bigint, round(sum(bytes) / 1024 / 1024, 2) FROM p""",
)
def storage_projection(t):
    """Average row size times target rows."""
    by_source = t.documents.groupBy(F.col("source").alias("table_name"))
    sizes = by_source.agg(F.count(F.lit(1)).alias("row_count"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    targets = by_source.agg((F.count(F.lit(1)) * 1000).alias("target"))
    return stats.storage_projection(sizes, targets)
