"""Keys and references: orphans, violations, subsets, comparisons.

Foreign keys may be badly skewed (one parent with a third of all children), so
every check first reduces the child to one row per key, map-side, and only then
joins.  Anti joins run on non-null keys, which avoids the null-aware form.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Relation:
    child: str
    child_key: str
    parent: str
    parent_key: str

    @property
    def name(self) -> str:
        return f"{self.child}.{self.child_key} -> {self.parent}.{self.parent_key}"


def union_all(parts: Iterable[DataFrame]) -> DataFrame:
    """Union by name, built pairwise: every step is analyzed again, so a chain would cost n squared."""
    level = list(parts)
    while len(level) > 1:
        pairs = [level[i : i + 2] for i in range(0, len(level), 2)]
        level = [p[0].unionByName(p[1]) if len(p) == 2 else p[0] for p in pairs]
    return level[0]


def key_counts(df: DataFrame, key: str, out: str = "n") -> DataFrame:
    return df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias(out))


def parent_keys(parent: DataFrame, key: str) -> DataFrame:
    return parent.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"))


def orphan_keys(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child keys without a parent, with their number of rows: ``(key, n)``."""
    return key_counts(child, child_key).join(parent_keys(parent, parent_key), "key", "left_anti")


def count_orphans(tables: Mapping[str, DataFrame], relation: Relation, count_nulls: bool = False) -> DataFrame:
    """One row ``(relation, orphans)``; null keys are no orphans unless asked for."""
    child, parent = tables[relation.child], tables[relation.parent]
    lost = orphan_keys(child, relation.child_key, parent, relation.parent_key).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("orphans")
    )
    if count_nulls:
        nulls = child.filter(F.col(relation.child_key).isNull()).agg(F.count(F.lit(1)).alias("orphans"))
        lost = lost.unionByName(nulls).agg(F.sum("orphans").alias("orphans"))
    return lost.select(F.lit(relation.name).alias("relation"), "orphans")


def orphan_report(
    tables: Mapping[str, DataFrame], relations: Sequence[Relation], count_nulls: bool = False
) -> DataFrame:
    """Orphans of every relation, and the grand total in the row with a null relation."""
    rows = union_all(count_orphans(tables, r, count_nulls) for r in relations)
    return rows.rollup("relation").agg(F.sum("orphans").alias("orphans"))


def top_orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, n: int = 10) -> DataFrame:
    """The orphan keys with the most rows; the key breaks ties."""
    return orphan_keys(child, child_key, parent, parent_key).orderBy(F.desc("n"), "key").limit(n)


def key_violations(tables: Mapping[str, DataFrame], primary_keys: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per table: rows with a null in the primary key, duplicated keys, and rows beyond the first.

    One aggregate per key and then a sum; no group is ever held as rows.
    """
    parts = []
    for table, key in primary_keys.items():
        per_key = tables[table].groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        has_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
        parts.append(
            per_key.agg(
                F.coalesce(F.sum(F.when(has_null, F.col("n"))), F.lit(0)).alias("null_keys"),
                F.count_if(~has_null & (F.col("n") > 1)).alias("duplicate_keys"),
                F.coalesce(F.sum(F.when(~has_null, F.col("n") - 1)), F.lit(0)).alias("surplus_rows"),
            ).select(F.lit(table).alias("table_name"), "*")
        )
    return union_all(parts)


def null_keys(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.count_if(F.col(key).isNull()).alias("null_keys"))


def key_probe(
    keys: DataFrame, parent: DataFrame, parent_key: str, child: DataFrame, child_key: str
) -> DataFrame:
    """For each asked key: is it in the parent, and how many children has it?"""
    found = parent_keys(parent, parent_key).distinct().withColumn("_hit", F.lit(True))
    children = key_counts(child, child_key, "children")
    return (
        keys.join(found, "key", "left")
        .join(children, "key", "left")
        .select(
            "key",
            F.coalesce("_hit", F.lit(False)).alias("in_parent"),
            F.coalesce("children", F.lit(0)).alias("children"),
        )
    )


def unseen_rows(source: DataFrame, key: str, seen: DataFrame, seen_key: str) -> DataFrame:
    """Rows whose key is not in the seen set."""
    known = seen.select(F.col(seen_key).alias("_seen")).distinct()
    return source.join(known, F.col(key) == F.col("_seen"), "left_anti")


def compare_keys(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Presence of every key in two stores: ``(key, in_left, in_right)``."""
    a = parent_keys(left, left_key).distinct().withColumn("in_left", F.lit(True))
    b = parent_keys(right, right_key).distinct().withColumn("in_right", F.lit(True))
    return a.join(b, "key", "full_outer").select(
        "key",
        F.coalesce("in_left", F.lit(False)).alias("in_left"),
        F.coalesce("in_right", F.lit(False)).alias("in_right"),
    )


def compare_extent(stores: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Count, least and greatest key of each store, one row per store."""
    return union_all(
        df.agg(
            F.count(F.lit(1)).alias("row_count"), F.min(key).alias("min_key"), F.max(key).alias("max_key")
        ).select(F.lit(name).alias("store"), "*")
        for name, (df, key) in stores.items()
    )


def first_by_key(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` rows by key."""
    return df.orderBy(key).limit(n)


def keep_children(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Children of kept parents.

    A semi join streams the child; when one parent owns much of the child, AQE
    splits that parent's partition, and a kept set below the broadcast
    threshold is broadcast after its size was measured.
    """
    kept = parent.select(F.col(parent_key).alias("_kept"))
    return child.join(kept, F.col(child_key) == F.col("_kept"), "left_semi")


def referential_subset(
    tables: Mapping[str, DataFrame],
    root: str,
    keys: Mapping[str, str],
    relations: Sequence[Relation],
    n: int,
) -> dict[str, DataFrame]:
    """Keep the first ``n`` roots, their children, then the first ``n`` of those, and so on."""
    kept = {root: first_by_key(tables[root], keys[root], n)}
    for r in relations:
        own = keep_children(tables[r.child], r.child_key, kept[r.parent], r.parent_key)
        kept[r.child] = first_by_key(own, keys[r.child], n)
    return kept


def load_levels(tables: Iterable[str], edges: Iterable[tuple[str, str]]) -> list[tuple[str, int]]:
    """Load order of a few declared tables: ``(table, level)``, parents before children.

    Tables in a cycle, and those behind one, share one last level; a table
    that references itself is no cycle.
    """
    waiting = {t: set() for t in tables}
    for child, parent in edges:
        if child in waiting and parent in waiting and child != parent:
            waiting[child].add(parent)
    done: set[str] = set()
    result, level = [], 0
    while waiting:
        ready = [t for t, parents in waiting.items() if parents <= done] or list(waiting)
        result += [(t, level) for t in sorted(ready)]
        done.update(ready)
        for t in ready:
            del waiting[t]
        level += 1
    return result


def load_order_of(tables: DataFrame, edges: DataFrame) -> DataFrame:
    """``(table_name, level)`` from ``tables (table_name)`` and ``edges (child, parent)``, as a frame.

    A recursive query follows the edges from every table.  A table's level is
    its longest way from a table without parents.  A way as long as there are
    tables must repeat one: such tables are in a cycle or behind one, and
    share the level after all others.  Bounded by the schema, never by rows.
    """
    spark = tables.sparkSession
    return spark.sql(
        """
        WITH RECURSIVE known AS (SELECT DISTINCT table_name FROM {tables}),
        steps AS (SELECT DISTINCT child, parent FROM {edges} JOIN known a ON a.table_name = child JOIN known b ON b.table_name = parent
          WHERE child <> parent),
        ways(table_name, level) AS (
          SELECT table_name, 0 FROM known
          UNION ALL
          SELECT steps.child, ways.level + 1 FROM ways JOIN steps ON steps.parent = ways.table_name
          WHERE ways.level < (SELECT count(*) FROM known)),
        longest AS (SELECT table_name, max(level) AS level FROM ways GROUP BY table_name),
        total AS (SELECT (SELECT count(*) FROM known) AS n, coalesce((SELECT max(level) FROM longest WHERE level < (SELECT count(*) FROM known)), -1) AS last)
        SELECT table_name, cast(CASE WHEN level < (SELECT n FROM total) THEN level ELSE (SELECT last + 1 FROM total) END AS int) AS level FROM longest
        """,
        tables=tables,
        edges=edges,
    )


def load_order(catalog: DataFrame) -> DataFrame:
    """Load levels of the tables in a catalog with declared foreign keys."""
    edges = catalog.filter("fk_table is not null").select(F.col("table_name").alias("child"), F.col("fk_table").alias("parent"))
    return load_order_of(catalog.select("table_name"), edges)
