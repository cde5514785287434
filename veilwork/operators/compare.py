"""Whole-row comparison of two stores by a digest tree.

Rows fall into buckets by their key.  A bucket's digest is the sum of the 128-bit
digests of its rows: it does not depend on their order, repeated rows count,
and it is combined map-side.  Buckets are the leaves of a tree whose nodes hold
the sums of ``FANOUT`` children, up to one root.  Two stores are equal if their
roots are; where they are not, the comparison goes down and ends at the leaves
that differ.  Only rows of these leaves are joined.

Trees are small frames (``leaf_count`` follows the rows, about ``ROWS_PER_LEAF``
each) and can be stored: the tree of the last sync tells which leaves of a table
have changed since, without a look at the copy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FANOUT = 16
ROWS_PER_LEAF = 10_000
SUM = "decimal(38,0)"
LEVEL, NODE = "level", "node"


def leaf_level(rows: int, rows_per_leaf: int = ROWS_PER_LEAF) -> int:
    """Level of the leaves for a number of rows: the tree has ``FANOUT ** level`` of them."""
    level = 0
    while FANOUT**level * rows_per_leaf < rows:
        level += 1
    return level


def row_digests(columns: Sequence[str]) -> tuple[Column, Column]:
    """Two 64-bit digests of a row; unlike Spark's hash alone they see where a null stands."""
    nulls = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns]) if columns else F.lit("")
    return F.xxhash64(nulls, *columns), F.xxhash64(F.lit("second"), *columns, nulls)


def leaf_of(key: Sequence[str], level: int) -> Column:
    """Bucket of a key, null parts included."""
    return F.pmod(F.xxhash64(*row_key(key)), F.lit(FANOUT**level))


def row_key(key: Sequence[str]) -> list[Column]:
    return [F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in key]


def digest_tree(df: DataFrame, key: Sequence[str], level: int, columns: Sequence[str] | None = None) -> DataFrame:
    """``(level, node, n, one, two)`` of all nodes down to the leaves of ``level``.

    The rows are aggregated once, to their leaves; the levels above are sums
    of a leaf's numbers, which grow by a ``FANOUT``-th part each.
    """
    columns = sorted(df.columns if columns is None else columns)
    refuse_maps(df, columns)
    one, two = row_digests(columns)
    nodes = df.select(leaf_of(key, level).alias(NODE), one.cast(SUM).alias("one"), two.cast(SUM).alias("two"))
    leaves = nodes.groupBy(NODE).agg(F.count(F.lit(1)).alias("n"), F.sum("one").alias("one"), F.sum("two").alias("two"))
    path = F.array(*[F.struct(F.lit(i).alias(LEVEL), F.floor(F.col(NODE) / FANOUT ** (level - i)).cast("long").alias(NODE)) for i in range(level + 1)])
    up = leaves.select(F.explode(path).alias("at"), "n", "one", "two")
    return up.groupBy(f"at.{LEVEL}", f"at.{NODE}").agg(F.sum("n").alias("n"), F.sum("one").alias("one"), F.sum("two").alias("two"))


def refuse_maps(df: DataFrame, columns: Sequence[str]) -> None:
    """Maps have no defined order of entries, so equal rows could differ in their digest."""
    bad = [f.name for f in df.schema.fields if f.name in columns and isinstance(f.dataType, T.MapType)]
    if bad:
        raise TypeError(f"map columns cannot be compared: {', '.join(bad)}")


def differing_nodes(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(level, node, left_rows, right_rows)`` of the nodes whose digests differ; no row means equal stores."""
    a, b = (t.select(LEVEL, NODE, F.struct("n", "one", "two").alias(name), F.col("n").alias(f"{name}_rows")) for t, name in ((left, "left"), (right, "right")))
    both = a.join(b, [LEVEL, NODE], "full_outer").filter(~F.col("left").eqNullSafe(F.col("right")))
    return both.select(LEVEL, NODE, F.coalesce("left_rows", F.lit(0)).alias("left_rows"), F.coalesce("right_rows", F.lit(0)).alias("right_rows"))


def differing_leaves(left: DataFrame, right: DataFrame, level: int) -> DataFrame:
    """Numbers of the leaves that differ: one row each, at most one per leaf of the tree."""
    return differing_nodes(left.filter(F.col(LEVEL) == level), right.filter(F.col(LEVEL) == level)).select(NODE)


def changed_rows(old: DataFrame, new: DataFrame, key: Sequence[str], leaves: DataFrame, level: int, columns: Sequence[str] | None = None) -> DataFrame:
    """``(*key, change)`` with ``inserted``, ``updated`` or ``deleted``, over the given leaves.

    Both sides are cut down to the leaves and to their digests before they
    meet, so equal leaves are neither shuffled nor joined.  Repeated keys are
    compared as a whole: their digests are summed.
    """
    columns = sorted(new.columns if columns is None else columns)
    refuse_maps(new, columns)
    one, two = row_digests(columns)

    def inside(df: DataFrame, name: str) -> DataFrame:
        held = df.withColumn(NODE, leaf_of(key, level)).join(leaves, NODE, "left_semi")
        rows = held.select(F.struct(*key).alias("_key"), one.cast(SUM).alias("one"), two.cast(SUM).alias("two"))
        summed = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.sum("one").alias("one"), F.sum("two").alias("two"))
        return summed.select("_key", F.struct("n", "one", "two").alias(name))

    both = inside(old, "old").join(inside(new, "new"), "_key", "full_outer")
    change = F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "updated")
    return both.select("_key.*", change.alias("change")).filter("change is not null")


def compare_rows(old: DataFrame, new: DataFrame, key: Sequence[str], rows: int, columns: Sequence[str] | None = None, rows_per_leaf: int = ROWS_PER_LEAF) -> DataFrame:
    """What changed from one store to the other, by key; ``rows`` is about the size of the greater one."""
    columns = sorted(set(old.columns) & set(new.columns)) if columns is None else columns
    level = leaf_level(rows, rows_per_leaf)
    trees = [digest_tree(df, key, level, columns) for df in (old, new)]
    return changed_rows(old, new, key, differing_leaves(*trees, level), level, columns)


def extract_changed(source: DataFrame, key: Sequence[str], before: DataFrame, level: int, columns: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(rows, tree)``: rows in leaves that changed since the tree ``before``, and the tree to keep for the next time.

    Sees updates and inserts under any key, without a time column; rows of a
    changed leaf that stayed equal come along.  Deleted rows show as leaves
    with fewer rows; ``changed_rows`` against the copy names them.
    """
    tree = digest_tree(source, key, level, columns)
    leaves = differing_leaves(before, tree, level)
    return source.withColumn(NODE, leaf_of(key, level)).join(leaves, NODE, "left_semi").select(*source.columns), tree
