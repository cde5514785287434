"""Connected components by alternating large-star and small-star over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.shared import written


def _with_least(links: DataFrame) -> DataFrame:
    """Add to each ``(a, b)`` the least of ``a`` and its neighbours.

    The minimum is aggregated map-side, one row per node; the join back has
    both sides shuffled by the node, so that Spark can split hot nodes.
    """
    least = links.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return links.join(least, "a")


def large_star(links: DataFrame) -> DataFrame:
    """Hang every greater neighbour on the least node of the neighbourhood."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(links: DataFrame) -> DataFrame:
    """Hang every smaller neighbour, and the node itself, on the least smaller neighbour."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b"))
    least = _with_least(down)
    hung = least.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` of all nodes that occur in links; the component is its least node.

    The links of each round are written to the shared folder, so a lost
    executor costs at most one round.  The rounds end when the links no longer
    change, which is seen by their number and the sum of a digest.
    """
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a") != F.col("b")).distinct()
    links, last = written(small_star(links)), None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(now) == last or not now[0]:
            break
        last = tuple(now)
        links = written(small_star(large_star(links)))
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
