"""Samples for profiling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.digests import digest52

NULL_TEXT = "NULL"


def random_sample(df: DataFrame, n: int = 20, seed: int = 0, key: Sequence[str] | None = None) -> DataFrame:
    """``n`` rows in random order.

    With a key the order is a digest of (seed, key): the same rows come back
    whatever the partitioning.  Without one it is ``rand(seed)``, repeatable
    only while the partitioning stays.  Either way each task keeps ``n`` rows.
    """
    if not key:
        return df.orderBy(F.rand(seed)).limit(n)
    draw = digest52(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    return df.orderBy(draw, *key).limit(n)


def sample_texts(df: DataFrame, n: int = 20, seed: int = 0, key: Sequence[str] | None = None) -> DataFrame:
    """A random sample with every value as text and null written out."""
    picked = random_sample(df, n, seed, key)
    return picked.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit(NULL_TEXT)).alias(c) for c in df.columns]
    )


def head_sample(df: DataFrame, column: str, n: int = 10, order_by: Sequence[str] = ()) -> DataFrame:
    """First ``n`` values of one column, in key order when one is given."""
    ordered = df.orderBy(*order_by) if order_by else df
    return ordered.limit(n).select(column)
