"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

``source_targets`` shares a number of words among the sources by weight; no
source gets more than a multiple of its size, the excess is shared again.
``mix`` takes whole epochs of a source first.  What is left of its target is
filled by a weighted sample: every document draws an exponential key divided by
its quality weight, and the documents are taken in the order of their keys
until their prefix-summed words reach the budget.

The keys are functions of the document (a digest of its id), so reruns agree.
No source is ever sorted in one task: keys fall into ordered buckets, words are
summed by source and bucket, and only the bucket in which the budget ends is
sorted.  The frame that all sources share has one row per source.

Null texts have zero words, a null source is a source of its own (the last
one).  Documents without words are never taken (``taken`` is 0).  Rows that
share a document id are documents of their own; they are told apart by a digest
of their text, and equal rows by nothing: which of them is taken makes no
difference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilwork.llm.shared import WORD, table, whole, written

WEIGHTS = (5.0, 2.0, 1.0)
BUCKETS = 4096  # ordered pieces of a source; results don't depend on it


def quality_weight(text: Column) -> Column:
    """Share of the characters that are no symbols, smoothed: between 0 and 1."""
    symbols = F.regexp_count(text, F.lit(r"[#*$%&|<>!]"))
    return (1 + F.length(text) - symbols) / (1 + F.length(text)).cast("double")


def uniform(doc_id: Column) -> Column:
    """A number above 0 and up to 1, from the first 52 bits of the id's MD5 digest."""
    hexed = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 13)
    return (F.conv(hexed, 16, 10).cast("long") + 1) / F.lit(2.0**52)


def exponential_key(doc_id: Column, weight: Column) -> Column:
    """An exponential variate whose rate is the weight; the smallest keys win."""
    return -F.log(uniform(doc_id)) / F.greatest(weight, F.lit(1e-6))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row per source.

    Targets are ``min(level * weight, most * size)`` with the level at which
    they add up to ``share`` of all words.  Sources are lined up by the level
    at which they are full; the level is that of the first one that stays
    below its cap when all before it are full.
    """
    everything = W.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(everything) - 1, F.lit(len(weights))) + 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place))
    total = W.partitionBy()
    weighed = weighed.withColumns(
        {
            "cap": F.lit(float(most)) * F.col("source_size"),
            "words": F.lit(float(share)) * F.sum("source_size").over(total),
            "all_weights": F.sum("weight").over(total),
        }
    )
    full = F.col("cap") / F.col("weight")
    before = W.orderBy(full, F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    levels = weighed.withColumn(
        "level",
        (F.col("words") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.col("all_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    )
    level = F.min(F.when(F.col("level") <= full, F.struct(full.alias("full"), F.col("level")))).over(total)["level"]
    target = F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap")))
    return levels.withColumn("target", target).select("source", "source_size", "target")


def mix(
    docs: DataFrame, weight: Column | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0,
    split_last: bool = True, buckets: int = BUCKETS,
) -> DataFrame:
    """``(doc_id, tie, source, size, source_size, target, taken)``; ``tie`` is the digest of the text.

    With ``split_last`` the document in which the budget ends gives just the
    words that are missing; otherwise it is taken whole if that brings the
    source nearer to its target, else not at all.
    """
    text = whole("text")
    weight = quality_weight(text) if weight is None else weight
    key = exponential_key(F.col("doc_id"), weight)
    drawn = docs.select(
        "doc_id", "source", F.xxhash64(text).alias("tie"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), key.alias("key")
    )
    bucket = F.floor(F.lit(float(buckets)) * F.col("key") / (1 + F.col("key"))).cast("int")
    drawn = written(drawn.withColumn("bucket", bucket))  # numbers only: the text is read once
    sums = written(drawn.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    size, target = F.col("source_size"), F.col("target")
    targets = targets.withColumn("epochs", F.when(size > 0, F.floor(target / size)).otherwise(F.lit(0)).cast("long"))
    targets = targets.withColumn("budget", F.round(target - F.col("epochs") * size).cast("long"))
    t = targets.withColumnRenamed("source", "__source")
    same = lambda a: a["source"].eqNullSafe(F.col("__source"))
    order = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    ended = (
        sums.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0)))
        .join(t, same(sums))
        .where((F.col("before") < F.col("budget")) & (F.col("budget") <= F.col("before") + F.col("words")))
        .select(F.col("__source").alias("ended_source"), F.col("bucket").alias("last_bucket"), "before")
    )
    plan = t.join(ended, F.col("__source").eqNullSafe(F.col("ended_source")), "left").drop("ended_source")
    plan = written(plan)  # one row per source
    taking = drawn.join(plan, same(drawn)).drop("__source")
    inner = F.col("bucket") == F.col("last_bucket")
    base = F.col("epochs") * F.col("size")
    clear = taking.where(~F.coalesce(inner, F.lit(False))).withColumn(
        "taken", base + F.when(F.col("bucket") < F.col("last_bucket"), F.col("size")).otherwise(F.lit(0))
    )
    within = W.partitionBy("source").orderBy("key", "doc_id", "tie", "size").rowsBetween(W.unboundedPreceding, -1)
    open_words = F.col("budget") - F.col("before") - F.coalesce(F.sum("size").over(within), F.lit(0))
    part = F.least(F.greatest(F.col("open"), F.lit(0)), F.col("size"))
    if not split_last:
        part = F.when(2 * part >= F.col("size"), F.col("size")).otherwise(F.lit(0))
    partial = taking.where(inner).withColumn("open", open_words).withColumn("taken", base + part).drop("open")
    return clear.unionByName(partial).select("doc_id", "tie", "source", "size", "source_size", "target", "taken")


def op10_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Words taken from every document for sources that weigh 5, 2, 1, 5, ..."""
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
k AS (SELECT doc_id, source, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  (1 + len(t) - len(regexp_extract_all(t, '[#*$%&|<>!]')))::DOUBLE / (1 + len(t)) AS w,
  (('0x' || md5(doc_id::VARCHAR)[1:13])::BIGINT + 1) / 2.0::DOUBLE ^ 52 AS u FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight,
  2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS words FROM s),
v AS (SELECT *, sum(weight) OVER () AS aw, cap / weight AS fl FROM w),
l AS (SELECT *, (words - coalesce(sum(cap) OVER b, 0)) / (aw - coalesce(sum(weight) OVER b, 0)) AS lv FROM v
  WINDOW b AS (ORDER BY fl, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT min_by(lv, fl) AS lv FROM l WHERE lv <= fl),
t AS (SELECT source, source_size, least(cap, coalesce(m.lv * weight, cap)) AS target FROM l, m),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS ep FROM t),
r AS (SELECT *, round(target - ep * source_size)::BIGINT AS budget FROM e),
p AS (SELECT k.doc_id, k.size, r.source_size, r.target, r.ep, r.budget, coalesce(sum(k.size) OVER (PARTITION BY k.source
  ORDER BY -ln(u) / greatest(w, 1e-6), k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN r ON k.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, (ep * size + least(greatest(budget - before, 0), size))::BIGINT AS taken FROM p
"""
