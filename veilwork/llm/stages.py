"""The stages of ``corpus_pipeline``: ``(spark, docs, sf_dir) -> DataFrame`` with the columns of documents.

All keep extra columns, and each defines what null and empty texts become.
``n_chars``, if present, follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm import bpe, langid, lines, minhash, mixing
from veilwork.llm.shared import whole, written


REST = "__rest"


def packed(docs: DataFrame, *named: str) -> DataFrame:
    """The named columns, and all others as one struct: whatever they are called, operators don't meet them."""
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in named]
    return docs.select(*named, F.struct(F.lit(0).alias("none"), *others).alias(REST))


def unpacked(found: DataFrame, docs: DataFrame, *named: str) -> DataFrame:
    """The columns of ``docs`` again, from packed rows."""
    return found.select(*[F.col(c) if c in named else F.col(f"{REST}.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which no language can be recognized: null texts and texts without letters.

    The kept rows are unchanged; ``lang`` stays as declared.
    """
    judged = langid.identify(packed(docs, "text"), langid.fit(docs.select("doc_id", "text", "lang")), keep=("text", REST))
    return unpacked(judged.where(F.col("lang_pred") != langid.UNKNOWN), docs, "text")


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take lines out that an earlier line of the corpus equals or nearly equals; no row goes."""
    out = unpacked(lines.dedup_lines(packed(docs, "doc_id", "text"), words=lines.WORDS), docs, "doc_id", "text")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each group of near copies (five-word shingles, similarity 0.8).

    Documents without words are in no group and stay, as do rows without an
    id.  Rows that share an id are documents of their own, told apart by a
    128-bit digest of their text: different ones stay unless they are near
    copies of something, of equal ones one row stays (any, they differ in
    extra columns at most).  Within a group the least id wins, then the least
    digest.
    """
    text = whole("text")
    rows = packed(docs, "doc_id", "text").withColumns({"__a": F.xxhash64(text), "__b": F.xxhash64(F.lit("b"), text)})
    row = ["doc_id", "__a", "__b"]
    several = rows.where(F.col("doc_id").isNotNull()).groupBy(*row).count().groupBy("doc_id")
    several = written(several.agg(F.sum("count").alias("n"), F.collect_set(F.struct("__a", "__b")).alias("forms")).where("n > 1"))
    if several.isEmpty():
        found = minhash.near_duplicates(rows.select("doc_id", "text"), words=5, percent=80)
        gone = found.where(F.col("component_id") != F.col("id")).select(F.col("id").alias("doc_id")).distinct()
        return unpacked(rows.join(gone, "doc_id", "left_anti"), docs, "doc_id", "text")
    # rows that share an id get numbers beyond all ids for the search
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    forms = several.select("doc_id", F.explode("forms").alias("f")).select("doc_id", F.col("f.__a").alias("__a"), F.col("f.__b").alias("__b"))
    number = F.monotonically_increasing_id()
    forms = written(forms.withColumn("node", F.lit(high) + 1 + number if high < 1 << 62 else F.lit(low) - 1 - number))
    named = rows.join(forms, row, "left").withColumn("node", F.coalesce("node", F.col("doc_id").cast("long")))
    named = written(named)
    found = minhash.near_duplicates(named.select(F.col("node").alias("doc_id"), "text"), words=5, percent=80)
    own = found.select(F.col("id").alias("node"), "component_id").distinct().join(forms, "node", "left")
    rank = F.struct(F.coalesce("doc_id", "node").alias("id"), "__a", "__b", "node")
    first = own.groupBy("component_id").agg(F.min(rank)["node"].alias("node")).select("node")
    kept = named.where(F.col("node").isNull()).unionByName(named.join(first, "node", "left_semi").dropDuplicates(["node"]))
    return unpacked(kept, docs, "doc_id", "text")


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop whole documents so that the sources' words come near their targets.

    A document that the mix takes twice is in the result twice; documents
    without words are not taken.
    """
    named = packed(docs, "doc_id", "text", "source").withColumn("__key", F.xxhash64(whole("text")))
    mixed = mixing.mix(named.select("doc_id", "text", "source"), split_last=False)
    # equal rows (same id, text and source) are taken as often as their sum says
    times = mixed.groupBy(F.col("doc_id").alias("__id"), F.col("tie").alias("__tie"), F.col("source").alias("__source")).agg(
        F.sum((F.col("taken") / F.greatest("size", F.lit(1))).cast("long")).alias("__times"), F.count("*").alias("__rows")
    )
    same = (
        named["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__tie")) & named["source"].eqNullSafe(F.col("__source"))
    )
    copies = (F.col("__times") / F.col("__rows")).cast("int")
    joined = named.join(times.where(F.col("__times") > 0), same)
    taken = joined.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.greatest(copies, F.lit(1)))))
    return unpacked(taken, docs, "doc_id", "text", "source")


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, n_tokens, ids, decoded_sha256`` of every row."""
    ranks, pattern = bpe.vocabulary()
    return bpe.encode(docs.select("doc_id", "source", "text"), ranks, pattern, keep=("doc_id", "source"), outputs=("n_tokens", "ids", "decoded_sha256"))

