"""Phrase collocations by the partition method of Savasere, Omiecinski and Navathe (SON).

The documents are dealt to shards by a hash.  A shard is mined completely at a
support lowered in proportion to its share of the words of a language: a phrase
with the global support reaches the lowered one in at least one shard.  The
locally frequent phrases of all shards are united, and all of them are counted
again over the whole corpus, exactly and by their words.

Shards are logical: Spark counts them all at once, level by level, and a phrase
is only counted in a shard in which its first and last part, one word shorter,
are locally frequent.  Which phrases these are is held in bit tables of a fixed
size (``bits``), so what is broadcast does not grow with the corpus; a wrong bit
only lets a phrase be counted in vain, and the last count and its support
decide.  Local counts go by 64-bit hashes for the same reason: a collision can
add a candidate and never lose one.

Null texts are empty, a null language is ``und``; phrases never leave a piece.
Repeated rows count each time.  An empty table has no phrases.  Columns of
other names are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilwork.llm.shared import table, written
from veilwork.llm.words import MIXER, among, bit_table, byte_set, chunks, hashes, mixed, slot_of, words_of

SUPPORT = 30  # least count of a phrase in its language
LONGEST = 4  # words of a phrase, at most
SHARDS = 4  # logical shards; results don't depend on them
CHUNK_BYTES = 4 << 20  # texts that a task counts at once
BITS = 26  # a bit table has 2**26 bits (8 MB)
SHARD_SHIFT = 0x9E3779B1  # slots of different shards are that far apart
CLOSED_PERCENT = 80  # a phrase is dropped for a longer one with so many percent of its count
BREAKS = byte_set(*((ord(c), ord(c)) for c in ".,;:!?"), (0x0A, 0x0D))
GAPS = byte_set((0x20, 0x20), (0x09, 0x09))
ENGLISH_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
UNKNOWN = "und"


class Pieces:
    """The words of a chunk of texts, and which of them follow one another inside a piece."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        words = words_of(pc.ascii_lower(texts), BREAKS | GAPS)
        coded = words.text.dictionary_encode()
        self.vocabulary = coded.dictionary
        self.ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        lang = pc.fill_null(langs, UNKNOWN).dictionary_encode()
        self.langs = lang.dictionary
        self.lang = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[words.row]
        self.row = words.row
        piece = np.searchsorted(np.flatnonzero(BREAKS[words.data]), words.start)
        self.next = np.zeros(len(self.ids), bool)  # the next word is in the same piece
        self.next[:-1] = (piece[1:] == piece[:-1]) & (words.row[1:] == words.row[:-1])
        self.word_hash = hashes(self.vocabulary)[self.ids] if len(self.ids) else np.zeros(0, np.uint64)
        self.seed = hashes(self.langs)[self.lang] if len(self.ids) else self.word_hash

    def longer(self, keys: np.ndarray, live: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the phrases one word longer, and where their first and last parts are live."""
        n = len(keys)
        follows = np.zeros(n, bool)
        follows[:-1] = live[:-1] & live[1:] & self.next[:-1]
        grown = np.zeros(n, np.uint64)
        last = self.word_hash[size:]
        grown[: len(last)] = mixed(keys[: len(last)] * MIXER + last + np.uint64(size))
        return grown, follows

    def live(self, tables: list[np.ndarray], bits: int, shift: np.ndarray | int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For every size, the hashes and the places whose parts are all set in the tables of the sizes below."""
        keys, live = mixed(self.word_hash + self.seed), np.ones(len(self.ids), bool)
        for size in range(1, len(tables) + 2):
            yield keys, live
            if size <= len(tables):
                at = np.flatnonzero(live)
                moved = shift[at] if isinstance(shift, np.ndarray) else shift
                live = live.copy()
                live[at] = among(tables[size - 1], slots(keys[at], bits, moved))
                yield keys, live
                keys, live = self.longer(keys, live, size)

    def phrases(self, at: np.ndarray, size: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Language, words and count of the distinct phrases of ``size`` words that begin at the places."""
        code = self.lang[at]
        for k in range(size):
            code = pd.factorize(code * (len(self.vocabulary) + 1) + self.ids[at + k])[0]
        counts = np.bincount(code)
        first = np.zeros(len(counts), np.int64)
        first[code[::-1]] = at[::-1]
        words = [self.vocabulary.take(pa.array(self.ids[first + k])) for k in range(size)]
        joined = pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string())) if size > 1 else words[0]
        return self.lang[first], joined, counts


def slots(keys: np.ndarray, bits: int, shift: np.ndarray | int) -> np.ndarray:
    """As ``words.slot_of``, for arrays."""
    return ((keys >> np.uint64(24)).astype(np.int64) + shift) & ((1 << bits) - 1)


def shard_bits(shards: int) -> int:
    """How many bits the number of a shard takes."""
    return max(shards - 1, 0).bit_length()


def _arrays(tables: list) -> list[np.ndarray]:
    return [np.frombuffer(t.value, np.uint8) for t in tables]


def local_counts(docs: DataFrame, tables: list, bits: int, shards: int = SHARDS) -> DataFrame:
    """``(cell, key, count)`` of the phrases one word longer than the tables go.

    ``cell`` is a hash of the language with the shard in its last bits, so that
    rows are narrow; two languages of one hash would share a lowered support,
    which stays low enough.
    """
    low = shard_bits(shards)

    def run(batches):
        held = _arrays(tables)
        for batch in batches:
            for part in chunks(batch, 2, CHUNK_BYTES):
                pieces = Pieces(part.column(0), part.column(2))
                shard = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)[pieces.row]
                keys, live = list(pieces.live(held, bits, shard * SHARD_SHIFT))[-1]
                at = np.flatnonzero(live)
                counts = np.ones(len(at), np.int64)
                if not held:  # words recur within a chunk, phrases hardly do
                    code, names = pd.factorize(mixed(keys[at] + shard[at].astype(np.uint64)))
                    counts = np.bincount(code, minlength=len(names))
                    first = np.zeros(len(names), np.int64)
                    first[code[::-1]] = at[::-1]
                    at = first
                cell = pieces.seed[at] << np.uint64(low) | shard[at].astype(np.uint64)
                columns = [cell.astype(np.int64), keys[at].astype(np.int64), counts]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cell", "key", "count"])

    counted = docs.select("lang", "shard", "text").mapInArrow(run, "cell long, key long, count long")
    return counted.groupBy("cell", "key").agg(F.sum("count").alias("count"))


def global_counts(docs: DataFrame, tables: list, bits: int) -> DataFrame:
    """``(lang, size, phrase, a)``: exact counts of all phrases whose bits, and those of their parts, are set.

    Rows of size 0 count all words of a language.
    """

    def run(batches):
        held = _arrays(tables)
        for batch in batches:
            for part in chunks(batch, 1, CHUNK_BYTES):
                pieces = Pieces(part.column(0), part.column(1))
                words = np.bincount(pieces.lang, minlength=len(pieces.langs))
                none = [pa.array(np.zeros(len(words), np.int32)), pa.array([""] * len(words), pa.string()), pa.array(words.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([pieces.langs, *none], names=["lang", "size", "phrase", "count"])
                tested = list(pieces.live(held, bits, 0))[1::2]
                for size, (_, live) in enumerate(tested, 1):
                    lang, phrase, counts = pieces.phrases(np.flatnonzero(live), size)
                    columns = [
                        pieces.langs.take(pa.array(lang)), pa.array(np.full(len(counts), size, np.int32)),
                        phrase.cast(pa.string()), pa.array(counts.astype(np.int64)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "size", "phrase", "count"])

    counted = docs.select("lang", "text").mapInArrow(run, "lang string, size int, phrase string, count long")
    return counted.groupBy("lang", "size", "phrase").agg(F.sum("count").alias("a"))


def mine(
    docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, shards: int = SHARDS, bits: int = BITS,
    text: str = "text", lang: str = "lang", ident: str = "doc_id",
) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to ``longest`` words with the support, and the words of every language.

    ``(lang, size, phrase, a)`` and ``(lang, n)``, both written.
    """
    spark = docs.sparkSession
    shard = F.pmod(F.xxhash64(F.col(ident), F.col(text)), F.lit(shards)).cast("int")
    docs = docs.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"), shard.alias("shard"))
    low = shard_bits(shards)
    local = written(local_counts(docs, [], bits, shards))
    shares = local.groupBy("cell").agg(F.sum("count").alias("words")).withColumn("tongue", F.shiftrightunsigned("cell", low))
    n = shares.groupBy("tongue").agg(F.sum("words").alias("n"))
    lowered = F.expr(f"cast(({support} * words + n - 1) div n as long)")  # rounded up
    lowered = written(shares.join(n, "tongue").select("cell", lowered.alias("lowered")))
    tables, found = [], []
    for size in range(1, longest + 1):
        if size > 1:
            local = local_counts(docs, tables, bits, shards)
        shard_of = F.col("cell").bitwiseAND(F.lit((1 << low) - 1)).cast("int").alias("shard")
        frequent = written(local.join(lowered, "cell").where(F.col("count") >= F.col("lowered")).select(shard_of, "key"))
        found.append(frequent)
        if size < longest:
            place = F.pmod(F.shiftrightunsigned("key", 24) + F.col("shard") * F.lit(SHARD_SHIFT), F.lit(1 << bits))
            tables.append(spark.sparkContext.broadcast(bit_table(frequent.select(place.alias("slot")), bits)))
    united = [spark.sparkContext.broadcast(bit_table(f.select(slot_of(F.col("key"), bits).alias("slot")), bits)) for f in found]
    counted = written(global_counts(docs, united, bits).where((F.col("a") >= support) | (F.col("size") == 0)))
    return counted.where("size > 0"), counted.where("size = 0").select("lang", F.col("a").alias("n"))


def scored(phrases: DataFrame, scale: int = 2_000_000) -> DataFrame:
    """Phrases of two words and more with the counts and the score of their weakest cut.

    ``score = floor(scale * a / (l + r))`` in decimals, the least of all cuts;
    of equal scores that with the shortest first part.
    """
    words = F.split("phrase", " ")
    cut = phrases.where(F.col("size") > 1).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cut = cut.select(
        "lang", "size", "phrase", "a", "k",
        F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("right"),
    )
    part = lambda name, count: phrases.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    cut = cut.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    cut = cut.withColumn("score", F.expr(f"(cast(a as decimal(20,0)) * cast({scale} as decimal(18,0))) div cast(l + r as decimal(20,0))"))
    weakest = F.min(F.struct("score", "k", "l", "r")).alias("w")
    return cut.groupBy("lang", "size", "phrase", "a").agg(weakest).select("lang", "size", "phrase", "a", "w.l", "w.r", "w.score")


def closed(phrases: DataFrame, percent: int = CLOSED_PERCENT) -> DataFrame:
    """Phrases without those inside a longer one that has ``percent`` percent of their count or more."""
    words = F.split("phrase", " ")
    longer = phrases.where(F.col("size") > 2).withColumn("k", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    longer = longer.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("k") + 1)))
    inner = longer.select("lang", F.array_join(F.slice(words, F.col("at"), F.col("k")), " ").alias("phrase"), F.col("a").alias("over"))
    most = inner.groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    swallowed = F.expr(f"cast(over as decimal(20,0)) * 100 >= cast(a as decimal(20,0)) * {percent}")
    return phrases.join(most, ["lang", "phrase"], "left").where(~F.coalesce(swallowed, F.lit(False))).drop("over")


def best(phrases: DataFrame, k: int, salts: int = 64) -> DataFrame:
    """The first ``k`` of every language by score, count and phrase, with their rank.

    The candidates of one language are ranked in ``salts`` parts first, so
    that the last window gets at most ``salts * k`` rows of a language.
    """
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    salt = F.pmod(F.xxhash64("phrase"), F.lit(salts)).alias("salt")
    parted = phrases.select("*", salt).withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order)))
    ranked = parted.where(F.col("rank") <= k).withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long")).drop("salt")


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, k: int = 2000, **options) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the best collocations of every language."""
    phrases, sizes = mine(docs, support, longest, **options)
    kept = closed(scored(phrases))
    return best(kept, k).join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of two to four words of every language."""
    return collocations(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '{UNKNOWN}') AS lang,
  translate(coalesce(text, ''), '{ENGLISH_UPPER}', '{ENGLISH_UPPER.lower()}') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
  FROM w, (SELECT unnest([1, 2, 3, {LONGEST}]) AS size) WHERE len(w) >= size),
f AS (SELECT lang, size, phrase, count(*)::BIGINT AS a FROM g GROUP BY ALL HAVING count(*) >= {SUPPORT}),
c AS (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS x, unnest(range(1, size)) AS k FROM f WHERE size > 1),
s AS (SELECT c.lang, c.size, c.phrase, c.a, l.a AS l, r.a AS r, k, (2000000::HUGEINT * c.a // (l.a + r.a))::BIGINT AS score FROM c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(x[1:k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(x[k + 1:], ' ')),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.lang = m.lang AND b.size > m.size
  AND 100 * b.a::HUGEINT >= {CLOSED_PERCENT} * m.a AND contains(' ' || b.phrase || ' ', ' ' || m.phrase || ' ')))
SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM o JOIN n ON n.lang = o.lang QUALIFY rank <= 2000
"""
