"""MinHash near-dedup: universal hash minima in bands, verification, components.

Every text becomes its set of word shingles.  Texts with equal sets form one
class, represented by their least id, so copies are never paired.  Bands of the
minima of many universal hash functions bring classes together.  In a bucket
only the least class is paired with the others at first; pairs that pass the
signature check are confirmed on the full sets, and confirmed links are joined
to components.  What such a first round may have missed are pairs within a
bucket whose ends are still in different components; the second round pairs
those of them that share one of their rarest shingles early enough to be linked
at all (an exact prefix and position bound), checks them in the same way, and
the components of all links are the result.  No bucket is capped, and a large
group of texts that are alike, but not enough to be linked, is not spread out
into all its pairs.

With ``b`` bands of ``r`` rows a pair at the threshold ``t`` is brought together
with probability ``1 - (1 - t**r)**b``; ``b`` is chosen so that less than one
such pair in ten million is missed, fewer above it.

Null texts, empty texts and texts without words have the empty set and are
linked with nothing.  Rows that share an id are one node of the graph; each row
keeps its own ``n_shingles``, and all of them get the node's component.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.components import components
from veilwork.llm.shared import small, table, written

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ROWS = 5
MISSED = 1e-7
FEW_IDS = 500_000  # so many ids of eight bytes may be broadcast, counted first; beyond that texts are shuffled
SLACK = 0.20  # signatures may agree by so much less than the threshold


class _WordDigests(dict):
    """64-bit digests of words, kept while they are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def bands_for(threshold: float, rows: int = ROWS, missed: float = MISSED) -> int:
    return max(1, math.ceil(math.log(missed) / math.log(1 - threshold**rows))) if threshold < 1 else 1


def shingle_set(text: str | None, words: int, digests: dict) -> np.ndarray:
    """Sorted distinct 64-bit digests of the word shingles; A-Z count as a-z."""
    found = WORD.findall((text or "").encode().lower())  # bytes.lower changes A-Z only
    if not found:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(digests.__getitem__, found), np.uint64, len(found))
    width = min(words, len(w))
    total = np.full(len(w) - width + 1, width, np.uint64)
    for i in range(width):
        total = (total ^ w[i : len(w) - width + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return np.unique(total)


class Signer:
    """Minima of ``n`` multiply-add hashes (odd multipliers modulo 2**64) of a set."""

    def __init__(self, rows: int, bands: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        n = rows * bands
        self.rows, self.bands = rows, bands
        self.a = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, n, dtype=np.uint64)
        self.mix = rng.integers(0, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def minima(self, shingles: np.ndarray, step: int = 1024) -> np.ndarray:
        least = None
        for i in range(0, len(shingles), step):
            part = (shingles[i : i + step, None] * self.a + self.b).min(0)
            least = part if least is None else np.minimum(least, part)
        return least

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        keys = ((minima ^ (minima >> np.uint64(31))).reshape(self.bands, self.rows) * self.mix).sum(1, dtype=np.uint64)
        return (keys ^ (keys >> np.uint64(32))).astype(np.int64)


def signatures(docs: DataFrame, words: int, rows: int, bands: int) -> DataFrame:
    """``(id, n_shingles, h1, h2, bands, signature)``: set digest, band keys and one byte of each minimum."""
    schema = "id long, n_shingles long, h1 long, h2 long, bands array<long>, signature binary"

    def run(batches):
        digests, signer = _WordDigests(), Signer(rows, bands)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                n, h1, h2, keys, bytes_ = [], [], [], [], []
                for text in part.column(1).to_pylist():
                    s = shingle_set(text, words, digests)
                    n.append(len(s))
                    raw = s.tobytes()
                    h1.append(xxhash.xxh3_64_intdigest(raw) - 2**63)
                    h2.append(xxhash.xxh3_64_intdigest(raw, 7) - 2**63)
                    if len(s):
                        m = signer.minima(s)
                        keys.append(signer.band_keys(m))
                        bytes_.append((m >> np.uint64(3)).astype(np.uint8).tobytes())
                    else:
                        keys.append([])
                        bytes_.append(b"")
                arrays = [part.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(bytes_, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "n_shingles", "h1", "h2", "bands", "signature"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(run, schema)


def _alike(pairs: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose sizes and signatures allow the threshold."""
    s = signed.select("id", "n_shingles", "signature")
    a = s.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("signature").alias("sa"))
    b = s.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("signature").alias("sb"))
    sized = pairs.join(a, "a").join(b, "b").where(
        F.least("na", "nb") >= F.lit(threshold - 1e-9) * F.greatest("na", "nb")
    ).select("a", "b", "sa", "sb")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
                keep = pa.array((x == y).mean(1) >= threshold - SLACK)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return sized.mapInArrow(run, "a long, b long")


def _rare_shingles(ids: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``(id, s, n, place)`` of the given classes: the shingles that come first when rare ones, among these classes, go first.

    A set of ``n`` shingles that is linked with another shares at least ``percent`` of
    its own with it, so one of its first ``n - ceil(percent * n / 100) + 1`` is shared.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(small(written(ids), FEW_IDS), "id", "left_semi")

    def sets(batches):
        digests = _WordDigests()
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                made = [shingle_set(t, words, digests).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.list_(pa.int64()))], names=["id", "shingles"])

    each = written(texts.mapInArrow(sets, "id long, shingles array<long>").dropDuplicates(["id"]))
    single = each.select("id", F.explode("shingles").alias("s"))
    often = single.groupBy("s").agg(F.count("*").alias("often"))
    ordered = single.join(often, "s").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("often", "s"))).alias("all"))
    n = F.size("all")
    first = n - F.ceil(F.lit(percent) * n / 100 - 1e-9).cast("int") + 1
    return ordered.select("id", n.alias("n"), F.posexplode(F.slice("all", F.lit(1), first)).alias("place", "one")).where("one.often > 1").select(
        "id", F.col("one.s").alias("s"), "n", "place"
    )


def _confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs with ``100 * intersection >= percent * union`` on the full sets.

    The sets of the texts in question are made anew; each pair meets the two
    sets by joins on the ids.
    """
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    # copies of an id are one node, its set is that of the row that the class stands for
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(small(written(wanted), FEW_IDS), "id", "left_semi")

    def sets(batches):
        digests = _WordDigests()
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                made = [shingle_set(t, words, digests).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], names=["id", "shingles"])

    made = written(texts.mapInArrow(sets, "id long, shingles binary"))  # read from both sides of the pairs
    a, b = made.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), made.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, rows: int = ROWS) -> DataFrame:
    """``(id, n_shingles, component_id)``, one row per document row; rows with a null id keep a null component."""
    threshold = percent / 100
    bands = bands_for(threshold, rows)
    signed = written(signatures(docs, words, rows, bands))
    usable = signed.where((F.col("n_shingles") > 0) & F.col("id").isNotNull())
    classes = usable.groupBy("h1", "h2").agg(F.min("id").alias("rep"))
    copies = written(usable.join(classes, ["h1", "h2"]).where(F.col("id") != F.col("rep")).select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct())
    reps = usable.join(classes, (usable["h1"] == classes["h1"]) & (usable["h2"] == classes["h2"]) & (usable["id"] == classes["rep"]), "left_semi").dropDuplicates(["id", "h1", "h2"])
    reps = written(reps.select("id", "n_shingles", "bands", "signature"))
    placed = reps.select("id", F.posexplode("bands").alias("band", "value"))
    shared = placed.groupBy("band", "value").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("n > 1").drop("n")
    members = written(placed.join(shared, ["band", "value"]))

    first = members.where(F.col("id") != F.col("least")).select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    links = written(_confirmed(written(_alike(first, reps, threshold)), docs, words, percent))

    # second round: in buckets with several components, pair the members outside the least member's component
    found = components(links)
    comp = lambda side: found.select(F.col("node").alias(side), F.col("component").alias(f"{side}_c"))
    known = members.join(comp("id"), "id", "left").join(comp("least"), "least", "left")
    known = known.select("band", "value", "id", F.coalesce("id_c", "id").alias("c"), F.coalesce("least_c", "least").alias("main"))
    others = written(known.where(F.col("c") != F.col("main")))
    contested = written(known.join(others.select("band", "value").distinct(), ["band", "value"], "left_semi"))
    # two sets that are linked share one of their rare shingles, at places that leave room for the common part
    nodes = contested.groupBy("id").agg(F.first("c").alias("c"), F.max(F.col("c") != F.col("main")).alias("outside"))
    rare = written(_rare_shingles(contested.select("id").distinct(), docs, words, percent).join(nodes, "id"))
    left = rare.where("outside").select("s", F.col("id").alias("b"), F.col("c").alias("cb"), F.col("n").alias("nb"), F.col("place").alias("pb"))
    here = rare.select("s", F.col("id").alias("a"), F.col("c").alias("ca"), F.col("outside").alias("out"), F.col("n").alias("na"), F.col("place").alias("pa"))
    most = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    open_pairs = (
        left.join(
            here,
            (left["s"] == here["s"]) & (F.col("ca") != F.col("cb")) & (~F.col("out") | (F.col("a") < F.col("b")))
            & (100 * most >= percent * (F.col("na") + F.col("nb") - most)),
        )
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
        .join(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    )
    second = written(_alike(open_pairs, reps, threshold))
    more = _confirmed(second, docs, words, percent) if second.limit(1).count() else second
    final = components(copies.unionByName(links).unionByName(more)).select(F.col("node").alias("id"), F.col("component").alias("component_id"))
    out = signed.select("id", "n_shingles").join(final, "id", "left")
    return out.withColumn("component_id", F.coalesce("component_id", "id"))


def op4_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles overlap by 85 percent."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, percent=85)
    return found.select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept")
    )
