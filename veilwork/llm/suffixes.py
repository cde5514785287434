"""Suffix-array dedup: bytes covered by a long string that starts anywhere else are removed.

A window is a string of ``size`` bytes inside a document.  It is repeated if
an equal window starts elsewhere, in the same document or another.  Sorting
the suffixes at all places would move every byte ``size`` times, so windows are
first gathered at anchors: the anchor of a window is the leftmost of its
``GRAM``-byte grams with the least digest.  It depends on the window's bytes
alone, so equal windows have equal anchors at the same distance, and all
windows of one anchor lie in one stretch of bytes, its context.

1. Anchors are counted by gram and context.  A context that occurs twice is
   repeated as a whole and needs no sorting.
2. Where a gram has several different contexts, one of each is kept.  Every
   task sorts the suffixes that start at its anchors into runs, front-codes
   them (length of the prefix shared with the suffix before, and the rest) and
   sends each run to the task of its gram.
3. That task merges the runs with a loser tree.  Every head carries the length
   of the prefix it shares with the last winner; heads with different lengths
   are ordered by these alone, and equal ones compare bytes from there on, so
   no known prefix is compared again.  The result is the sorted suffix array of
   the gram with its common prefix lengths.
   A gram with more than ``HOT`` contexts would be too much for one task.  Its
   contexts are not sorted: each sends a 128-bit digest of every window, and
   digests are counted map-side.  A context keeps the windows that occur once.
4. Two contexts share a window exactly if the common part to the right of the
   anchor and the common part to the left of it add up to ``size``; the windows
   of a context that are repeated cover one interval around its anchor.
5. Intervals go back to all anchors of their context, and each document drops
   the bytes in the union of its intervals.

Texts are taken as UTF-8 bytes, null as empty.  Documents shorter than a window
lose nothing.  Repeated rows are documents of their own and lose what they
share.  No text is cut: long documents are anchored in overlapping stretches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.shared import table, whole, written

SIZE = 200
GRAM = 32
STRETCH = 1 << 22  # bytes anchored at once; places within a stretch fit into 24 bits
RUN_BYTES = 1 << 20  # bytes of a front-coded run
PART_SUFFIXES = 20_000  # suffixes that a merging task is meant to get
HOT = 2_000  # contexts of one gram that a merging task gets at most
SALTS = 64  # tasks over which the contexts of a hot gram are dealt

_BYTES = np.random.default_rng(20).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def gram_digests(data: np.ndarray, width: int = GRAM) -> np.ndarray:
    """Polynomial digests of all ``width``-byte grams (a power of two), built by doubling, then mixed."""
    h, power, span = _BYTES[data], _BASE, 1
    while span < width:
        h = h[:-span] * np.uint64(power) + h[span:]
        power, span = power * power % 2**64, span * 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def anchors(text: bytes, size: int = SIZE) -> tuple[np.ndarray, ...]:
    """``(gram digest, anchor, first window, last window)`` of all anchors of a text."""
    out = [[], [], [], []]
    for begin in range(0, max(0, len(text) - size + 1), STRETCH):
        data = np.frombuffer(text, np.uint8, min(len(text) - begin, STRETCH + size - 1), begin)
        h = gram_digests(data)
        # packed with the place, the least value is the leftmost of the least digests
        packed = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        grams, span = size - GRAM + 1, 1
        while 2 * span <= grams:
            packed = np.minimum(packed[:-span], packed[span:])
            span *= 2
        if span < grams:
            packed = np.minimum(packed[: len(packed) - (grams - span)], packed[grams - span :])
        at = (packed & np.uint64(0xFFFFFF)).astype(np.int64)
        edges = np.flatnonzero(np.diff(at)) + 1
        low, high = np.r_[0, edges], np.r_[edges, len(at)] - 1
        for column, values in zip(out, (h[at[low]].view(np.int64), at[low] + begin, low + begin, high + begin), strict=True):
            column.append(values)
    return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)


def anchor_rows(docs: DataFrame, size: int) -> DataFrame:
    """``(doc_id, h, gram, context, at, low, high)`` of all anchors; ``low``, ``high``: first and last window's distance."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                counts, columns, contexts = [], ([], [], [], []), []
                for text in part.column(2).to_pylist():
                    raw = text.encode()
                    found = anchors(raw, size)
                    counts.append(len(found[0]))
                    for c, v in zip(columns, found, strict=True):
                        c.append(v)
                    contexts += [
                        xxhash.xxh3_64_intdigest(raw[a:b]) - 2**63 for a, b in zip(found[2].tolist(), (found[3] + size).tolist(), strict=True)
                    ]
                gram, at, low, high = (np.concatenate(c) for c in columns)
                take = pa.array(np.repeat(np.arange(len(counts)), counts))
                arrays = [part.column(0).take(take), part.column(1).take(take), pa.array(gram), pa.array(contexts, pa.int64()), pa.array(at)]
                arrays += [pa.array((at - low).astype(np.int32)), pa.array((at - high).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "h", "gram", "context", "at", "before", "after"])

    named = docs.select("doc_id", F.xxhash64(whole("text")).alias("h"), whole("text").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return named.mapInArrow(run, f"doc_id {kind}, h long, gram long, context long, at long, before int, after int")


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known to be equal."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8 if x else n


def front_code(suffixes: list[tuple]) -> bytes:
    """Sorted ``(right, left, context)`` as shared lengths and rests."""
    out, last = [], b""
    for right, left, context in suffixes:
        shared = common(last, right)
        out.append(np.array([shared, len(right) - shared, len(left)], "<u2").tobytes() + context.to_bytes(8, "little", signed=True))
        out.append(right[shared:])
        out.append(left)
        last = right
    return b"".join(out)


def front_decode(run: bytes):
    """``(shared length, right, left, context)`` in order."""
    at, last, size = 0, b"", len(run)
    while at < size:
        shared, rest, left = int.from_bytes(run[at : at + 2], "little"), int.from_bytes(run[at + 2 : at + 4], "little"), int.from_bytes(run[at + 4 : at + 6], "little")
        context = int.from_bytes(run[at + 6 : at + 14], "little", signed=True)
        at += 14
        last = last[:shared] + run[at : at + rest]
        at += rest
        yield shared, last, run[at : at + left], context
        at += left


class LoserTree:
    """Merges front-coded sorted runs; yields ``(prefix shared with the suffix before, right, left, context)``.

    Each head knows the prefix it shares with the last winner that passed its
    place.  In a match of two heads the longer shared prefix is the smaller
    string; only equal lengths look at bytes, and only behind that length.  The
    loser keeps the length it shares with the winner.
    """

    def __init__(self, runs: list[bytes]):
        self.streams = [front_decode(r) for r in runs]
        self.heads = [next(s, None) for s in self.streams]
        self.shared = [0] * len(runs)
        width = 1
        while width < len(runs):
            width *= 2
        self.width, self.losers = width, [-1] * width
        winners = [-1] * width + [i if i < len(runs) and self.heads[i] else -1 for i in range(width)]
        for node in range(width - 1, 0, -1):
            winners[node], self.losers[node] = self._match(winners[2 * node], winners[2 * node + 1])
        self.top = winners[1] if width > 1 else (0 if runs and self.heads[0] else -1)

    def _match(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two heads (-1: an empty run)."""
        if a < 0 or b < 0:
            return (b, a) if a < 0 else (a, b)
        x, y = self.shared[a], self.shared[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        left, right = self.heads[a][1], self.heads[b][1]
        n = common(left, right, x)
        if left[n : n + 1] <= right[n : n + 1]:
            self.shared[b] = n
            return a, b
        self.shared[a] = n
        return b, a

    def __iter__(self):
        while self.top >= 0:
            run = self.top
            head = self.heads[run]
            yield (self.shared[run], *head[1:])
            self.heads[run] = next(self.streams[run], None)
            winner = run if self.heads[run] else -1
            if winner >= 0:
                self.shared[run] = self.heads[run][0]  # shared with its own predecessor, which has just won
            node = (run + self.width) // 2
            while node:
                winner, self.losers[node] = self._match(winner, self.losers[node])
                node //= 2
            self.top = winner


def covered(group: list[tuple], size: int) -> list[tuple[int, int] | None]:
    """Interval around the anchor that repeated windows cover, for the sorted suffixes of one gram.

    ``group`` has ``(shared, right, reversed left)``.  For few suffixes pairs
    are compared; the shared prefix of two is the least of those between them.
    Else every distance of a window's start is looked at: within a stretch of
    the sorted suffixes that share the right part, equal left parts are equal
    windows.  Both give the same intervals.
    """
    n = len(group)
    best: list[tuple[int, int] | None] = [None] * n

    def widen(i: int, left: int, right: int) -> None:
        old = best[i]
        best[i] = (left, right) if old is None else (max(old[0], left), max(old[1], right))

    if n <= 12:
        for i in range(n):
            right = size + len(group[i][1])
            for j in range(i + 1, n):
                right = min(right, group[j][0])
                if right + min(len(group[i][2]), len(group[j][2])) < size:
                    continue
                left = common(group[i][2], group[j][2])
                if left + right >= size:
                    widen(i, min(left, size), min(right, size))
                    widen(j, min(left, size), min(right, size))
        return best
    for left in range(max(len(g[2]) for g in group) + 1):
        right, start = size - left, 0
        while start < n:
            end = start + 1
            while end < n and group[end][0] >= right:
                end += 1
            if end - start > 1:
                seen: dict[bytes, int] = {}
                for i in range(start, end):
                    if len(group[i][1]) >= right and len(group[i][2]) >= left:
                        other = seen.setdefault(group[i][2][:left], i)
                        if other != i:
                            widen(i, left, right)
                            widen(other, left, right)
            start = end
    return best


def sorted_runs(texts: DataFrame, size: int, parts: int) -> DataFrame:
    """``(part, run)``: front-coded runs of the suffixes at the wanted anchors, by the part of their gram."""

    def run(batches):
        for batch in batches:
            by_part: dict[int, list] = {}
            held = 0
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode()
                for w in wanted:
                    at = w["at"]
                    right, left = raw[at : at - w["after"] + size], raw[at - w["before"] : at][::-1]
                    by_part.setdefault(w["gram"] % parts, []).append((right, left, w["context"]))
                    held += len(right) + len(left)
                if held > 16 * RUN_BYTES:
                    yield from coded(by_part)
                    by_part, held = {}, 0
            yield from coded(by_part)

    def coded(by_part):
        for part, suffixes in by_part.items():
            suffixes.sort()
            piece, total = [], 0
            runs = []
            for s in suffixes:
                piece.append(s)
                total += len(s[0]) + len(s[1])
                if total > RUN_BYTES:
                    runs.append(front_code(piece))
                    piece, total = [], 0
            if piece:
                runs.append(front_code(piece))
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(runs), pa.int32()), pa.array(runs, pa.binary())], names=["part", "run"])

    return texts.mapInArrow(run, "part int, run binary")


def merged_intervals(runs: DataFrame, size: int) -> DataFrame:
    """``(gram, context, before, behind)``: what repeated windows cover around the anchors of a context."""

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = LoserTree([r for b in batches for r in b.column("run").to_pylist()])
        out: tuple[list, ...] = ([], [], [], [])

        def finish(group):
            if len(group) > 1:
                gram = int(gram_digests(np.frombuffer(group[0][1][:GRAM], np.uint8)).view(np.int64)[0])
                for g, interval in zip(group, covered([g[:3] for g in group], size), strict=True):
                    if interval:
                        for c, v in zip(out, (gram, g[3], *interval), strict=True):
                            c.append(v)

        group: list[tuple] = []
        for shared, right, left, context in tree:
            if shared < GRAM and group:
                finish(group)
                group = []
            group.append((shared, right, left, context))
            if len(out[0]) > 50_000:
                yield table_of(out)
                out = ([], [], [], [])
        finish(group)
        yield table_of(out)

    def table_of(out):
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["gram", "context", "before", "behind"])

    return runs.groupBy("part").applyInArrow(merge, "gram long, context long, before int, behind int")


def window_rows(texts: DataFrame, size: int) -> DataFrame:
    """``(w1, w2, distance, gram, context)``: digests of all windows around the wanted anchors, and the start's distance from the anchor."""

    def run(batches):
        for batch in batches:
            columns: tuple[list, ...] = ([], [], [], [], [])
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode()
                for w in wanted:
                    for distance in range(w["after"], w["before"] + 1):
                        start = w["at"] - distance
                        digest = xxhash.xxh3_128_intdigest(raw[start : start + size])
                        values = ((digest >> 64) - 2**63, (digest & (2**64 - 1)) - 2**63, distance, w["gram"], w["context"])
                        for c, v in zip(columns, values, strict=True):
                            c.append(v)
                    if len(columns[0]) > 50_000:
                        yield rows_of(columns)
                        columns = ([], [], [], [], [])
            yield rows_of(columns)

    def rows_of(columns):
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["w1", "w2", "distance", "gram", "context"])

    return texts.mapInArrow(run, "w1 long, w2 long, distance int, gram long, context long")


def salted(keys: DataFrame) -> DataFrame:
    """Every key with all salts, to meet rows that have one each."""
    return keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def counted_intervals(windows: DataFrame, size: int) -> DataFrame:
    """``(gram, context, before, behind)`` as of ``merged_intervals``, from windows of hot grams; each context comes once.

    Windows are counted map-side.  Those that occur once are gathered by their
    context, which has ``size`` windows at most; its other windows are repeated.
    """
    windows = written(windows)
    place = F.struct("gram", "context")
    counted = windows.groupBy("w1", "w2", "distance").agg(F.count("*").alias("n"), F.min(place).alias("place"))
    alone = counted.where("n = 1").groupBy("place").agg(F.collect_list("distance").alias("alone"))
    ranges = windows.groupBy(place.alias("place")).agg(F.min("distance").alias("low"), F.max("distance").alias("high"))
    none = F.array().cast("array<int>")
    shared = F.array_except(F.sequence("low", "high"), F.coalesce("alone", none))
    found = ranges.join(alone, "place", "left").withColumn("shared", shared).where(F.size("shared") > 0)
    return found.select("place.*", F.array_max("shared").alias("before"), (F.lit(size) - F.array_min("shared")).alias("behind"))


def repeated_intervals(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``(doc_id, h, spans)``: arrays of ``(start, end)`` bytes that repeated windows cover."""
    rows = anchor_rows(docs, size)
    contexts = written(
        rows.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "h", "at", "before", "after")).alias("one"))
    )
    several = written(contexts.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    hot = several.where(F.col("kinds") > HOT).select("gram")
    any_hot = not hot.isEmpty()
    cold = contexts
    if any_hot:
        salt = F.pmod("context", F.lit(SALTS)).cast("int")
        parted = contexts.withColumn("salt", salt).join(salted(hot).withColumn("hot", F.lit(True)), ["gram", "salt"], "left")
        parted = written(parted.drop("salt"))
        cold = parted.where(F.col("hot").isNull())
    # rows of one id and text have the same bytes: one of them is enough
    named = docs.select(F.col("doc_id").alias("__id"), F.xxhash64(whole("text")).alias("__h"), whole("text").alias("text"))

    def by_document(kept: DataFrame) -> DataFrame:
        wanted = F.collect_list(F.struct("gram", "context", "at", "before", "after")).alias("wanted")
        return written(kept.select("gram", "context", "one.*").groupBy("doc_id", "h").agg(wanted, F.count("*").alias("k")))

    def with_text(asked: DataFrame) -> DataFrame:
        same = F.col("__id").eqNullSafe(asked["doc_id"]) & (F.col("__h") == asked["h"])
        return named.join(asked, same).dropDuplicates(["__id", "__h"]).select("text", "wanted")

    asked = by_document(cold.join(several.where(F.col("kinds") <= HOT).select("gram"), "gram"))
    total = asked.agg(F.sum("k")).first()[0] or 0
    parts = max(1, -(-total // PART_SUFFIXES), docs.sparkSession.sparkContext.defaultParallelism)
    merged = merged_intervals(sorted_runs(with_text(asked), size, parts), size)
    if any_hot:
        merged = merged.unionByName(counted_intervals(window_rows(with_text(by_document(parted.where("hot"))), size), size))
    whole_context = contexts.where("n > 1").select(
        "gram", "context", F.col("one.before").alias("before"), (F.lit(size) - F.col("one.after")).alias("behind")
    )
    found = written(merged.unionByName(whole_context).groupBy("gram", "context").agg(F.max("before").alias("left"), F.max("behind").alias("right")))
    spans = rows.select("doc_id", "h", "at", "gram", "context").join(found, ["gram", "context"])
    spans = spans.select("doc_id", "h", F.struct((F.col("at") - F.col("left")).alias("start"), (F.col("at") + F.col("right")).alias("end")).alias("span"))
    return spans.groupBy("doc_id", "h").agg(F.collect_set("span").alias("spans"))


def union(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def drop_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256)``, one row per document row; ``kept`` is binary."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = repeated_intervals(docs.select("doc_id", "text"), size)
    named = docs.select(F.col("doc_id").alias("__id"), F.xxhash64(whole("text")).alias("__h"), whole("text").alias("text"))
    both = named.join(spans, F.col("__id").eqNullSafe(spans["doc_id"]) & (F.col("__h") == spans["h"]), "left")

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                made = []
                for text, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    raw, at, pieces = text.encode(), 0, []
                    cut = union([(s["start"], s["end"]) for s in found or ()])
                    for a, b in cut:
                        pieces.append(raw[at:a])
                        at = b
                    left = b"".join([*pieces, raw[at:]])
                    made.append((len(raw), len(raw) - len(left), len(cut), left, hashlib.sha256(left).hexdigest()))
                columns = list(zip(*made, strict=True)) or [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
                arrays = [part.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    return both.select(F.col("__id").alias("doc_id"), "text", "spans").mapInArrow(run, schema)


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeated strings of 200 bytes cover, and the digest of what is left."""
    return drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")
