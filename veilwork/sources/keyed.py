"""A table kept by key: updates replace, deletes remove, replays change nothing.

The target is cut into key buckets.  A batch rewrites only the buckets it
touches, as a new version beside the old files; then a manifest says which
version of every bucket counts:

    <path>/data/_version=7/_bucket=3/...   bucket 3 as of version 7
    <path>/manifest/_version=7/...         one row per bucket, written as a single file
    <path>/refused/_version=7/...          deletes that were refused

Readers take the greatest manifest.  Its single file appears by one rename, so
a batch is either visible as a whole or not at all; what a failed batch left
behind is no part of any manifest, and its next attempt overwrites it.

Every row keeps the order of the event that wrote it, and a deleted row stays as
a tombstone.  An event only wins against older ones, so batches may be repeated,
come late, or be run again from a new checkpoint folder: the target stays that
of a batch run over all events.  One writer at a time: a second one fails
because its manifest exists, and starts again from the new one.

A bucket is written by one task for every ``ROWS_PER_TASK`` rows of it, so that
tasks stay small however few buckets a target was made with.  A batch rewrites
whole buckets: ``buckets`` should keep them at about a million rows
(``buckets_for``).  Keys are hashed and every key has one row after the
reduction, so no bucket is hot.  The driver sees bucket numbers only.

A batch and the buckets it touches meet in one aggregate by key, once to see
which buckets it changes and once to write them.  Events are reduced before they
are shuffled, digests in hex travel as bytes and the order columns once.
Nothing is cached, and shuffle files go when their action ends.  A large batch
is merged in steps of some buckets each, all of them before the manifest, so
that a step shuffles about ``ROWS_PER_STEP`` rows.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shuffles_dropped

BUCKET, CHANGED, GONE, VERSION = "_bucket", "_changed", "_gone", "_version"
OWN = (BUCKET, CHANGED, GONE)
PIECE = "_piece"
HELD, PARENT = "_held", "_parent"  # marks of rows: from the target, or a key that has children
DIGEST, APART = "_digest", "_apart"
ROWS_PER_TASK = 125_000  # several pieces may meet in a task
ROWS_PER_STEP, MOST_STEPS = 100_000_000, 8  # a step reads the whole batch and shuffles its own buckets
WHOLE = -1  # manifest row that holds the number of buckets
CODEC = "zstd"  # of the files: keys are digests in hex


def buckets_for(rows: int, rows_per_bucket: int = 1_000_000) -> int:
    """Number of buckets for an expected number of rows."""
    return max(1, -(-rows // rows_per_bucket))


@dataclass(frozen=True)
class Manifest:
    """Version and bucket versions of a target."""

    version: int
    buckets: int
    held: Mapping[int, int]


@dataclass(frozen=True)
class KeyedTarget:
    """Where a table is kept and by which (already anonymized) key.

    ``buckets`` counts when the target is made; an existing target keeps its own.
    """

    path: str
    key: tuple[str, ...]
    buckets: int = 64

    def versions(self, spark: SparkSession) -> list[int]:
        """Versions whose manifest is complete, oldest first."""
        try:
            files = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter="*.parquet").load(f"{self.path}/manifest")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return []
            raise
        return sorted({int(re.search(rf"/{VERSION}=(\d+)/", r["path"])[1]) for r in files.select("path").collect()})

    def manifest(self, spark: SparkSession, version: int | None = None) -> Manifest:
        """The manifest of a version, by default of the last one; version 0 holds nothing."""
        if version is None:
            version = max(self.versions(spark), default=0)
        if not version:
            return Manifest(0, self.buckets, {})
        rows = spark.read.schema("bucket int, version long").parquet(f"{self.path}/manifest/{VERSION}={version}").collect()
        held = {r["bucket"]: r["version"] for r in rows}
        return Manifest(version, held.pop(WHOLE), held)

    def _rows(self, spark: SparkSession, held: Mapping[int, int]) -> DataFrame:
        paths = [f"{self.path}/data/{VERSION}={v}/{BUCKET}={b}" for b, v in sorted(held.items())]
        return spark.read.option("basePath", f"{self.path}/data").option("mergeSchema", "true").parquet(*paths).drop(VERSION)

    def read(self, spark: SparkSession, version: int | None = None) -> DataFrame | None:
        """The rows as of a version, without tombstones; None if there is no version yet."""
        manifest = self.manifest(spark, version)
        if not manifest.held:
            return None
        return self._rows(spark, manifest.held).filter(~F.col(GONE)).drop(*OWN)

    def refused(self, spark: SparkSession) -> DataFrame | None:
        """The deletes refused so far, each once, with the version that first refused it."""
        try:
            found = spark.read.option("mergeSchema", "true").parquet(f"{self.path}/refused")
            return found.groupBy(*[c for c in found.columns if c != VERSION]).agg(F.min(VERSION).alias("version"))
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def bucket(self, buckets: int, values: Iterable[Column] | None = None) -> Column:
        values = [F.col(k) for k in self.key] if values is None else values
        return F.pmod(F.xxhash64(*[v.cast("string") for v in values]), F.lit(buckets)).cast("int")

    def merge(
        self, events: DataFrame, order: Sequence[str], operation: str = "operation", refused: DataFrame | None = None,
        parents: DataFrame | None = None,
    ) -> int:
        """Bring events into the target and return its version, unchanged if they bring nothing new.

        ``events`` hold anonymized rows, an operation (``DELETE`` or anything
        else) and the order columns; they are read several times.  Of events
        with equal order a delete wins, then a digest of the row decides.
        Deletes of ``parents`` (key values, for keys of one column) count as no
        event.  ``refused`` events are kept apart.
        """
        spark = events.sparkSession
        with shuffles_dropped(spark):
            now = self.manifest(spark)
            rest = [c for c in events.columns if c not in (*self.key, operation)]
            gone, bucket = F.col(operation).eqNullSafe("DELETE"), self.bucket(now.buckets).alias(BUCKET)
            marked = events.select(*self.key, *rest, F.struct(*order).alias(CHANGED), gone.alias(GONE), bucket)
            marks = None
            if parents is not None:
                marks = parents.filter(F.col(self.key[0]).isNotNull()).select(*self.key, F.lit(True).alias(PARENT), bucket)
            counts = marked.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(F.xxhash64(*self.key)).alias("keys")).collect()
            old = {r[BUCKET]: now.held[r[BUCKET]] for r in counts if r[BUCKET] in now.held}
            rows = sum(r["rows"] for r in counts) + (self._rows(spark, old).count() if old else 0)
            steps = min(now.buckets, MOST_STEPS, buckets_for(rows, ROWS_PER_STEP))
            changed: list[int] = []
            for i in range(steps):
                keys = {r[BUCKET]: r["keys"] for r in counts if r[BUCKET] % steps == i}
                part = marked if steps == 1 else marked.filter(F.col(BUCKET) % steps == i)
                changed += self._write(now, part, old, marks, keys, "append" if changed else "overwrite") if keys else []
            parts, n = [], -(-steps // 2)  # deletes only, and no rows of the target
            if refused is not None:
                parts = [refused.filter(self.bucket(now.buckets) % n == i) if n > 1 else refused for i in range(n)]
            if not changed and all(p.isEmpty() for p in parts):
                return now.version
            path = f"{self.path}/refused/{VERSION}={now.version + 1}"
            for i, part in enumerate(parts):
                part.write.mode("append" if i else "overwrite").option("compression", CODEC).parquet(path)
            return self._switch(spark, now, changed)

    def _gathered(self, events: DataFrame, old: Mapping[int, int], marks: DataFrame | None) -> DataFrame:
        """Events, what the target holds in the buckets they touch, and the keys that have children."""
        rows = events
        if old:
            rows = self._rows(events.sparkSession, old).withColumn(HELD, F.lit(True)).unionByName(rows, allowMissingColumns=True)
        return rows if marks is None else rows.unionByName(marks, allowMissingColumns=True)

    def _changed(self, now: Manifest, rows: DataFrame) -> dict[int, int]:
        """The buckets that the events change, and how many rows these have then."""
        winners = _winners(rows, self.key, ())
        bucket = self.bucket(now.buckets, _unpacked(rows, self.key)).alias(BUCKET)
        found = winners.groupBy(bucket).agg(F.count(F.lit(1)).alias("rows"), F.max("_new").alias("new")).collect()
        return {r[BUCKET]: r["rows"] for r in found if r["new"]}

    def _write(
        self, now: Manifest, events: DataFrame, old: Mapping[int, int], marks: DataFrame | None, keys: Mapping[int, int], mode: str
    ) -> list[int]:
        """Write those of the events' buckets that they change, and return them; ``keys``: about how many keys come to each."""
        spark, path = events.sparkSession, f"{self.path}/data/{VERSION}={now.version + 1}"

        def rows(buckets: Collection[int]) -> DataFrame:
            few = F.col(BUCKET).isin(list(buckets))
            came = events if len(buckets) == len(keys) else events.filter(few)
            near = marks if marks is None or len(buckets) == now.buckets else marks.filter(few)
            return self._gathered(came, {b: old[b] for b in buckets if b in old}, near)

        known = any(b in old for b in keys)
        sizes = self._changed(now, rows(keys)) if known else keys
        if not sizes:
            return []
        merged = self._dealt(now, rows(sizes), buckets_for(sum(sizes.values()), len(sizes) * ROWS_PER_TASK), len(sizes))
        merged.write.mode(mode).option("compression", CODEC).partitionBy(BUCKET).parquet(path)
        if known:
            return list(sizes)
        written = spark.read.schema(f"{BUCKET} int").parquet(path).distinct().collect()  # refused deletes leave no row
        return [r[BUCKET] for r in written if r[BUCKET] in sizes]

    def _switch(self, spark: SparkSession, now: Manifest, changed: Sequence[int]) -> int:
        version = now.version + 1
        held = dict(now.held) | {b: version for b in changed}
        rows = [(WHOLE, now.buckets), *sorted(held.items())]
        manifest = spark.createDataFrame(rows, "bucket int, version long").coalesce(1)
        manifest.write.mode("errorifexists").parquet(f"{self.path}/manifest/{VERSION}={version}")
        return version

    def _dealt(self, now: Manifest, rows: DataFrame, pieces: int, buckets: int) -> DataFrame:
        """The row of the last event per key, dealt by bucket and piece of it (by key)."""
        plain, values = _plain(rows, self.key), _unpacked(rows, self.key)
        winners = _winners(rows, self.key, plain)
        piece = F.pmod(F.hash(F.lit("piece"), *[v.cast("string") for v in values]), F.lit(pieces))
        packed = [c for c in winners.columns if c != "_new"]
        dealt = winners.select(*packed, self.bucket(now.buckets, values).alias(BUCKET), piece.alias(PIECE)).repartition(buckets * pieces, BUCKET, PIECE)
        e, twice = F.col("_e"), _twice(rows, plain)
        apart = e.getField(APART)
        whole = [(F.when(apart.isNotNull(), apart.getField(c)).otherwise(e.getField(CHANGED).getField(c)) if c in twice else e.getField(c)).alias(c) for c in plain]
        return dealt.select(*[v.alias(k) for k, v in zip(self.key, values, strict=True)], *whole, e.getField(CHANGED).alias(CHANGED), e.getField(GONE).alias(GONE), BUCKET)


def _is_text(rows: DataFrame, name: str) -> bool:
    return rows.schema[name].dataType.simpleString() == "string"  # not one with a collation


def _packed(rows: DataFrame, key: Sequence[str]) -> list[Column]:
    """The key as it is shuffled: text in lower-case hex as its bytes, any other value as it is."""
    packed = []
    for k in key:
        if _is_text(rows, k):
            raw = F.unhex(k)
            is_hex = F.lower(F.hex(raw)).eqNullSafe(F.col(k))
            packed.append(F.when(is_hex, raw).alias(f"_hex_{k}"))
            packed.append(F.when(~is_hex, F.col(k)).alias(f"_text_{k}"))
        else:
            packed.append(F.col(k).alias(f"_text_{k}"))
    return packed


def _unpacked(rows: DataFrame, key: Sequence[str]) -> list[Column]:
    """The key columns from what ``_packed`` made of them."""
    return [F.coalesce(F.col(f"_text_{k}"), F.lower(F.hex(f"_hex_{k}"))) if _is_text(rows, k) else F.col(f"_text_{k}") for k in key]


def _plain(rows: DataFrame, key: Sequence[str]) -> list[str]:
    return [c for c in rows.columns if c not in (*key, *OWN, HELD, PARENT)]


def _twice(rows: DataFrame, plain: Iterable[str]) -> list[str]:
    """Columns that the event order holds as well; they travel once."""
    order = {f.name: f.dataType for f in rows.schema[CHANGED].dataType}
    return [c for c in plain if order.get(c) == rows.schema[c].dataType]


def _winners(rows: DataFrame, key: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """What decides between the rows of a key: event order, deletes last, then a digest of the row.

    One row per key: its columns packed, the winner ``_e`` with the ``kept``
    columns, and whether it is an event the target does not hold.
    """
    plain = _plain(rows, key)
    twice = _twice(rows, kept)
    digest = F.xxhash64(*sorted(plain)) if plain else F.lit(0).cast("long")
    fields = [F.col(CHANGED), F.col(GONE), digest.alias(DIGEST), *[F.col(c) for c in kept if c not in twice]]
    if twice:
        differs = reduce(or_, [~F.col(c).eqNullSafe(F.col(CHANGED).getField(c)) for c in twice])
        fields.append(F.when(differs, F.struct(*twice)).alias(APART))
    event, gone = F.struct(*fields), F.col(GONE)
    held = F.coalesce(F.col(HELD), F.lit(False)) if HELD in rows.columns else F.lit(False)
    packed = _packed(rows, key)
    if PARENT not in rows.columns:
        parts = rows.select(*packed, F.when(held, event).alias("_o"), F.when(~held, event).alias("_n"))
        aggregates, new = [F.max("_o").alias("_o"), F.max("_n").alias("_n")], F.col("_n")
    else:  # a delete counts unless its key has children, which is known when all rows of the key have met
        is_event = ~held & gone.isNotNull()
        parts = rows.select(
            *packed, F.when(held, event).alias("_o"), F.when(is_event & ~gone, event).alias("_n"), F.when(is_event & gone, event).alias("_d"), PARENT
        )
        aggregates = [F.max(c).alias(c) for c in ("_o", "_n", "_d", PARENT)]
        new = F.when(F.col(PARENT), F.col("_n")).otherwise(F.greatest("_n", "_d"))
    names = parts.columns[: len(packed)]
    found = parts.groupBy(*names).agg(*aggregates).select(*names, "_o", new.alias("_n"))
    is_new = F.col("_n").isNotNull() & (F.col("_o").isNull() | (F.col("_n") > F.col("_o")))
    return found.select(*names, F.coalesce(F.when(is_new, F.col("_n")), F.col("_o")).alias("_e"), is_new.alias("_new")).filter("_e is not null")
