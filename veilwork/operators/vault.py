"""The mapping vault: an optional table of sealed originals, for reversible replacement.

Replacements are functions of the value, so no lookup is needed to produce
them.  The vault stores what a digest cannot give back: the way from a
replacement to the original.  It can also hold replacements that are no
function of the value (taken over from another system, or made under an older
secret); ``lookup_or_create`` keeps these and makes new ones only for values it
has never seen.

Entries are found by digests of the value and of the replacement; only what a
join has found is decrypted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digests import keyed_digest, seal, unseal
from ..sources.keyed import KeyedTarget

KEY = ("scope", "key_hash")
GLOBAL_PREFIX = "global:"
TOKEN_SCOPE = "token"  # sets digests of replacements apart from those of values
ENTRY = "scope string, key_hash string, token_hash string, original_sealed string, cipher string, epoch bigint"


def scope_name(table_name: str, column_name: str, shared: bool = False) -> str:
    return f"{GLOBAL_PREFIX}{table_name}.{column_name}" if shared else f"mapping:{table_name}.{column_name}"


def _entry(scope: str, original: Column, replacement: Column, key: str) -> list[Column]:
    return [
        F.lit(scope).alias("scope"),
        keyed_digest(original, key).alias("key_hash"),
        keyed_digest(replacement, key, TOKEN_SCOPE).alias("token_hash"),
        seal(original, key).alias("original_sealed"),
        seal(replacement, key).alias("cipher"),
    ]


def build(df: DataFrame, column: str, replacement: Column, scope: str, key: str) -> DataFrame:
    """One row per distinct value: scope, digests of value and replacement, both sealed.

    ``replacement`` is an expression over ``column``.  Values are made distinct
    first, map-side, so each is hashed and sealed once however often it occurs.
    """
    text = F.col(column).cast("string")
    pairs = df.select(column).distinct().select(text.alias("original"), replacement.cast("string").alias("replacement"))
    pairs = pairs.filter("original is not null and original <> ''")
    return pairs.select(*_entry(scope, F.col("original"), F.col("replacement"), key))


def first_entries(entries: DataFrame) -> DataFrame:
    """One entry per value: that of the smallest epoch, of equal epochs the smallest sealed text."""
    rest = [c for c in entries.columns if c not in KEY]
    age = F.struct("epoch", "cipher") if "epoch" in rest else F.struct("cipher")
    first = entries.groupBy(*KEY).agg(F.min_by(F.struct(*rest), age).alias("e"))
    return first.select(*KEY, "e.*").select(*entries.columns)


def merge(existing: DataFrame, offline: DataFrame) -> DataFrame:
    """Add offline entries; an entry that is already there wins."""
    new = first_entries(offline).join(_shuffled(existing.select(*KEY)), list(KEY), "left_anti")
    return existing.unionByName(new)


def _shuffled(entries: DataFrame) -> DataFrame:
    """Entries for a join that is not to send them to the driver.

    Their size is estimated from the compressed columns they are made of, and
    digests and sealed texts are many times as large: a vault of a gigabyte
    passes for a side small enough to broadcast.
    """
    return entries.hint("merge")


def _found(values: DataFrame, column: str, vault: DataFrame, scope: str, key: str) -> DataFrame:
    """Distinct values with their digest, and the sealed replacement where there is one.

    Values are reduced to distinct ones before the join with the vault, so a
    value that fills a third of the table is looked up once.
    """
    text = F.col(column).cast("string")
    distinct = values.select(F.col(column)).distinct().withColumn("key_hash", keyed_digest(text, key))
    return distinct.join(_shuffled(vault.filter(F.col("scope") == scope).select("key_hash", "cipher")), "key_hash", "left")


def lookup(values: DataFrame, column: str, vault: DataFrame, scope: str, key: str, out: str) -> DataFrame:
    """Replacement of every value, null where none is stored."""
    return _found(values, column, vault, scope, key).select(column, unseal(F.col("cipher"), key).alias(out))


def lookup_or_create(
    values: DataFrame, column: str, vault: DataFrame, replacement: Column, scope: str, key: str, epoch: int, out: str = "replacement"
) -> tuple[DataFrame, DataFrame]:
    """``(pairs, created)``: the replacement of every distinct value, and the entries the vault lacked.

    A stored replacement wins over the expression, whatever it is.  Null and
    empty values stay themselves and get no entry.  ``created`` holds entries
    of this ``epoch`` in the form of ``ENTRY``.
    """
    found = _found(values, column, vault, scope, key)
    text, made = F.col(column).cast("string"), replacement.cast("string")
    blank = text.isNull() | (text == "")
    chosen = F.when(blank, text).otherwise(F.coalesce(unseal(F.col("cipher"), key), made))
    pairs = found.select(column, chosen.alias(out), F.col("cipher").isNotNull().alias("stored"))
    missing = found.filter(~blank & F.col("cipher").isNull())
    created = missing.select(*_entry(scope, text, made, key), F.lit(epoch).cast("long").alias("epoch"))
    return pairs, created


def reveal(replaced: DataFrame, column: str, vault: DataFrame, scope: str, key: str) -> DataFrame:
    """Reverse lookup: from replacement to the original(s) stored for it.

    Vaults written before entries had a digest of their replacement are
    decrypted to find it.
    """
    if "token_hash" not in vault.columns:
        vault = vault.withColumn("token_hash", keyed_digest(unseal(F.col("cipher"), key), key, TOKEN_SCOPE))
    asked = replaced.select(column).distinct().withColumn("token_hash", keyed_digest(F.col(column).cast("string"), key, TOKEN_SCOPE))
    entries = vault.filter(F.col("scope") == scope).select("token_hash", "original_sealed")
    return asked.join(_shuffled(entries), "token_hash").select(column, unseal(F.col("original_sealed"), key).alias("original"))


def stats(vault: DataFrame) -> DataFrame:
    """Entries per scope with a grand total (null scope), and which kind the scope is."""
    counts = vault.rollup("scope").agg(F.count(F.lit(1)).alias("entries"))
    kind = F.when(F.col("scope").isNull(), "total").when(
        F.col("scope").startswith(GLOBAL_PREFIX), "global"
    )
    return counts.select("scope", kind.otherwise("table").alias("kind"), "entries")


def without(vault: DataFrame, scope: str | None = None) -> DataFrame:
    """The vault after clearing one scope, or all of it."""
    return vault.filter(F.lit(False) if scope is None else F.col("scope") != scope)


def store(vault: DataFrame, path: str) -> None:
    """Persist, one partition folder per scope; a re-run replaces only the scopes it holds."""
    vault.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scope").parquet(path)


@dataclass(frozen=True)
class VaultStore:
    """A vault kept in key buckets (``sources.keyed``): the first writer of a value wins.

    Epochs number the runs that write.  Of two runs that met the same new value
    at once, the store takes one switch of the manifest; the other one fails to
    switch, looks again, and finds the value stored.
    """

    path: str
    buckets: int = 64

    @property
    def _target(self) -> KeyedTarget:
        return KeyedTarget(self.path, KEY, self.buckets)

    def read(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """All entries; an empty frame before the first ones."""
        held = self._target.read(spark, version)
        names = [c.split()[0] for c in ENTRY.split(", ")]
        return spark.createDataFrame([], ENTRY) if held is None else held.select(*names)

    def put(self, entries: DataFrame) -> int:
        """Add entries in one pass over the buckets they touch; of one value the smallest epoch stays."""
        older = -F.col("epoch")  # the target keeps the greatest order
        return self._target.merge(first_entries(entries).withColumns({"_age": older, "operation": F.lit("PUT")}), ["_age"])

    def assign(
        self, values: DataFrame, column: str, replacement: Column, scope: str, key: str, epoch: int, out: str = "replacement", attempts: int = 5
    ) -> DataFrame:
        """The replacement of every distinct value, stored before it is returned.

        Values that lack one get that of the expression.  The result reads the
        version this call made or found, so later writers don't change it.
        """
        spark = values.sparkSession
        for _ in range(attempts):
            seen = self._target.manifest(spark).version
            _, created = lookup_or_create(values, column, self.read(spark, seen or None), replacement, scope, key, epoch, out)
            try:
                version = self.put(created)
            except AnalysisException as e:
                if e.getCondition() != "PATH_ALREADY_EXISTS":
                    raise
                continue  # another writer switched first: look again
            pairs, _ = lookup_or_create(values, column, self.read(spark, version or None), replacement, scope, key, epoch, out)
            return pairs.select(column, out)
        raise RuntimeError(f"the vault at {self.path} changed {attempts} times while values were assigned")
