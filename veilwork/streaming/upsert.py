"""Continuous sync of tables whose rows change: events are merged into a target kept by key."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.techniques import ColumnRule, Settings
from ..operators.apply import apply_policy, resolve_scopes
from ..session import keep_methods_compiled
from ..sources.keyed import KeyedTarget
from ..sources.sinks import conform
from .changes import split_deletes
from .sync import PERIOD


def merge_events(
    target: KeyedTarget, events: DataFrame, order: Sequence[str], operation: str = "operation",
    children: Sequence[tuple[DataFrame, str]] = (),
) -> int:
    """Merge anonymized events and return the target's version.

    A delete whose key occurs in one of the ``children`` (frame, column) is
    refused: it counts as no event, earlier changes of its row stand, and it is
    kept in ``target.refused``.  A target with one key column tells refused
    deletes when it reduces the events by key, and needs no join before.
    """
    key, allowed, refused, parents = target.key[0], events, None, []
    for frame, column in children:
        allowed, turned_down = split_deletes(allowed, key, frame, column, operation)
        refused = turned_down if refused is None else refused.unionByName(turned_down)
        parents.append(frame.select(F.col(column).alias(key)))
    if not parents or len(target.key) > 1 or any(p.schema[key].dataType != events.schema[key].dataType for p in parents):
        return target.merge(allowed, order, operation, refused)
    return target.merge(events, order, operation, refused, reduce(DataFrame.union, parents))


def quarantine(target: KeyedTarget, checkpoint: str) -> str:
    """Where a stream keeps values of unknown columns: a folder per checkpoint, a part per batch, so a replay replaces its own."""
    return f"{target.path}/quarantine/stream={hashlib.md5(checkpoint.encode()).hexdigest()}"


def quarantined(spark: SparkSession, target: KeyedTarget) -> DataFrame:
    """All values of columns that no policy knew when they came."""
    return spark.read.option("mergeSchema", "true").parquet(f"{target.path}/quarantine").drop("stream", "batch")


def start_upsert(
    stream: DataFrame,
    table_name: str,
    rules_now: Callable[[], Sequence[ColumnRule]],
    settings: Settings,
    target: KeyedTarget,
    checkpoint: str,
    order: Sequence[str],
    operation: str = "operation",
    row_key: Sequence[str] = (),
    scales: Mapping[str, float] | None = None,
    children_now: Callable[[], Sequence[tuple[DataFrame, str]]] = tuple,
    on_shift: Callable[[str, Sequence[str]], None] | None = None,
    once: bool = False,
) -> StreamingQuery:
    """Keep an anonymized copy in step with a stream of change events.

    ``rules_now`` returns the rules of the whole policy and is asked per batch;
    foreign-key chains are resolved over all of them.  The order and operation
    columns must not be rewritten, and the technique of a key must not change
    while the target lives, as its rows would get other keys.  ``children_now``
    gives the anonymized tables that forbid deletes.

    A column that the policy does not know never reaches the target.  Its
    values are kept apart with the anonymized key (``quarantined``), and
    ``on_shift(table, columns)`` is told, before the batch counts, so that the
    policy can go back to review (``policy.status_after_shift``).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rules = resolve_scopes(rules_now(), settings.strict)
        own = [r for r in rules if r.table_name == table_name]
        fixed = {*order, operation} & {r.column_name for r in own if (r.technique or "NO_CHANGE").upper() != "NO_CHANGE"}
        if fixed:
            raise ValueError(f"{table_name}: {', '.join(sorted(fixed))} order the events and cannot be rewritten")
        unknown = [c for c in batch.columns if c not in {r.column_name for r in own} | {*order, operation}]
        done = apply_policy(batch, table_name, rules, settings, row_key, dict(scales or {}))
        if unknown:
            held = done.select(*target.key, *order, *unknown)
            held.write.mode("overwrite").parquet(f"{quarantine(target, checkpoint)}/batch={batch_id}")
            if on_shift is not None:
                on_shift(table_name, unknown)
            done = done.drop(*unknown)
        merge_events(target, conform(done, own), order, operation, children_now())

    keep_methods_compiled(stream.sparkSession)
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=PERIOD)
    return writer.start()
