"""Continuous sync with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.techniques import ColumnRule, Settings
from ..operators.apply import apply_policy, resolve_scopes
from ..session import keep_methods_compiled
from ..sources.sinks import conform, write_batch

PERIOD = "30 seconds"  # fixed value: how often the source is looked at


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_batch: int | None = None
) -> DataFrame:
    """New files under ``path``; Spark's checkpoint remembers the ones already seen."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def start_sync(
    stream: DataFrame,
    table_name: str,
    rules_now: Callable[[], Sequence[ColumnRule]],
    settings: Settings,
    target: str,
    checkpoint: str,
    row_key: Sequence[str] = (),
    scales: Mapping[str, float] | None = None,
    once: bool = False,
) -> StreamingQuery:
    """Anonymize and append every micro-batch.

    For sources that only grow; ``upsert.start_upsert`` applies updates and deletes.

    ``rules_now`` is called per batch, so an approved policy change takes effect
    with the next one; it returns the rules of the whole policy, over which
    chains of foreign keys are resolved.  Each batch goes to its own partition and a replay
    overwrites it.  Noise needs the scales of the batch run: a scale taken from
    a micro-batch would differ from batch to batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rules = resolve_scopes(rules_now(), settings.strict)
        done = apply_policy(batch, table_name, rules, settings, row_key, dict(scales or {}))
        write_batch(conform(done, [r for r in rules if r.table_name == table_name]), target, batch_id)

    keep_methods_compiled(stream.sparkSession)
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=PERIOD)
    return writer.start()


def start_event_queue(
    events: DataFrame,
    target: str,
    checkpoint: str,
    once: bool = False,
    event_id: str | None = None,
    event_time: str | None = None,
    lateness: str = "1 hour",
) -> StreamingQuery:
    """Persist change events; the streaming checkpoint is the last-processed mark.

    With ``event_id`` and ``event_time`` an event that is delivered again within
    ``lateness`` is stored once, and one older than that is dropped as late: the
    state holds the ids of that span only, dealt by id over all tasks.
    """
    if (event_id is None) != (event_time is None):
        raise ValueError("repeats are told by an event id within a span of event time: name both columns")
    if event_id is not None:
        timed = events.withWatermark(event_time, lateness)
        events = timed.dropDuplicatesWithinWatermark([event_id])
    writer = events.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=PERIOD)
    return writer.start()


def queue_marks(queue: DataFrame, event_id: str, event_time: str, by: str = "table_name") -> DataFrame:
    """How far the queue has come, per table: events, and time and id of the last one."""
    last = F.max(F.struct(F.col(event_time).alias("t"), F.col(event_id).alias("i")))
    marks = queue.groupBy(by).agg(F.count(F.lit(1)).alias("events"), last.alias("_last"))
    return marks.select(by, "events", F.col("_last.t").alias("last_time"), F.col("_last.i").alias("last_id"))


def batch_marks(target: DataFrame, key: str) -> DataFrame:
    """What each micro-batch brought: rows and greatest key."""
    return target.groupBy("batch_id").agg(F.count(F.lit(1)).alias("row_count"), F.max(key).alias("max_key"))
