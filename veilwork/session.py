"""Session helpers.

Nothing here overrides a setting the cluster already made: ``get_session``
only fills in what a local test run needs, and lineage is cut with
``checkpoint()`` into the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

LOCAL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}

METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
JIT_LIMIT = 8000  # HotSpot never compiles a method with more bytecode than this
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep_methods_compiled(spark: SparkSession) -> SparkSession:
    """Let stages with very long generated methods run as split projections.

    A policy over many columns becomes one generated method.  Beyond 8000 bytes
    the JVM interprets it, which costs a factor of two and more; below this
    limit Spark splits the work into small methods instead.  A session that
    sets the limit itself is left alone.
    """
    if spark.conf.get(METHOD_LIMIT) == "65535":  # Spark's default
        spark.conf.set(METHOD_LIMIT, str(JIT_LIMIT))
    return spark


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Let the shuffle files of an action go when it ends, on all executors.

    Else they stay until the driver happens to collect its garbage, so that
    several passes over a large batch fill the disk with what nobody reads.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def get_session(
    app: str = "veilwork", master: str | None = None, **conf: str
) -> SparkSession:
    """Return the active session, or start one (local settings only if ``master`` is given)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        for name, value in LOCAL_DEFAULTS.items():
            builder = builder.config(name, value)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return keep_methods_compiled(builder.getOrCreate())


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder, named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own; on a cluster a
    missing setting is an error, because a machine-local folder does not
    survive a lost executor.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(folder)
        return folder
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="veilwork-checkpoint-"))
    return context.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """``checkpoint()`` into the cluster's shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint()
