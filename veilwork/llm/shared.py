"""Small helpers of the operators: words, tables in the shared folder, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"  # a word in the sense of the query contracts
BROADCAST_ROWS = 50_000  # sides of at most so many narrow rows, counted first, are broadcast
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read one of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole(text: Column | str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a local master may do without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        root = tempfile.mkdtemp(prefix="veilwork-llm-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the frame to the shared folder as Parquet (zstd: mostly texts) and read it again."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def small_batches(spark: SparkSession) -> SparkSession:
    """Let Spark hand texts to Python in batches of 4 MB, not of 10,000 rows whatever their size.

    A batch stands several times beside the heap of an executor (columns, message,
    the worker's copy), for every task at once.  A session that sets the size itself
    is left alone.  No operator's rows depend on where a batch ends.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, "4m")
    return spark


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a written frame for broadcast if it has at most ``rows`` rows; else leave it to be shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def unused(name: str, taken) -> str:
    """The name, with as many underscores behind it as it takes to differ from the taken ones."""
    while name in taken:
        name += "_"
    return name
