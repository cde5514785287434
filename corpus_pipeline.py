"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again.

Language ID drops documents without a recognizable language; line dedup takes
repeated lines out of the texts; MinHash near-dedup keeps one document of each
group; mixing repeats and samples documents to the sources' target weights; the
last stage encodes every text with byte-level BPE and returns its ids.

A stage works on all rows of the one before.  An empty table stays empty
through all stages.  Columns beside those of ``documents`` are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilwork.llm import stages
from veilwork.llm.shared import shared_folder

STAGES = [
    ("language_id", stages.keep_known_languages),
    ("line_dedup", stages.remove_repeated_lines),
    ("near_dedup", stages.keep_one_of_each_group),
    ("mix_sources", stages.mix_to_targets),
    ("byte_bpe", stages.encode_texts),
]

# Learned models, suffix digests and byte-level ids have no SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        folder = shared_folder(spark)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
