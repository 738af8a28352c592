"""The corpus pipeline: each stage takes (spark, docs, sf_dir), is written as Parquet and read again for the next.

Stages, in order: documents that the quality classifier rejects go; one document of each group of near-duplicates
stays; passages that a smaller document has already are cut out; documents that hold a benchmark item go; what is
left is encoded as token ids and decoded again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from chatlake.llm import bpe, decontaminate, quality, simhash, suffixes
from chatlake.llm.common import small_transfers
from chatlake.session import ensure_checkpoint_dir

STAGES = [
    ("quality", quality.stage),
    ("near_duplicates", simhash.stage),
    ("repeated_passages", suffixes.stage),
    ("decontamination", decontaminate.stage),
    ("token_ids", bpe.stage),
]

#: Bytes of a row group of a written stage; a task holds one while it writes.
ROW_GROUP = 16 << 20

ORACLE_SQL = None  # no stage can be expressed in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, through written tables in the shared folder."""
    ensure_checkpoint_dir(spark)
    small_transfers(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.option("parquet.block.size", ROW_GROUP).parquet(path)
        docs = spark.read.parquet(path)
    return docs
