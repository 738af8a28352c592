"""The stored tables of one history: Parquet folders, rewritten by partition, and a small state table.

A whole rewrite goes to a new folder and becomes current with one state row, so a job that dies
half-way leaves the previous tables in place. Incremental merges overwrite only the partitions
they touch, from a staged copy, and can be repeated safely.
"""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake import schemas

BUCKETS = 64
SOURCE_ROWS = 1_000_000


def bucket(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("long")


# How each merged table is partitioned: messages by ranges of the ever-growing source id, so that
# new and recently re-read rows touch the last partitions only; the others by a hash of their key.
PARTS = {
    "messages": lambda: F.expr(f"source_id div {SOURCE_ROWS}"),
    "attachments": lambda: bucket("message_id"),
    "reactions": lambda: bucket("target_guid"),
    "windows": lambda: bucket("chat_id"),
}
TABLES = {
    "handles": schemas.HANDLES,
    "chats": schemas.CHATS + ", title string, is_group boolean",
    "members": schemas.MEMBERS,
    "messages": schemas.MESSAGES,
    "attachments": schemas.ATTACHMENTS,
    "reactions": schemas.REACTION_STATE,
    "windows": schemas.WINDOWS,
    "vectors": schemas.VECTORS,
    "dirty": schemas.DIRTY,
}


def columns(name: str) -> list[str]:
    return [field.split()[0] for field in TABLES[name].split(", ")]


class History:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self._state: dict[str, str | None] | None = None

    # ------------------------------------------------------------- job state
    def _all_state(self) -> dict[str, str | None]:
        """Latest value of every key (a few dozen), read once: one job owns a history at a time."""
        if self._state is None:
            try:
                rows = self.spark.read.schema(schemas.STATE).parquet(f"{self.path}/state")
                latest = rows.groupBy("key").agg(F.max_by("value", "seq").alias("v")).collect()
                self._state = {r["key"]: r["v"] for r in latest}
            except AnalysisException:
                self._state = {}
        return self._state

    def state(self, key: str) -> str | None:
        return self._all_state().get(key)

    def set_state(self, **values: object) -> None:
        """All given keys at once: one file, one rename."""
        texts = {k: None if v is None else str(v) for k, v in values.items()}
        seq = time.time_ns()
        rows = [(k, v, seq) for k, v in texts.items()]
        self.spark.createDataFrame(rows, schemas.STATE).coalesce(1).write.mode("append").parquet(f"{self.path}/state")
        self._all_state().update(texts)

    # ---------------------------------------------------------------- tables
    def _folder(self, name: str) -> str | None:
        version = self.state(f"table:{name}")
        return None if version is None else f"{self.path}/{name}/v={version}"

    def read(self, name: str) -> DataFrame:
        folder = self._folder(name)
        if folder is None:
            return schemas.empty(self.spark, TABLES[name])
        schema = TABLES[name] + (", part long" if name in PARTS else "")
        return self.spark.read.schema(schema).parquet(folder).select(*columns(name))

    def read_parts(self, name: str, parts: list[int]) -> DataFrame:
        """Only the named partitions (pruned at planning)."""
        folder = self._folder(name)
        if folder is None or not parts:
            return schemas.empty(self.spark, TABLES[name])
        rows = self.spark.read.schema(TABLES[name] + ", part long").parquet(folder)
        return rows.filter(F.col("part").isin(parts)).select(*columns(name))

    def parts_of(self, name: str, rows: DataFrame) -> list[int]:
        """Partitions that rows fall into: at most as many as the table has."""
        return [r["part"] for r in rows.select(PARTS[name]().alias("part")).distinct().collect()]

    def replace(self, name: str, df: DataFrame) -> None:
        """A new version of the whole table."""
        version = time.time_ns()
        self._write(name, df, f"{self.path}/{name}/v={version}")
        self.set_state(**{f"table:{name}": version})

    def merge_parts(self, name: str, df: DataFrame, parts: list[int]) -> None:
        """Overwrite the named partitions with ``df``; partitions left without rows disappear."""
        folder = self._folder(name)
        if folder is None:
            self.replace(name, df)
            return
        staged = f"{self.path}/{name}/staged={time.time_ns()}"
        self._write(name, df, staged)
        schema = TABLES[name] + ", part long"
        filled = [r["part"] for r in self.spark.read.schema(schema).parquet(staged).select("part").distinct().collect()]
        again = self.spark.read.schema(schema).parquet(staged)
        if set(parts) - set(filled):  # a plain overwrite would leave the emptied ones behind
            others = self.spark.read.schema(schema).parquet(folder).filter(~F.col("part").isin(parts))
            self.replace(name, others.unionByName(again))
        else:
            again.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(folder)

    def append(self, name: str, df: DataFrame) -> None:
        folder = self._folder(name)
        if folder is None:
            self.replace(name, df)
        else:
            df.select(*columns(name)).write.mode("append").parquet(folder)

    def _write(self, name: str, df: DataFrame, folder: str) -> None:
        rows = df.select(*columns(name))
        if name in PARTS:
            rows.withColumn("part", PARTS[name]()).write.partitionBy("part").parquet(folder)
        else:
            rows.write.parquet(folder)
