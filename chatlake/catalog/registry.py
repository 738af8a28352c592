from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from chatlake.session import plain_unions
from chatlake.sources.testdata import TestData

REGISTRY: dict[str, tuple[Callable[[TestData], DataFrame], str | None]] = {}

TOPICS = ("reports", "conversations", "ingestion", "landed", "search", "meaning")


def query(name: str, sql: str | None = None):
    """Register ``fn(data) -> DataFrame`` under ``name`` with its SQL equivalent."""

    def wrap(fn):
        REGISTRY[name] = (fn, sql)
        return fn

    return wrap


def _load() -> None:
    for topic in TOPICS:
        import_module(f"chatlake.catalog.{topic}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")  # the tables' times carry no zone
            plain_unions(spark)
            return fn(TestData(spark, sf_dir))

        return run

    return {name: bind(fn) for name, (fn, _) in REGISTRY.items()}


def oracles() -> dict[str, str]:
    _load()
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql is not None}
