"""One list of queries feeds both the Spark side and the SQL side."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import apply_runtime_conf
from tidemark.sources.readers import Tables


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers ``fn(tables) -> DataFrame`` under its own name."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        key = name or fn.__name__
        if key in REGISTRY:
            raise ValueError(f"query {key} is registered twice")

        def run(spark: SparkSession, root: str) -> DataFrame:
            return fn(Tables(apply_runtime_conf(spark), root))

        REGISTRY[key] = Query(key, run, sql)
        return fn

    return wrap
