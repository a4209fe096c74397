"""Writers.  Each one writes in parallel and hands back the path or table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from tidemark.session import scratch_path


def write_csv(df: DataFrame, path: str) -> str:
    """CSV with a header, columns in the frame's order."""
    df.write.option("header", True).option("emptyValue", '""').csv(path)
    return path


def nested_json(df: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """Long ``(outer, inner, value)`` rows to one JSON object per outer key.

    Keys are sorted, so equal inputs give equal text.
    """
    entries = F.array_sort(F.collect_list(F.struct(F.col(inner).alias("key"), F.col(value).alias("value"))))
    return df.groupBy(outer).agg(F.to_json(F.map_from_entries(entries)).alias("json"))


def write_json(df: DataFrame, path: str) -> str:
    df.write.json(path)
    return path


def create_table_as(df: DataFrame, name: str) -> DataFrame:
    """Materialise a query as a named table; the name gets a suffix of its own.

    Two runs in one catalog never touch each other's table.  The files go to a
    fresh folder below the shared one.
    """
    spark = df.sparkSession
    name = f"{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", scratch_path(spark, name)).saveAsTable(name)
    return spark.table(name)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back.

    Cuts the lineage in a way that survives the loss of executors, and lets
    several consumers share one computation.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_per_key_text(df: DataFrame, path: str, text: str = "md") -> str:
    """One text record per (page, tool) below ``page=/tool=`` folders."""
    df.select("page", "tool", F.col(text).alias("value")).write.option(
        "lineSep", "\n"
    ).partitionBy("page", "tool").text(path)
    return path


def write_pack(files: DataFrame, path: str) -> str:
    """``path, content`` rows, each a file of its own, in a few large files; ``readers.scan_pack`` reads them."""
    files.select(
        "path", F.current_timestamp().alias("modificationTime"), F.octet_length("content").cast("bigint").alias("length"),
        F.col("content").cast("binary").alias("content"),
    ).write.parquet(path)
    return path
