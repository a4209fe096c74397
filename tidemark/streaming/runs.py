"""Running streams to completion, and the running leak share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.session import scratch_path

#: Rows of a file that ``in_time_order`` writes, about: range partitions are cut by a sample.  Every micro-batch costs seconds
#: of planning and state commits, whatever its rows, so files are as large as the state operator's memory allows.
FILE_ROWS = 500_000


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 16) -> DataFrame:
    """A Parquet table as a stream, whether it is one file or a folder of part files."""
    # A glob stands for either; the last letter in brackets makes one of any path.
    path = path.rstrip("/")
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(f"{path[:-1]}[{path[-1]}]")
    )


def in_time_order(table: DataFrame, time: str, label: str, slices: int = 8) -> str:
    """Writes a finished table as files in event-time order and returns their folder.

    The number of files follows from the row count (``slices`` at least), so that a file holds about ``FILE_ROWS`` rows
    and a micro-batch of a fixed number of files doesn't grow with the table.  Rows of one time stay in one file.

    A file source admits files by modification time; the files get times that follow their content, so every micro-batch
    holds later rows than the one before, however the table's own files are ordered.
    """
    spark = table.sparkSession
    path = scratch_path(spark, label)
    slices = max(slices, -(-table.count() // FILE_ROWS))
    table.repartitionByRange(slices, time).sortWithinPartitions(time).write.parquet(path)
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted((f.getPath() for f in files.listStatus(folder) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    for number, part in enumerate(parts):  # names follow the range partitions
        files.setTimes(part, 1_000_000_000_000 + 1000 * number, -1)
    return path


def drained(query) -> int:
    """Waits for a query that ends by itself; returns how many late rows its watermark dropped."""
    dropped: dict[int, int] = {}

    def note():
        for p in query.recentProgress:
            dropped[p["batchId"]] = sum(s.get("numRowsDroppedByWatermark", 0) for s in p["stateOperators"])

    while not query.awaitTermination(1):
        note()
    note()
    return sum(dropped.values())


def run_append(stream: DataFrame, label: str) -> DataFrame:
    """Drains the source into Parquet and returns the written table."""
    spark = stream.sparkSession
    root = scratch_path(spark, label)
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", f"{root}/table").option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True).start()
    )
    drained(query)
    return spark.read.schema(stream.schema).parquet(f"{root}/table")


def run_update(stream: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Drains an update-mode aggregation; the newest version of each key wins.

    Every micro-batch overwrites its own folder, so a retried batch leaves the
    same result.  Rows that come later than the watermark allows are never lost
    in silence: the drain fails and says how many there were.
    """
    spark = stream.sparkSession
    root = scratch_path(spark, label)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/table/batch={batch_id}")

    query = (
        stream.writeStream.outputMode("update").foreachBatch(store)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True).start()
    )
    late = drained(query)
    if late:
        raise ValueError(f"{late} rows came later than the watermark allows; give the stream more lateness or none")
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    written = spark.read.schema(schema).option("basePath", f"{root}/table").parquet(f"{root}/table")
    others = [c for c in stream.columns if c not in keys]
    newest = written.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("v"))
    return newest.select(*keys, *[F.col(f"v.{c}").alias(c) for c in others])


def leak_monitor(log: DataFrame, window: str = "1 day", lateness: str | None = None) -> DataFrame:
    """Foreign share per cache key and event-time window.

    ``log`` has an event-time column ``at`` (timestamp).  With ``lateness`` a
    watermark bounds the state to the windows that can still change, and later
    rows are dropped (and counted by the query's progress).  Without, every row
    counts, and the state is one row per key and window.
    """
    foreign = F.col("client") != F.col("owner")
    return (
        (log.withWatermark("at", lateness) if lateness else log)
        .groupBy(F.window("at", window).alias("w"), "cache_key")
        .agg(
            F.count("*").alias("polls"),
            F.count_if(foreign).alias("foreign_polls"),
        )
        .select(
            F.unix_micros("w.start").alias("start_us"), "cache_key", "polls", "foreign_polls",
            (F.col("foreign_polls") / F.col("polls")).alias("foreign_share"),
        )
    )
