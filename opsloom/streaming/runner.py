"""Sources and runs of streams over landed files."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from opsloom.session import shared_dir


def read_stream(
    spark: SparkSession,
    path: str,
    schema: str,
    fmt: str = "parquet",
    start: str | datetime = "earliest",
    max_files: int | None = None,
    pattern: str | None = None,
    arrival: str | None = None,
) -> DataFrame:
    """Files landing in a folder. ``arrival`` names a column for the time at which they are read.

    That is the clock of the micro-batch, which only grows: a file that lands late with an old modification time
    is as new as any other. Files are never left out for their age.

    ``start="latest"`` begins with files that are modified from now on. A stream that is to
    be restarted gets the instant itself, so that files which landed meanwhile are read.
    ``max_files`` bounds a micro-batch.
    """
    reader = spark.readStream.schema(schema).format(fmt).option("maxFileAge", "36500d")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if start == "latest":
        start = datetime.now(timezone.utc)
    elif start != "earliest" and not isinstance(start, datetime):
        raise ValueError("start must be earliest, latest or a datetime")
    rows = reader.load(path)
    if isinstance(start, datetime):
        rows = rows.where(F.col("_metadata.file_modification_time") >= F.lit(start))
    if arrival:
        rows = rows.select("*", F.current_timestamp().alias(arrival))
    return rows


def _state_partitions(spark: SparkSession) -> str:
    """State is spread like any shuffle; a local session takes one partition per core.

    The number is fixed in the checkpoint of a query by its first run.
    """
    if spark.sparkContext.master.startswith("local"):
        return str(spark.sparkContext.defaultParallelism)
    return spark.conf.get("spark.sql.shuffle.partitions")


def run_available(stream: DataFrame, label: str, settings: dict[str, str] | None = None) -> DataFrame:
    """Runs a stream until its input is used up and returns what it wrote, as a batch table.

    ``settings`` are settings of the session that the stream starts with, whatever the session has.
    """
    spark = stream.sparkSession
    folder = shared_dir(spark, label)
    settings = {"spark.sql.shuffle.partitions": _state_partitions(spark), **(settings or {})}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        query = (
            stream.writeStream.format("parquet")
            .outputMode("append")
            .option("path", f"{folder}/table")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")


def run_latest(stream: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """Runs an aggregating stream in update mode and returns the newest row of every key.

    Every micro-batch is written to a folder of its own, so a retry does not add rows.
    """
    spark = stream.sparkSession
    folder = shared_dir(spark, label)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch={batch_id}")

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", _state_partitions(spark))
    try:
        query = (
            stream.writeStream.outputMode("update")
            .foreachBatch(store)
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    query.awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("batch", LongType())])
    updates = spark.read.schema(schema).parquet(f"{folder}/table")
    others = [c for c in stream.columns if c not in keys]
    newest = updates.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("_r"))
    return newest.select(*keys, *[F.col("_r")[c].alias(c) for c in others])


def drain(
    messages: DataFrame, checkpoint: str, route: Callable[[DataFrame, int], None]
) -> StreamingQuery:
    """Feeds everything that has landed to ``route`` and stops; the checkpoint remembers it.

    What a batch held is counted while it is routed and noted beside the checkpoint, see :func:`progress`.
    """

    def counted(batch: DataFrame, batch_id: int) -> None:
        seen = Observation(f"drained {batch_id}")
        route(batch.observe(seen, F.count("*").alias("n")), batch_id)
        n = seen.get["n"]  # route has read the batch
        note = batch.sparkSession.createDataFrame([(batch_id, n)], PROGRESS)
        note.coalesce(1).write.mode("overwrite").json(f"{checkpoint.rstrip('/')}/progress/note={batch_id}")

    query = (
        messages.writeStream.foreachBatch(counted)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


PROGRESS = "batch BIGINT, messages BIGINT"


def progress(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``batch, messages, so_far`` of a drain, over all its runs. A batch that ran twice counts once."""
    notes = spark.read.schema(PROGRESS).json(f"{checkpoint.rstrip('/')}/progress").select("batch", "messages")
    # One row per batch.
    before = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return notes.withColumn("so_far", F.sum("messages").over(before))


#: Fixed value: reads in a row that find nothing, after which a queue counts as empty.
EMPTY_READS = 10


def drain_until_empty(
    read: Callable[[], DataFrame],
    checkpoint: str,
    route: Callable[[DataFrame, int], None],
    empty_reads: int = EMPTY_READS,
    interval: float = 1.0,
) -> int:
    """Drains again and again until ``empty_reads`` reads in a row have found nothing; returns the messages routed.

    ``read`` gives the stream anew for each read; ``interval`` is the time in seconds between reads that find nothing.
    """
    empty = total = 0
    while empty < empty_reads:
        query = drain(read(), checkpoint, route)
        found = sum(p["numInputRows"] for p in query.recentProgress)
        total += found
        empty = 0 if found else empty + 1
        if not found and empty < empty_reads:
            time.sleep(interval)
    return total


def tail_to_console(stream: DataFrame, checkpoint: str, interval: str = "1 second") -> StreamingQuery:
    return (
        stream.writeStream.format("console")
        .option("truncate", "false")
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=interval)
        .start()
    )


def run_batches(
    stream: DataFrame, checkpoint: str, table: str, batches: int | None = None
) -> None:
    """Reads until the source has nothing new, or for one batch with ``batches=1``, and stops; see :func:`batch_table`.

    Every micro-batch has a folder of its own below ``table``, which a retry of that batch overwrites.
    """
    if batches not in (None, 1):
        raise ValueError("one batch or all")

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    if batches == 1:  # for a source with a limit per read, all that is available now is one read
        writer.trigger(availableNow=True).start().awaitTermination()
        return
    query = writer.trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def batch_table(spark: SparkSession, table: str, schema: StructType) -> DataFrame:
    """What :func:`run_batches` wrote, with the number of the batch."""
    return spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(table)
