"""Delivery of messages to a queue, topic or stream, with a result per message.

A ``sender`` is any picklable callable that takes a list of entry dicts and returns
``{entry_id: error}`` for those that were refused; an exception refuses the whole list.
It runs inside the tasks. Without a sender, messages land as JSON files. Delivery is at
least once: a retried task sends its batches again, with the same ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from opsloom.constants import BATCH_MAX_BYTES
from opsloom.functions.text import string_attributes
from opsloom.operators.messages import failed_entries, remaining, replay_rows

Sender = Callable[[list[dict]], dict[str, str]]
RESULTS = "entry_id STRING, status STRING, error STRING"


def batch_entries(packed: DataFrame, body: str = "line") -> DataFrame:
    """One row per batch; the packing bounds the number and size of its entries."""
    entry = F.struct("entry_id", F.col(body).alias("body"), "n_bytes")
    return packed.groupBy("file", "batch_id").agg(F.sort_array(F.collect_list(entry)).alias("entries"))


def size_error(n_bytes: Column, max_bytes: int = BATCH_MAX_BYTES) -> Column:
    """A message that reaches the byte limit on its own is refused."""
    return F.when(n_bytes >= max_bytes, F.lit("message is too long"))


def landing_results(packed: DataFrame, max_bytes: int = BATCH_MAX_BYTES) -> DataFrame:
    error = size_error(F.col("n_bytes"), max_bytes)
    return packed.select(
        "entry_id", F.when(error.isNull(), "success").otherwise("fail").alias("status"), error.alias("error")
    )


@contextmanager
def arrow_rows(spark: SparkSession, rows: int = 256) -> Iterator[None]:
    """Limits the rows handed to Python at once: each can hold a full batch of text."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _send(batch: list[dict], sender: Sender) -> list[str | None]:
    """The error of every entry of a batch, none for those that were accepted."""
    try:
        refused = sender(batch) or {}
    except Exception as error:  # the whole batch failed, the run continues
        refused = {e["entry_id"]: str(error) for e in batch}
    return [refused.get(e["entry_id"]) for e in batch]


def _result_frame(ids: list[str], errors: list[str | None]) -> pd.DataFrame:
    status = ["success" if e is None else "fail" for e in errors]
    return pd.DataFrame({"entry_id": ids, "status": status, "error": pd.Series(errors, dtype="object")})


def deliver(batches: DataFrame, sender: Sender) -> DataFrame:
    """Hands every batch to the sender and returns a result row per entry."""

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, errors = [], []
            for entries in frame["entries"]:
                batch = [dict(e) for e in entries]
                ids.extend(e["entry_id"] for e in batch)
                errors.extend(_send(batch, sender))
            yield _result_frame(ids, errors)

    return batches.select("entries").mapInPandas(send, RESULTS)


# Messages per request of each target.
REQUEST_SIZE = {"queue": 10, "topic": 1, "stream": 10}


def deliver_messages(messages: DataFrame, target_type: str, sender: Sender) -> DataFrame:
    """Hands messages on as they come, in requests of the target's size.

    An entry is the replayed row as a dict, with the message id as ``entry_id``.
    """
    rows = replay_rows(messages, target_type)
    names = rows.columns
    id_column = {"queue": "message_id", "stream": "partition_key"}.get(target_type)
    if id_column is None:
        rows = messages.select(
            F.col("message_id").alias("entry_id"), "body", string_attributes(F.col("attributes")).alias("attributes")
        )
    else:
        rows = rows.select(F.col(id_column).alias("entry_id"), *names)
    size = REQUEST_SIZE[target_type]

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            entries = frame.to_dict("records")
            errors = []
            for start in range(0, len(entries), size):
                errors.extend(_send(entries[start : start + size], sender))
            yield _result_frame([e["entry_id"] for e in entries], errors)

    return rows.mapInPandas(send, RESULTS)


def to_queue(
    packed: DataFrame, path: str, sender: Sender | None = None, max_bytes: int = BATCH_MAX_BYTES
) -> tuple[DataFrame, DataFrame]:
    """Sends packed lines in their batches; returns ``(results, failures with body)``.

    Packed lines and results are written below ``path`` before they are read, so packing runs
    once and nothing is sent twice when both tables are used.
    """
    sent = Observation("sent")
    packed.write.parquet(f"{path}/entries")
    packed = packed.sparkSession.read.parquet(f"{path}/entries")
    if sender is None:
        error = size_error(F.col("n_bytes"), max_bytes)
        batch_entries(packed.where(error.isNull())).write.json(f"{path}/messages")
        results = landing_results(packed, max_bytes)
    else:
        results = deliver(batch_entries(packed), sender)
    counted = results.observe(sent, F.count("*").alias("processed"))
    with arrow_rows(packed.sparkSession):
        counted.write.parquet(f"{path}/results")
    print(f"sent {sent.get['processed']} messages")
    stored = packed.sparkSession.read.parquet(f"{path}/results")
    return stored, failed_entries(stored, packed)


def to_topic(
    lines: DataFrame, path: str, sender: Sender | None = None, concurrency: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Publishes every line on its own; ``concurrency`` limits the tasks that do so.

    Entries are written below ``path`` with their ids and read from there, so ids and texts are those of one
    reading of the lines.
    """
    keys = [c for c in lines.columns if c != "line"]
    entry_id = F.sha2(F.concat_ws(":", *[F.col(k).cast("string") for k in keys]), 256)
    entries = lines.select("line", F.octet_length("line").alias("n_bytes"), entry_id.alias("entry_id"))
    entries.write.parquet(f"{path}/entries")
    entries = lines.sparkSession.read.parquet(f"{path}/entries")
    if sender is None:
        entries.select(F.col("line").alias("message"), "entry_id").write.json(f"{path}/messages")
        results = landing_results(entries)
    else:
        single = entries.select(
            F.array(F.struct("entry_id", F.col("line").alias("body"), "n_bytes")).alias("entries")
        )
        results = deliver(single.repartition(concurrency) if concurrency else single, sender)
    sent = Observation("published")
    counted = results.observe(sent, F.count("*").alias("processed"))
    with arrow_rows(lines.sparkSession):
        counted.write.parquet(f"{path}/results")
    print(f"sent {sent.get['processed']} messages")
    stored = lines.sparkSession.read.parquet(f"{path}/results")
    return stored, failed_entries(stored, entries)


def write_target(rows: DataFrame, target_type: str, path: str, mode: str = "append") -> None:
    """Lands replayed rows; stream records are clustered by their partition key."""
    if target_type == "stream":
        rows = rows.repartition("partition_key")
    rows.write.mode(mode).json(path)


def replay(
    messages: DataFrame, target_type: str, path: str, keep: bool = False, sender: Sender | None = None
) -> DataFrame:
    """Replays a dead-letter queue into a target and returns the messages left in it.

    With a sender, results are stored below ``path`` and refused messages are left as well.
    """
    if sender is None:
        write_target(replay_rows(messages, target_type), target_type, path)
        return remaining(messages, messages, keep)
    with arrow_rows(messages.sparkSession):
        deliver_messages(messages, target_type, sender).write.parquet(f"{path}/results")
    results = messages.sparkSession.read.parquet(f"{path}/results")
    accepted = results.where(F.col("status") == "success").select(F.col("entry_id").alias("message_id"))
    return remaining(messages, accepted, keep)


def replay_router(
    target_type: str, path: str, sender: Sender | None = None, replay: str | None = None
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function of a streaming replay.

    Every batch of every replay has its own folder that a retry overwrites, so a batch that runs twice is
    stored once. A replay is known by the id in its checkpoint: a restart goes on in its folder, and replays of
    other queues, or from a new checkpoint, never overwrite it; ``replay`` names it otherwise. With a sender the folders hold the results.
    """

    def route(batch: DataFrame, batch_id: int) -> None:
        replay_id = replay or batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not replay_id:
            raise RuntimeError("name the replay of a batch that is not part of a stream")
        folder = f"{path}/replay={replay_id}/batch={batch_id}"
        if sender is None:
            write_target(replay_rows(batch, target_type), target_type, folder, mode="overwrite")
            return
        with arrow_rows(batch.sparkSession):
            deliver_messages(batch, target_type, sender).write.mode("overwrite").json(folder)

    return route
