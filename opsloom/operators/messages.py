"""Projections of queue messages for replay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.functions.text import string_attributes

TARGETS = ("queue", "topic", "stream")


def first_deliveries(messages: DataFrame) -> DataFrame:
    """One row per message id; a queue may deliver a message again."""
    return messages.dropDuplicates(["message_id"])


def replay_rows(messages: DataFrame, target_type: str = "queue") -> DataFrame:
    """Messages in the shape of their target.

    A queue keeps the id; a topic has none; a stream record has the id as partition key and
    no attributes. Only attributes of type String can be sent on.
    """
    attributes = string_attributes(F.col("attributes")).alias("attributes")
    if target_type == "queue":
        return messages.select("message_id", "body", attributes)
    if target_type == "topic":
        return messages.select("body", attributes)
    if target_type == "stream":
        return messages.select(F.col("body").alias("data"), F.col("message_id").alias("partition_key"))
    raise ValueError(f"target type must be one of {TARGETS}")


def remaining(messages: DataFrame, replayed: DataFrame, keep: bool = False) -> DataFrame:
    """Messages left in the queue after a replay; all of them when they are kept."""
    return messages if keep else messages.join(replayed.select("message_id"), "message_id", "left_anti")


def failed_entries(results: DataFrame, entries: DataFrame, body: str = "line") -> DataFrame:
    """Failed sends with the body that was not accepted."""
    failed = results.where(F.col("status") == "fail").select("entry_id", "error")
    return failed.join(entries.select("entry_id", F.col(body).alias("body")), "entry_id")
