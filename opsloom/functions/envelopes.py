"""Projections of message envelopes. Each works on batch and streaming DataFrames alike.

``keep`` names columns of the input that stay in front of the decoded ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom import schemas
from opsloom.functions.payload import decode_payload


def decode_topic(df: DataFrame, body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    envelope = df.withColumn("_e", F.from_json(body, schemas.TOPIC_ENVELOPE))
    return envelope.select(
        *keep,
        F.col("_e.Subject").alias("subject"),
        F.col("_e.Timestamp").alias("timestamp"),
        F.col("_e.Message").alias("message"),
        F.col("_e.MessageAttributes").alias("message_attributes"),
    )


def decode_event(df: DataFrame, body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """``detail`` is kept as the JSON text that was given."""
    envelope = df.withColumn("_e", F.from_json(body, schemas.EVENT_ENVELOPE))
    return envelope.select(
        *keep,
        F.col("_e.time").alias("time"),
        F.col("_e.region").alias("region"),
        F.col("_e.source").alias("source"),
        F.col("_e.resources").alias("resources"),
        F.col("_e.`detail-type`").alias("detail_type"),
        F.col("_e.detail").alias("detail"),
    )


def decode_queue(df: DataFrame) -> DataFrame:
    return df.select("message_id", "body", "attributes")


def _plain_image(image):
    """``{name: {type: text}}`` as ``{name: text}``: each value has one type tag."""
    return F.transform_values(image, lambda _, tagged: F.get(F.map_values(tagged), F.lit(0)))


def decode_change(df: DataFrame, body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """Change records with keys and images flattened to plain maps; the sequence number stays text."""
    record = df.withColumn("_c", F.from_json(body, schemas.CHANGE_RECORD))
    return record.select(
        *keep,
        F.col("_c.eventID").alias("event_id"),
        F.col("_c.eventName").alias("event_name"),
        F.col("_c.dynamodb.SequenceNumber").alias("sequence_number"),
        F.col("_c.dynamodb.SizeBytes").alias("size_bytes"),
        F.col("_c.dynamodb.StreamViewType").alias("view_type"),
        _plain_image(F.col("_c.dynamodb.Keys")).alias("keys"),
        _plain_image(F.col("_c.dynamodb.NewImage")).alias("new_image"),
        _plain_image(F.col("_c.dynamodb.OldImage")).alias("old_image"),
    )


def decode_record(df: DataFrame, data: str = "data", keep: tuple[str, ...] = ()) -> DataFrame:
    """Record payloads as text; ``is_json`` tells whether the text parses."""
    decoded = df.withColumn("text", decode_payload(F.col(data)))
    return decoded.select(
        *keep,
        "shard_id",
        "sequence_number",
        "text",
        F.try_parse_json("text").isNotNull().alias("is_json"),
    )
