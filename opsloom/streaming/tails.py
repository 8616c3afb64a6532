"""Stream tails: unbounded input, decoded and filtered; start position and progress are the source's.

Each tail is a transformation of a streaming DataFrame (or of a batch one, with the same
rows). ``seen_at`` is the processing time of the micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.functions import envelopes
from opsloom.operators.metrics import STATS, dim


def stamp(df: DataFrame) -> DataFrame:
    return df.withColumn("seen_at", F.current_timestamp())


def tail_logs(
    logs: DataFrame, group: str | None = None, condition: str | None = None, region: str | None = None
) -> DataFrame:
    """Log events of a group, optionally only those of a region and those that meet a SQL condition.

    Events are never skipped for being late: the source remembers which files were read,
    not how far the clock had come.
    """
    events = logs if region is None else logs.where(F.col("region") == region)
    if group is not None:
        events = events.where(F.col("log").endswith(f":{group}"))
    if condition is not None:
        events = events.where(condition)
    return events.select("ts", "message")


def tail_changes(records: DataFrame, body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    return envelopes.decode_change(records, body, keep)


def tail_records(records: DataFrame, data: str = "data", keep: tuple[str, ...] = ()) -> DataFrame:
    return envelopes.decode_record(records, data, keep)


def tail_topic(messages: DataFrame, body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    return envelopes.decode_topic(messages, body, keep)


def tail_events(
    messages: DataFrame,
    source: str | None = None,
    detail_type: str | None = None,
    not_source: str | None = None,
    body: str = "body",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Events that match a rule, or every event of a bus but those of one source."""
    events = envelopes.decode_event(messages, body, keep)
    if source is not None:
        events = events.where(F.col("source") == source)
    if detail_type is not None:
        events = events.where(F.col("detail_type") == detail_type)
    if not_source is not None:
        events = events.where(F.col("source") != not_source)
    return events


# The same tails under their older names.
tail_cloudwatch_events_rule = tail_events
tail_cloudwatch_events_bus = tail_events


def tail_queue(
    messages: DataFrame, arrival: str = "received_at", horizon: str = "1 hour", keep: tuple[str, ...] = ()
) -> DataFrame:
    """First sighting of every message; redeliveries within the horizon are dropped.

    ``arrival`` must be the time at which a message is read, which only grows (see ``read_stream``). With an
    event time or the modification time of a file, messages that are older than the horizon but were never
    seen would be lost.
    """
    if messages.isStreaming:
        first = messages.withWatermark(arrival, horizon).dropDuplicatesWithinWatermark(["message_id"])
    else:
        first = messages.dropDuplicates(["message_id"])
    return first.select(*keep, "message_id", "body", "attributes")


def metric_stat_stream(
    points: DataFrame, period: str, stat: str, dims: dict[str, str], delay: str = "10 minutes"
) -> DataFrame:
    """Period rollup of a stream of datapoints.

    Datapoints later than ``delay`` behind the newest one are dropped. In append mode a
    period appears once it is closed; in update mode it is refined until then.
    """
    return (
        points.withWatermark("ts", delay)
        .groupBy(
            "region",
            "metric",
            *[dim(d).alias(c) for c, d in dims.items()],
            F.window("ts", period).alias("period"),
        )
        .agg(STATS[stat]("value").alias("value"))
        .select("region", "metric", *dims, F.col("period.start").alias("bucket_start"), "value")
    )
