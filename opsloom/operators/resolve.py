"""Resolution of names to exactly one resource. Each looks at no more rows than it needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exact_queues(queues: DataFrame, name: str) -> DataFrame:
    """Queues whose last URL segment is the name, not those that merely start with it."""
    return queues.where(F.element_at(F.split("queue_url", "/"), -1) == name)


def topics_named(topics: DataFrame, name: str) -> DataFrame:
    return topics.where(F.col("topic_arn").endswith(f":{name}"))


def _only(df: DataFrame, column: str, what: str) -> str:
    rows = df.select(column).distinct().limit(2).collect()
    if not rows:
        raise LookupError(f"cannot find {what}")
    if len(rows) > 1:
        raise LookupError(f"there is more than one of {what}, such as {rows[0][0]} and {rows[1][0]}")
    return rows[0][0]


def resolve_queue(queues: DataFrame, name: str) -> str:
    return _only(exact_queues(queues, name), "queue_url", f"the queue [{name}]")


def resolve_topic(topics: DataFrame, name: str) -> str:
    return _only(topics_named(topics, name), "topic_arn", f"the topic [{name}]")


def _place(found: DataFrame, what: str) -> str:
    """Where the messages of a resource land (``landed``); one that has no such place is an error."""
    if "landed" not in found.columns:
        raise LookupError(f"the table does not say where {what} lands")
    return _only(found.where(F.col("landed").isNotNull()), "landed", f"a place where {what} lands")


def queue_place(queues: DataFrame, name: str) -> str:
    resolve_queue(queues, name)
    return _place(exact_queues(queues, name), f"the queue [{name}]")


def topic_place(topics: DataFrame, name: str) -> str:
    resolve_topic(topics, name)
    return _place(topics_named(topics, name), f"the topic [{name}]")


def stream_place(streams: DataFrame, name: str) -> str:
    named = streams.where(F.col("stream_name") == name)
    _only(named, "stream_name", f"the stream [{name}]")
    return _place(named, f"the stream [{name}]")


def groups_named(groups: DataFrame, prefix: str) -> DataFrame:
    """Log groups that begin with a name."""
    return groups.where(F.col("log_group").startswith(prefix)).select("region", "log_group").distinct()


def resolve_group(groups: DataFrame, prefix: str, shown: int = 50) -> str:
    """The log group of a name, else the one with that prefix; an error names candidates if there are several."""
    if not groups.where(F.col("log_group") == prefix).isEmpty():
        return prefix
    matching = groups.where(F.col("log_group").startswith(prefix)).select("log_group").distinct()
    names = [r[0] for r in matching.orderBy("log_group").limit(shown + 1).collect()]
    if not names:
        raise LookupError(f"no log group starts with [{prefix}]")
    if len(names) > shown:
        raise LookupError(f"more than {shown} log groups start with [{prefix}]")
    if len(names) > 1:
        raise LookupError(f"several log groups start with [{prefix}]: {', '.join(names)}")
    return names[0]


def disabled_rules(rules: DataFrame) -> DataFrame:
    """Rules that will not deliver events until they are enabled."""
    return rules.where(F.col("state") != "ENABLED")
