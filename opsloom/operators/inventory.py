"""Nested resource documents, counts, cleanup plans and action results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.constants import DELETABLE_STACK_STATUS, SERVICE_ROLE_PATH
from opsloom.sources.filters import Moment, moment

#: What a row is: a resource, or one of its children, named by their kind.
RESOURCE = "resource"


def _fields(df: DataFrame, keys: list[str]) -> Column:
    return F.struct(*[c for c in df.columns if c not in keys])


def _same(keys: list[str], left: str, right: str) -> Column:
    return reduce(Column.__and__, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def nest(
    parents: DataFrame,
    keys: list[str],
    many: dict[str, DataFrame],
    single: dict[str, DataFrame] | None = None,
    tags: DataFrame | None = None,
) -> DataFrame:
    """Resources with their children, at one grain whatever their number: a row per resource and a row per child.

    ``kind`` is ``resource`` for a row with the parent's own columns, its ``tags`` as a map and of each ``single`` table the
    first entry as a struct; a resource has few of both. For the others it is the name of a ``many`` table, and the
    column of that name has the child as a struct. Children without parent are dropped.

    Parents meet what is single-valued in one shuffle, and the children of all kinds meet the keys of the parents in
    another, where those of a hot parent can be split over tasks.
    """
    own = [c for c in parents.columns if c not in keys]
    rows = [parents.select(*keys, F.struct(F.lit(True).alias("_is"), *own).alias("_parent"))]
    for name, df in (single or {}).items():
        rows.append(df.select(*keys, _fields(df, keys).alias(name)))
    if tags is not None:
        rows.append(last_tags(tags, keys).select(*keys, F.struct("key", "value").alias("tags")))
    tall = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    # Structs with maps have no order of their own, so the text of an entry decides which is first.
    firsts = [F.min_by(name, F.to_json(name)).alias(name) for name in single or {}]
    maps = [F.map_from_entries(F.collect_list("tags")).alias("tags")] if tags is not None else []
    resources = tall.groupBy(*keys).agg(F.first("_parent", ignorenulls=True).alias("_parent"), *maps, *firsts)
    resources = resources.where(F.col("_parent").isNotNull()).select(
        *keys,
        F.lit(RESOURCE).alias("kind"),
        *[F.col("_parent")[c].alias(c) for c in own],
        *[c for c in resources.columns if c not in (*keys, "_parent")],
    )
    if not many:
        return resources
    kinds = [df.select(*keys, F.lit(name).alias("kind"), _fields(df, keys).alias(name)) for name, df in many.items()]
    children = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kinds)
    known = parents.select(*keys).distinct()
    children = children.alias("l").join(known.alias("r"), _same(keys, "l", "r"), "left_semi")
    return resources.unionByName(children, allowMissingColumns=True)


def last_tags(tags: DataFrame, keys: list[str]) -> DataFrame:
    """One value per resource and tag key; the last of equal keys (by ``pos``) wins."""
    return tags.groupBy(*keys, "key").agg(F.max_by("value", "pos").alias("value"))


def inventory_functions(
    functions: DataFrame,
    tags: DataFrame,
    mappings: DataFrame,
    pc_configs: DataFrame,
    invoke_configs: DataFrame | None = None,
    policies: DataFrame | None = None,
) -> DataFrame:
    """Functions with tags and, when their tables are given, the first invoke configuration and the policy; event source
    mappings and provisioned concurrency as rows of their own."""
    given = {"event_invoke_config": invoke_configs, "policy": policies}
    single = {name: df for name, df in given.items() if df is not None}
    many = {"event_source_mappings": mappings, "provisioned_concurrency_configs": pc_configs}
    return nest(functions, ["region", "function_name"], many, single, tags)


def inventory_tables(tables: DataFrame, tags: DataFrame, capacity: DataFrame) -> DataFrame:
    """Tables with tags; the capacity values of each day as rows of their own."""
    keys = ["region", "table_name"]
    daily = capacity.select(
        *keys, "day", "consumed_read", "consumed_write", "provisioned_read", "provisioned_write"
    )
    return nest(tables, keys, {"metrics": daily}, tags=tags)


def inventory_topics(topics: DataFrame, tags: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Topics with tags; subscriptions as rows of their own."""
    return nest(topics, ["region", "topic_arn"], {"subscriptions": subscriptions}, tags=tags)


def queue_sources(queues: DataFrame) -> DataFrame:
    """``(region, queue_arn, source_queue_url)``: queues that name another one as dead-letter target."""
    target = F.get_json_object("redrive_policy", "$.deadLetterTargetArn")
    return queues.where(target.isNotNull()).select(
        "region", target.alias("queue_arn"), F.col("queue_url").alias("source_queue_url")
    )


def inventory_queues(queues: DataFrame, tags: DataFrame) -> DataFrame:
    """Queues with tags; the queues that use them as dead-letter target as rows of their own.

    ``source_totals`` of a queue has the number of those rows and the characters of their URLs; it is null without any.
    """
    keys, sources = ["region", "queue_arn"], queue_sources(queues)
    totals = sources.groupBy(*keys).agg(
        F.count("*").alias("sources"), F.sum(F.length("source_queue_url")).alias("url_chars")
    )
    return nest(queues, keys, {"source_queues": sources}, {"source_totals": totals}, tags)


def inventory_report(documents: dict[str, DataFrame]) -> DataFrame:
    """All documents, one JSON text per row, under their resource type.

    Written with ``partitionBy("type")`` this is one document set per type; a single text
    of a whole account would have to pass through one task.
    """

    def typed(kind: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(kind).alias("type"), "region", F.to_json(F.struct("*")).alias("document"))

    return reduce(DataFrame.unionByName, [typed(k, d) for k, d in documents.items()])


def resource_counts(resources: DataFrame, by_region: bool = False) -> DataFrame:
    """Resources per type; ``by_region`` adds a row per region below each type's total."""
    if by_region:
        counted = resources.rollup("type", "region").agg(F.count("*").alias("resources"))
        return counted.where(F.col("type").isNotNull())
    return resources.groupBy("type").agg(F.count("*").alias("resources"))


# Order in which the types of an account are cleared.
CLEANUP_STEPS = [
    "bucket",
    "event_bus",
    "stack",
    "api",
    "role",
    "function",
    "log_group",
    "nat_gateway",
    "policy",
]


def deletable_stacks() -> Column:
    return F.col("status").isin(DELETABLE_STACK_STATUS)


def deletable_roles() -> Column:
    return ~F.coalesce(F.col("path"), F.lit("")).startswith(SERVICE_ROLE_PATH)


def deletable_buses() -> Column:
    return F.col("name") != "default"


def local_policies() -> Column:
    """The scope of a policy is kept in ``status``."""
    return F.col("status") == "Local"


def cleanup_plan(resources: DataFrame) -> DataFrame:
    """What a cleanup would remove, in which step. Nothing is removed here."""
    kind = F.when(F.col("type").isin("http_api", "rest_api"), "api").otherwise(F.col("type"))
    step = F.array_position(F.array(*[F.lit(s) for s in CLEANUP_STEPS]), kind)
    rule = (
        F.when(kind == "stack", deletable_stacks())
        .when(kind == "role", deletable_roles())
        .when(kind == "event_bus", deletable_buses())
        .when(kind == "policy", local_policies())
        .otherwise(True)
    )
    return resources.where((step > 0) & rule).select(
        step.cast("int").alias("step"), "type", "region", "id", "name"
    )


def last_attempt(results: DataFrame) -> DataFrame:
    """Outcome of the last attempt per resource."""
    return results.groupBy("type", "region", "name").agg(
        F.max("attempt").alias("attempt"),
        F.max_by(F.struct("status", "reason"), "attempt").alias("_last"),
    ).select("type", "region", "name", "attempt", "_last.status", "_last.reason")


def failure_summary(results: DataFrame, has_region: bool = True) -> DataFrame:
    """Failed resources with their reason (the last attempt's), and how many of their type failed."""
    name = F.col("name")
    located = F.concat(name, F.lit(" ["), F.col("region"), F.lit("]"))
    key = F.coalesce(located, name) if has_region else name  # global resources have no region
    failed = (
        results.where(F.col("status") == "fail")
        .groupBy("type", key.alias("key"))
        .agg(F.max_by("reason", "attempt").alias("reason"))
    )
    # Counted by its reason, a failure is the same row in both branches and found only once.
    failures = F.count("reason") + F.count_if(F.col("reason").isNull())
    counts = failed.groupBy("type").agg(failures.alias("failed_count"))
    return failed.join(counts, "type").select("type", "key", "reason", "failed_count")


def with_children(parents: DataFrame, children: DataFrame, keys: list[str]) -> DataFrame:
    """Left outer join, as an inner join and the parents without children.

    The children of a hot parent can be split over tasks in an inner join, which an outer
    join does not allow.
    """
    matched = parents.join(children, keys)
    childless = parents.join(children.select(*keys).distinct(), keys, "left_anti")
    return matched.unionByName(childless, allowMissingColumns=True)


def bus_targets(buses: DataFrame, rules: DataFrame, targets: DataFrame) -> DataFrame:
    """Bus, its rules and their targets; a bus without rules and a rule without targets stay.

    Every rule is in the tree of rules and targets, so a bus without rules is found by the rules alone: each
    table is read for its own level and for the keys of the one above.
    """
    keys, above = ["region", "bus", "rule"], ["region", "bus"]
    ruled = with_children(rules.select(*keys), targets.select(*keys, "target"), keys)
    matched = buses.select(*above).join(ruled, above)
    childless = buses.select(*above).join(rules.select(*above).distinct(), above, "left_anti")
    return matched.unionByName(childless, allowMissingColumns=True)


def role_policies(roles: DataFrame, attached: DataFrame, inline: DataFrame) -> DataFrame:
    """Roles with attached and inline policies; a role without policies stays."""
    policies = attached.select("role", "policy", F.lit("attached").alias("kind")).unionByName(
        inline.select("role", "policy", F.lit("inline").alias("kind"))
    )
    return with_children(roles.select("role"), policies, ["role"])


def recent_log_streams(logs: DataFrame, k: int = 50, since: Moment | None = None) -> DataFrame:
    """The ``k`` log streams per group with the newest events, of those with events ``since`` a time.

    With a time, older partitions of the logs are not read.

    The rank filter is applied before the shuffle as well, so a group with many streams
    sends at most ``k`` rows per task.
    """
    if since is not None:
        logs = logs.where(F.col("ts") >= F.lit(moment(since)).cast(logs.schema["ts"].dataType))
    last = logs.groupBy("region", "log", "log_stream").agg(F.max("ts").alias("last_event"))
    newest = Window.partitionBy("region", "log").orderBy(F.desc("last_event"), "log_stream")
    return last.withColumn("position", F.row_number().over(newest)).where(F.col("position") <= k)
