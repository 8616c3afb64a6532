"""Inventory scans: column selections and filters on landed resource tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.constants import BUCKET_RESOURCE_TYPE, DEPLOYMENT_BUCKET_OUTPUT
from opsloom.sources.filters import in_regions, scope


def scan_functions(
    functions: DataFrame,
    region: str | None = None,
    name: str | None = None,
    regions: Sequence[str] | None = None,
) -> DataFrame:
    picked = in_regions(scope(functions, region, name), list(regions) if regions else None)
    return picked.select(
        "region", "function_name", "runtime", "memory_size", "code_size", "last_modified", "timeout"
    )


def scan_streams(streams: DataFrame, region: str | None = None, name: str | None = None) -> DataFrame:
    """Streams with their number of shards."""
    return scope(streams, region, name, "stream_name").select(
        "region", "stream_name", "arn", "status", F.size("shards").alias("shards")
    )


def scan_shards(streams: DataFrame, region: str | None = None, name: str | None = None) -> DataFrame:
    """One row per shard; ``monitored`` tells whether the stream has shard-level metrics."""
    return scope(streams, region, name, "stream_name").select(
        "region",
        "stream_name",
        "arn",
        "status",
        monitoring_enabled().alias("monitored"),
        F.inline("shards"),
    )


def monitoring_enabled():
    return F.coalesce(F.size("shard_level_metrics"), F.lit(0)) > 0


def scan_pc_configs(configs: DataFrame, region: str | None = None, name: str | None = None) -> DataFrame:
    """Provisioned concurrency configurations; the qualifier is the last segment of the ARN."""
    return scope(configs, region, name).select(
        "region",
        "function_name",
        F.element_at(F.split("function_arn", ":"), -1).alias("qualifier"),
        "allocated",
    )


RESOURCE_COLUMNS = ["type", "region", "id", "name", "arn", "status", "parent", "path", "bytes"]


def union_resources(tables: dict[str, DataFrame]) -> DataFrame:
    """Typed resource tables as one table with a ``type`` column; duplicates are kept."""

    def typed(kind: str, df: DataFrame) -> DataFrame:
        columns = {c: F.col(c) for c in df.columns}
        columns["type"] = F.lit(kind)
        kinds = {"bytes": "bigint"}
        return df.select(
            *[columns.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in RESOURCE_COLUMNS]
        )

    return reduce(DataFrame.unionByName, [typed(kind, df) for kind, df in tables.items()])


def scan_resources(
    resources: DataFrame, types: Sequence[str] | None = None, regions: Sequence[str] | None = None
) -> DataFrame:
    picked = in_regions(resources, list(regions) if regions else None)
    if types is not None:
        picked = picked.where(F.col("type").isin(list(types)))
    return picked.select(*RESOURCE_COLUMNS)


def stack_resources(
    stacks: DataFrame, resources: DataFrame, region: str | None = None, stack: str | None = None
) -> DataFrame:
    """Resources of stacks, with the deployment bucket named by the stack's outputs."""
    owners = scope(stacks, region, stack, "stack").select(
        "region", "stack", F.col("outputs")[DEPLOYMENT_BUCKET_OUTPUT].alias("deployment_bucket")
    )
    owned = scope(resources, region, stack, "stack")
    return owned.select("region", "stack", "resource_type", "physical_id").join(owners, ["region", "stack"])


def other_buckets(
    stacks: DataFrame, resources: DataFrame, region: str | None = None, stack: str | None = None
) -> DataFrame:
    """Buckets of stacks except the deployment bucket.

    Only stacks with a deployment bucket count: the others were not made by the framework.
    """
    buckets = resources.where(F.col("resource_type") == BUCKET_RESOURCE_TYPE)
    owned = stack_resources(stacks, buckets, region, stack)
    return owned.where(F.col("physical_id") != F.col("deployment_bucket")).select(
        "region", "stack", "deployment_bucket", F.col("physical_id").alias("bucket")
    )


def scan_versions(versions: DataFrame, app: str | None = None) -> DataFrame:
    picked = versions if app is None else versions.where(F.col("app") == app)
    return picked.select("app", "version")
