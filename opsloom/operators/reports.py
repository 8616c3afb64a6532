"""Printed forms of the reports: names cut, missing values as dashes, sizes and ages as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.constants import DEPRECATED_RUNTIMES
from opsloom.functions import text
from opsloom.sources.filters import Moment, moment


def cold_start_table(report: DataFrame) -> DataFrame:
    durations = {
        "median init": "median_init_ms",
        "p75": "p75_init_ms",
        "p95": "p95_init_ms",
        "max init": "max_init_ms",
        "std dev": "stddev_init_ms",
    }
    return report.select(
        "region",
        text.trunc_name(F.col("function_name"), 45).alias("name"),
        "runtime",
        F.col("memory_size").alias("memory"),
        text.or_dash(F.col("cold_starts")).alias("count"),
        *[text.or_dash(F.col(c)).alias(n) for n, c in durations.items()],
        text.init_band(F.col("median_init_ms")).alias("rating"),
        text.or_dash(F.col("provisioned_concurrency")).alias("provisioned concurrency (PC)"),
        text.util_text(F.col("pc_utilisation")).alias("PC utilization"),
    )


def cost_table(report: DataFrame, days: int = 30) -> DataFrame:
    return report.select(
        "region",
        text.trunc_name(F.col("function_name"), 40).alias("name"),
        "runtime",
        F.col("memory_size").alias("memory"),
        text.cost_text(F.col("total_cost")).alias(f"{days} day ($)"),
        F.col("invocation_count").cast("bigint").alias("invocations"),
        text.cost_text(F.col("average_cost")).alias("avg ($)/invocation"),
    )


def activity_table(report: DataFrame, as_of: Moment) -> DataFrame:
    now = F.lit(moment(as_of).strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")
    used = F.when(F.col("is_inactive"), "inactive for 30 days").otherwise(text.age_text(F.col("last_used"), now))
    return report.select(
        "region",
        text.trunc_name(F.col("function_name"), 50).alias("name"),
        "runtime",
        F.col("runtime").isin(DEPRECATED_RUNTIMES).alias("deprecated"),
        F.col("memory_size").alias("memory"),
        text.human_size(F.col("code_size")).alias("code size"),
        text.age_text(F.col("last_modified"), now).alias("last modified"),
        used.alias("last used"),
    )


def stream_table(report: DataFrame) -> DataFrame:
    def pair(kind: str):
        megabytes, records = text.percent_text(F.col(f"{kind}_mb_pct")), text.percent_text(F.col(f"{kind}_records_pct"))
        return F.concat(megabytes, F.lit("% (MB) "), records, F.lit("% (Records)"))

    return report.select(
        F.col("stream_name").alias("Stream name"),
        F.col("region").alias("Region"),
        F.col("shards").alias("Shards"),
        pair("read").alias("Read utilization"),
        pair("write").alias("Write utilization"),
        F.col("status").alias("Status"),
    )


def shard_table(report: DataFrame) -> DataFrame:
    measured = [c for c in report.columns if c not in ("region", "stream_name", "shard_id", "status")]
    return report.select(
        text.strip_shard_prefix(F.col("shard_id")).alias("ShardId"), text.details_json(*measured).alias("Details")
    )
