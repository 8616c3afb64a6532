"""Cold start statistics from log lines, and their report per function."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.constants import (
    COLD_START_TEXT,
    DURATION_PATTERN,
    INIT_DURATION_PATTERN,
    LOG_FUNCTION_PATTERN,
)
from opsloom.functions.text import number_or_null
from opsloom.operators.distribution import distribution_stats
from opsloom.sources.filters import Moment, moment
from opsloom.sources.metrics import scan_metrics

KEYS = ["region", "function_name", "memory_bytes"]


def parse_cold_starts(logs: DataFrame) -> DataFrame:
    """Lines that mention an init duration, parsed.

    The filter ignores case and the parse does not: a line can be counted without having
    a duration.
    """
    # Lower case and a plain search are cheaper than a pattern that ignores case.
    mentions = F.lower("message").contains(COLD_START_TEXT)
    duration = F.regexp_extract("message", DURATION_PATTERN, 1)
    init = F.regexp_extract("message", INIT_DURATION_PATTERN, 1)
    return logs.where(mentions).select(
        "region",
        F.regexp_extract("log", LOG_FUNCTION_PATTERN, 1).alias("function_name"),
        "memory_bytes",
        number_or_null(duration).alias("duration_ms"),
        number_or_null(init).alias("init_ms"),
    )


def _by_memory(parsed: DataFrame, value: str, exact: bool) -> DataFrame:
    """Statistics per region, function and memory size; the size is in MB of a million bytes."""
    stats = distribution_stats(parsed, KEYS, value, value, exact)
    others = [c for c in stats.columns if c not in (*KEYS, "n")]
    megabytes = (F.col("memory_bytes") / 1000000).alias("memory_mb")
    return stats.select("region", "function_name", megabytes, F.col("n").alias("cold_starts"), *others)


def cold_start_stats(logs: DataFrame, exact: bool = True) -> DataFrame:
    """Init duration statistics."""
    return _by_memory(parse_cold_starts(logs), "init_ms", exact)


def cold_start_total(logs: DataFrame, exact: bool = True) -> DataFrame:
    """Statistics of the whole cold start duration: run duration plus init duration."""
    total = parse_cold_starts(logs).withColumn("total_ms", F.col("duration_ms") + F.col("init_ms"))
    return _by_memory(total, "total_ms", exact)


def pc_totals(configs: DataFrame) -> DataFrame:
    """Provisioned concurrency per function, over its qualifiers."""
    return configs.groupBy("region", "function_name").agg(
        F.sum("allocated").alias("provisioned_concurrency"),
        F.count("*").alias("qualifiers"),
    )


def qualifier_utilisation(metrics: DataFrame, as_of: Moment, minutes: int = 60) -> DataFrame:
    """Highest utilisation per function and qualifier.

    The maximum of hourly maxima is the maximum of the datapoints, so no period bucket is
    formed.
    """
    end = moment(as_of)
    points = scan_metrics(
        metrics,
        "AWS/Lambda",
        ["ProvisionedConcurrencyUtilization"],
        end - timedelta(minutes=minutes),
        end,
    )
    return points.groupBy(
        "region",
        F.col("dims")["FunctionName"].alias("function_name"),
        F.element_at(F.split(F.col("dims")["Resource"], ":"), -1).alias("qualifier"),
    ).agg(F.max("value").alias("utilisation"))


def pc_report(configs: DataFrame, used: DataFrame) -> DataFrame:
    """Totals per function with the highest utilisation of its configured qualifiers.

    Utilisation of a qualifier without configuration does not count; it is zero where
    none was measured. Configurations are read once, for totals and qualifiers alike.
    """
    qualifier = ["region", "function_name", "qualifier"]
    configured = configs.groupBy(*qualifier).agg(
        F.sum("allocated").alias("allocated"), F.count("*").alias("configs")
    )
    return (
        configured.join(used, qualifier, "left")
        .groupBy("region", "function_name")
        .agg(
            F.sum("allocated").alias("provisioned_concurrency"),
            F.sum("configs").alias("qualifiers"),
            F.coalesce(F.max("utilisation"), F.lit(0.0)).alias("pc_utilisation"),
        )
    )


def cold_start_report(functions: DataFrame, stats: DataFrame, pc: DataFrame) -> DataFrame:
    """One row per function and observed memory size; functions without cold starts once.

    A memory size seen in the logs overrides the one of the inventory.
    """
    # A function without configuration has a total of zero, as its listing is empty.
    joined = functions.join(stats, ["region", "function_name"], "left").join(
        pc, ["region", "function_name"], "left"
    )
    return joined.select(
        "region",
        "function_name",
        "runtime",
        F.coalesce("memory_mb", F.col("memory_size").cast("double")).alias("memory_size"),
        "cold_starts",
        "median_init_ms",
        "p75_init_ms",
        "p95_init_ms",
        "max_init_ms",
        "stddev_init_ms",
        F.coalesce("provisioned_concurrency", F.lit(0)).alias("provisioned_concurrency"),
        F.coalesce("pc_utilisation", F.lit(0.0)).alias("pc_utilisation"),
    )


def order_report(report: DataFrame) -> DataFrame:
    """Functions with cold starts first, most and slowest on top."""
    has = F.coalesce(F.col("cold_starts"), F.lit(0)) > 0
    return report.orderBy(
        F.desc(has),
        F.desc_nulls_last("cold_starts"),
        F.desc_nulls_last("median_init_ms"),
        "region",
        "function_name",
        "memory_size",
    )
