"""Log event scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.sources.filters import Moment, between


def group_names(logs: DataFrame) -> DataFrame:
    """Log groups present in the table, by region. ``log`` is ``<account>:<group>``."""
    group = F.regexp_replace("log", r"^[^/]*:", "").alias("log_group")
    return logs.select("region", group).distinct()


def listed_groups(resources: DataFrame) -> DataFrame:
    """Log groups that exist, by region, from an inventory: no log is read, and a group without events is one too."""
    return resources.where(F.col("type") == "log_group").select("region", F.col("name").alias("log_group")).distinct()


def missing_groups(groups: DataFrame, existing: DataFrame) -> DataFrame:
    """Requested ``(region, log_group)`` rows that do not exist."""
    return groups.select("region", "log_group").distinct().join(existing, ["region", "log_group"], "left_anti")


def scan_logs(
    logs: DataFrame,
    start: Moment,
    end: Moment,
    groups: DataFrame | None = None,
) -> DataFrame:
    """Events of a time range, of the requested groups only when they are given.

    Groups that do not exist contribute no rows; ``missing_groups`` names them.
    """
    events = between(logs, start, end)
    if groups is None:
        return events
    wanted = groups.select("region", "log_group").distinct()
    keyed = events.withColumn("log_group", F.regexp_replace("log", r"^[^/]*:", ""))
    return keyed.join(wanted, ["region", "log_group"], "left_semi").drop("log_group")
