"""Metric datapoint scans over the long table ``(region, namespace, metric, dims, ts, value)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.sources.filters import Moment, between


def scan_metrics(
    metrics: DataFrame,
    namespace: str,
    names: list[str],
    start: Moment,
    end: Moment,
    dims: dict[str, str] | None = None,
) -> DataFrame:
    """Datapoints of some metrics in a time range, optionally for given dimension values."""
    points = between(metrics, start, end).where(
        (F.col("namespace") == namespace) & F.col("metric").isin(names)
    )
    for name, value in (dims or {}).items():
        points = points.where(F.col("dims")[name] == value)
    return points


def series_to_points(series: DataFrame) -> DataFrame:
    """Parallel arrays of times and values as one row per datapoint; empty series give no row."""
    return series.select("label", F.inline(F.arrays_zip("timestamps", "values"))).select(
        "label", F.col("timestamps").alias("ts"), F.col("values").alias("value")
    )
