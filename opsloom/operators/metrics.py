"""Period rollups of metric datapoints and reports built on them."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.constants import (
    COST_PER_100MS,
    COST_PER_REQUEST,
    SHARD_METRICS,
    SHARD_READ_BYTES,
    SHARD_READ_RECORDS,
    SHARD_WRITE_BYTES,
    SHARD_WRITE_RECORDS,
    STREAM_METRICS,
    TABLE_METRICS,
)
from opsloom.functions.text import metric_name, split_label
from opsloom.sources.filters import Moment, moment
from opsloom.sources.metrics import scan_metrics

STATS = {"Sum": F.sum, "Average": F.avg, "Maximum": F.max}


def dim(name: str) -> Column:
    return F.col("dims")[name]


def metric_stat(points: DataFrame, period: str, stat: str, dims: dict[str, str]) -> DataFrame:
    """One value per dimension values and period. ``dims`` maps output columns to dimensions."""
    return points.groupBy(
        "region",
        "metric",
        *[dim(d).alias(c) for c, d in dims.items()],
        F.window("ts", period)["start"].alias("bucket_start"),
    ).agg(STATS[stat]("value").alias("value"))


def latest_value(stats: DataFrame, keys: list[str], ts: str = "bucket_start", value: str = "value") -> DataFrame:
    """Value of the newest datapoint per key."""
    return stats.groupBy(*keys).agg(
        F.max(ts).alias(ts),
        F.max_by(value, ts).alias(value),
    )


def pivot_metrics(values: DataFrame, keys: list[str], names: dict[str, str]) -> DataFrame:
    """Rows ``(keys, metric, value)`` as one row per key; ``names`` maps metrics to columns.

    The columns are known, so this is one aggregation and needs no pass that finds them.
    """
    return values.groupBy(*keys).agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(c) for m, c in names.items()]
    )


def lambda_totals(metrics: DataFrame, as_of: Moment, days: int = 30) -> DataFrame:
    """Invocations and total duration per function, both in one aggregation."""
    end = moment(as_of)
    points = scan_metrics(metrics, "AWS/Lambda", ["Invocations", "Duration"], end - timedelta(days=days), end)
    of = lambda name: F.coalesce(F.sum(F.when(F.col("metric") == name, F.col("value"))), F.lit(0.0))
    return points.groupBy("region", dim("FunctionName").alias("function_name")).agg(
        of("Invocations").alias("invocation_count"),
        of("Duration").alias("total_duration_ms"),
    )


def invocation_cost(average_ms: Column, memory_mb: Column) -> Column:
    """Price of one invocation: started 100 ms by memory, plus the request."""
    return F.ceil(average_ms / 100) * (memory_mb / 128) * COST_PER_100MS + COST_PER_REQUEST


def lambda_cost(functions: DataFrame, metrics: DataFrame, as_of: Moment, days: int = 30) -> DataFrame:
    """Cost per function; functions without invocations cost nothing."""
    joined = functions.join(lambda_totals(metrics, as_of, days), ["region", "function_name"], "left")
    count = F.coalesce("invocation_count", F.lit(0.0))
    average = F.when(
        count > 0, invocation_cost(F.col("total_duration_ms") / count, F.col("memory_size"))
    ).otherwise(F.lit(0.0))
    return joined.select(
        "region",
        "function_name",
        "runtime",
        "memory_size",
        (average * count).alias("total_cost"),
        count.alias("invocation_count"),
        average.alias("average_cost"),
    )


def order_cost(report: DataFrame) -> DataFrame:
    return report.orderBy(F.desc("total_cost"), "region", "function_name")


def last_invocation(metrics: DataFrame, as_of: Moment, days: int = 30) -> DataFrame:
    """Start of the newest hour with invocations, per function.

    The newest datapoint falls in the newest hour, so the hour is cut off its time.
    """
    end = moment(as_of)
    points = scan_metrics(metrics, "AWS/Lambda", ["Invocations"], end - timedelta(days=days), end)
    return points.groupBy("region", dim("FunctionName").alias("function_name")).agg(
        F.date_trunc("hour", F.max("ts")).alias("last_used")
    )


def lambda_activity(
    functions: DataFrame, metrics: DataFrame, as_of: Moment, inactive_only: bool = False
) -> DataFrame:
    joined = functions.join(last_invocation(metrics, as_of), ["region", "function_name"], "left")
    if inactive_only:
        joined = joined.where(F.col("last_used").isNull())
    return joined.select(
        "region",
        "function_name",
        "runtime",
        "memory_size",
        "code_size",
        "last_modified",
        "last_used",
        F.col("last_used").isNull().alias("is_inactive"),
    )


def flag_runtimes(functions: DataFrame, end_of_life: DataFrame) -> DataFrame:
    """Adds ``is_deprecated`` and the notice of the runtime table ``(runtime, notice)``."""
    flagged = functions.join(end_of_life.select("runtime", "notice"), "runtime", "left")
    return flagged.withColumn("is_deprecated", F.col("notice").isNotNull())


def stream_usage(metrics: DataFrame, as_of: Moment, minutes: int = 5) -> DataFrame:
    """Newest 5-minute sums per stream, one column per metric."""
    end = moment(as_of)
    points = scan_metrics(metrics, "AWS/Kinesis", STREAM_METRICS, end - timedelta(minutes=minutes), end)
    sums = metric_stat(points, "5 minutes", "Sum", {"stream_name": "StreamName"})
    newest = latest_value(sums, ["region", "stream_name", "metric"])
    return pivot_metrics(newest, ["region", "stream_name"], {m: f"{m}Sum" for m in STREAM_METRICS})


def stream_utilisation(
    streams: DataFrame,
    usage: DataFrame,
    write_records: int = SHARD_WRITE_RECORDS,
    write_bytes: int = SHARD_WRITE_BYTES,
    read_records: int = SHARD_READ_RECORDS,
    read_bytes: int = SHARD_READ_BYTES,
) -> DataFrame:
    """Share of the shards' 5-minute capacity in use, in percent with two decimals."""
    joined = streams.join(usage, ["region", "stream_name"], "left")
    shares = utilisation_columns(write_records, write_bytes, read_records, read_bytes)
    return joined.select("region", "stream_name", "shards", "status", *shares)


def utilisation_columns(
    write_records: int = SHARD_WRITE_RECORDS,
    write_bytes: int = SHARD_WRITE_BYTES,
    read_records: int = SHARD_READ_RECORDS,
    read_bytes: int = SHARD_READ_BYTES,
    digits: int = 2,
) -> list[Column]:
    """Shares of the capacity of ``shards`` that 5-minute sums per metric (``<metric>Sum``) use."""

    def percent(metric: str, per_second: int) -> Column:
        used = F.coalesce(F.col(f"`{metric}Sum`"), F.lit(0.0))
        return F.round(used / (F.col("shards") * float(per_second * 300)) * 100, digits)

    return [
        percent("GetRecords.Bytes", read_bytes).alias("read_mb_pct"),
        percent("GetRecords.Records", read_records).alias("read_records_pct"),
        percent("IncomingBytes", write_bytes).alias("write_mb_pct"),
        percent("IncomingRecords", write_records).alias("write_records_pct"),
    ]


def valid_at(versions: DataFrame, keys: list[str]) -> DataFrame:
    """Versions of an inventory (``valid_from``) with ``valid_to``, where the next one of the same keys begins."""
    following = Window.partitionBy(*keys).orderBy("valid_from")
    return versions.withColumn("valid_to", F.lead("valid_from").over(following))


def utilisation_by_period(usage: DataFrame, versions: DataFrame, digits: int = 2) -> DataFrame:
    """Utilisation of every 5-minute period by the shards that a stream had then.

    ``usage`` has a row per period (``bucket_start``) with ``<metric>Sum`` columns; ``versions`` of the streams have
    ``valid_from`` and do not overlap. A period before the first version of its stream has no shards and is left out.
    """
    keys = ["region", "stream_name"]
    at = valid_at(versions.select(*keys, "shards", "valid_from"), keys)
    then = (F.col("bucket_start") >= F.col("valid_from")) & (
        F.col("valid_to").isNull() | (F.col("bucket_start") < F.col("valid_to"))
    )
    joined = usage.join(at, keys).where(then)
    return joined.select(*keys, "bucket_start", "shards", *utilisation_columns(digits=digits))


def shard_usage(metrics: DataFrame, as_of: Moment, minutes: int = 60) -> DataFrame:
    """Newest hourly values per shard: sums as counts, averages as rates per second.

    Sums and averages come from one aggregation over all seven metrics.
    """
    end = moment(as_of)
    names = [m for m, _ in SHARD_METRICS]
    points = scan_metrics(metrics, "AWS/Kinesis", names, end - timedelta(minutes=minutes), end)
    keys = ["region", "stream_name", "shard_id", "metric"]
    hourly = (
        points.where(dim("ShardId").isNotNull())
        .groupBy(
            "region",
            dim("StreamName").alias("stream_name"),
            dim("ShardId").alias("shard_id"),
            "metric",
            F.window("ts", "1 hour")["start"].alias("bucket_start"),
        )
        .agg(F.sum("value").alias("total"), F.avg("value").alias("average"))
    )
    summed = F.col("metric").isin([m for m, s in SHARD_METRICS if s == "Sum"])
    per_second = F.col("average") / F.when(F.col("metric") == "IteratorAgeMilliseconds", 1.0).otherwise(60.0)
    values = hourly.select(
        *keys, "bucket_start", F.when(summed, F.col("total")).otherwise(per_second).alias("value")
    )
    newest = latest_value(values, keys)
    columns = {m: f"{m}Count" if s == "Sum" else f"{m}PerSecond" for m, s in SHARD_METRICS}
    columns["IteratorAgeMilliseconds"] = "iterator_age_ms"
    return pivot_metrics(newest, ["region", "stream_name", "shard_id"], columns)


def shard_report(shards: DataFrame, usage: DataFrame) -> DataFrame:
    """One row per shard; metrics only where monitoring is on, zero where nothing was measured."""
    joined = shards.join(usage, ["region", "stream_name", "shard_id"], "left")
    measured = [c for c in usage.columns if c not in ("region", "stream_name", "shard_id")]
    return joined.select(
        "region",
        "stream_name",
        "shard_id",
        "status",
        *[F.when(F.col("monitored"), F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in measured],
    )


def renamed_shard_values(labelled: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Series values labelled ``shard:metric:stat`` under their output names and units."""
    rows = labelled.withColumn("_label", split_label(F.col("label")))
    metric, stat = F.col("_label.metric"), F.col("_label.stat")
    value = F.coalesce("value", F.lit(0.0))
    return rows.select(
        *keep,
        F.col("_label.id").alias("shard_id"),
        metric_name(metric, stat).alias("metric"),
        F.when(stat == "Sum", value).otherwise(value / 60.0).alias("value"),
    )


def table_capacity(metrics: DataFrame, as_of: Moment, days: int = 30) -> DataFrame:
    """Daily capacity per table: consumed units summed, provisioned units averaged."""
    end = moment(as_of)
    names = [m for m, _ in TABLE_METRICS]
    points = scan_metrics(metrics, "AWS/DynamoDB", names, end - timedelta(days=days), end)
    # Output column of each capacity metric.
    columns = {
        "ConsumedReadCapacityUnits": "consumed_read",
        "ConsumedWriteCapacityUnits": "consumed_write",
        "ProvisionedReadCapacityUnits": "provisioned_read",
        "ProvisionedWriteCapacityUnits": "provisioned_write",
    }
    return points.groupBy(
        "region",
        dim("TableName").alias("table_name"),
        F.window("ts", "1 day")["start"].alias("day"),
    ).agg(
        *[STATS[s](F.when(F.col("metric") == m, F.col("value"))).alias(columns[m]) for m, s in TABLE_METRICS]
    )
