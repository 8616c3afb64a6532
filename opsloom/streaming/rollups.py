"""Rollups of a stream that take points of any age: no watermark, nothing dropped.

A micro-batch is reduced to mergeable partial states per period (count, sum, least, greatest and a quantile sketch), which
land in a folder of the batch; a retry overwrites it. The value of a period is the merge of its partial states, so a
point that comes days late changes its period and no other. From time to time the states of the days that were touched are
compacted into one row per period; days that nothing came for are not read or written again.

Layout below ``path``: ``parts/batch=<n>/day=<d>`` and ``base/upto=<n>/day=<d>``. Of a day the base with the greatest
``upto`` counts, and the parts of later batches. What a compaction replaces goes with the next one, so a batch that
runs again after a crash finds all it needs, and so does a reader that began before.
"""

from __future__ import annotations

import re

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DateType, LongType, StructField, StructType

from opsloom.operators.metrics import dim
from opsloom.sources.remote import entries, opened

COMPACT_EVERY = 20
STATE = ["n", "total", "least", "greatest", "sketch"]


def partial_states(points: DataFrame, period: str, dims: dict[str, str]) -> DataFrame:
    """Mergeable states per dimension values and period of some datapoints."""
    start = F.window("ts", period)["start"]
    return (
        points.where(F.col("ts").isNotNull() & F.col("value").isNotNull())
        .groupBy("region", "metric", *[dim(d).alias(c) for c, d in dims.items()], start.alias("bucket_start"))
        .agg(
            F.count("*").alias("n"),
            F.sum("value").alias("total"),
            F.min("value").alias("least"),
            F.max("value").alias("greatest"),
            F.kll_sketch_agg_double("value").alias("sketch"),
        )
        .withColumn("day", F.to_date("bucket_start"))
    )


def _merged(states: DataFrame, keys: list[str]) -> DataFrame:
    return states.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum("total").alias("total"),
        F.min("least").alias("least"),
        F.max("greatest").alias("greatest"),
        F.kll_merge_agg_double("sketch").alias("sketch"),
    )


def _bases(path: str) -> dict[str, list[int]]:
    """Days with the batches up to which they have been compacted, ascending."""
    found: dict[str, list[int]] = {}
    for folder in entries(f"{path}/base"):
        upto = re.fullmatch(r"upto=(\d+)", folder.path.rstrip("/").rsplit("/", 1)[-1])
        if folder.type != fs.FileType.Directory or not upto:
            continue
        inside = [e.path.rstrip("/").rsplit("/", 1)[-1] for e in entries(f"{path}/base/{upto.group()}")]
        if "_SUCCESS" not in inside:  # a compaction that has not ended
            continue
        for name in inside:
            if name.startswith("day="):
                found.setdefault(name.removeprefix("day="), []).append(int(upto.group(1)))
    return {day: sorted(batches) for day, batches in found.items()}


def _schema(dims: list[str]) -> StructType:
    keys = ", ".join(f"{c} STRING" for c in ("region", "metric", *dims))
    state = "n BIGINT, total DOUBLE, least DOUBLE, greatest DOUBLE, sketch BINARY"
    return StructType.fromDDL(f"{keys}, bucket_start TIMESTAMP, {state}")


def _states(spark: SparkSession, path: str, dims: list[str], upto: int | None = None) -> DataFrame:
    """All current states with their day; with ``upto`` those that a compaction up to that batch starts from."""
    schema = _schema(dims)
    bases = {d: [b for b in found if upto is None or b < upto] for d, found in _bases(path).items()}
    current = {d: found[-1] for d, found in bases.items() if found}
    full = StructType([*schema.fields, StructField("batch", LongType()), StructField("day", DateType())])
    system, inside = opened(f"{path}/parts")
    if system.get_file_info(inside).type == fs.FileType.Directory:
        parts = spark.read.schema(full).parquet(f"{path}/parts")
    else:
        parts = spark.createDataFrame([], full)
    # One row per day.
    days = spark.createDataFrame([(d, b) for d, b in current.items()], "day STRING, upto BIGINT")
    days = days.select(F.col("day").cast("date").alias("day"), "upto")
    parts = parts.join(F.broadcast(days), "day", "left").where(F.col("batch") > F.coalesce("upto", F.lit(-1)))
    if upto is not None:
        parts = parts.where(F.col("batch") <= upto)
    parts = parts.select(*schema.fieldNames(), "day")
    if not current:
        return parts
    dated = StructType([*schema.fields, StructField("day", DateType())])
    folders = [f"{path}/base/upto={b}/day={d}" for d, b in current.items()]
    base = spark.read.schema(dated).option("basePath", f"{path}/base").parquet(*folders)
    return base.select(*parts.columns).unionByName(parts)


def compact(spark: SparkSession, path: str, dims: list[str], upto: int) -> None:
    """Merges the parts of all batches up to ``upto`` into the base of the days they touch."""
    path = path.rstrip("/")
    keys = ["region", "metric", *dims, "bucket_start"]
    last = max((b for found in _bases(path).values() for b in found if b < upto), default=-1)
    full = StructType([StructField("batch", LongType()), StructField("day", DateType())])
    touched = spark.read.schema(full).parquet(f"{path}/parts").where(F.col("batch").between(last + 1, upto)).select("day").distinct()
    states = _states(spark, path, dims, upto).join(F.broadcast(touched), "day", "left_semi")
    merged = _merged(states, [*keys, "day"])
    merged.write.mode("overwrite").partitionBy("day").parquet(f"{path}/base/upto={upto}")
    _drop_replaced(path, last)


def _drop_replaced(path: str, last: int) -> None:
    """Parts that the compaction before has merged, and bases that it had replaced."""
    system, _ = opened(path)
    for folder in entries(f"{path}/parts"):
        batch = re.fullmatch(r"batch=(\d+)", folder.path.rstrip("/").rsplit("/", 1)[-1])
        if batch and int(batch.group(1)) <= last:
            system.delete_dir(folder.path)
    _, base = opened(f"{path}/base")
    for day, batches in _bases(path).items():
        for replaced in [b for b in batches if b <= last][:-1]:
            system.delete_dir(f"{base}/upto={replaced}/day={day}")


def rollup_stream(
    points: DataFrame,
    path: str,
    checkpoint: str,
    period: str,
    dims: dict[str, str],
    compact_every: int = COMPACT_EVERY,
) -> StreamingQuery:
    """Rolls up all that a stream of datapoints has now, and returns the ended query. One path is for one checkpoint."""
    path = path.rstrip("/")

    def store(batch: DataFrame, batch_id: int) -> None:
        folder = f"{path}/parts/batch={batch_id}"
        partial_states(batch, period, dims).write.mode("overwrite").partitionBy("day").parquet(folder)
        if (batch_id + 1) % compact_every == 0:
            compact(batch.sparkSession, path, list(dims), batch_id)

    query = (
        points.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def rollup(spark: SparkSession, path: str, dims: list[str]) -> DataFrame:
    """``region, metric``, dimensions, ``bucket_start`` with the states of every period as they are now."""
    return _merged(_states(spark, path.rstrip("/"), dims), ["region", "metric", *dims, "bucket_start"])


def stat(states: DataFrame, name: str) -> DataFrame:
    """States with ``value``: Sum, Average, Minimum, Maximum, SampleCount, or a percentile such as p95 (a sketch's)."""
    values = {
        "Sum": F.col("total"),
        "Average": F.col("total") / F.col("n"),
        "Minimum": F.col("least"),
        "Maximum": F.col("greatest"),
        "SampleCount": F.col("n").cast("double"),
    }
    if re.fullmatch(r"p\d+(\.\d+)?", name):
        value = F.kll_sketch_get_quantile_double("sketch", F.lit(float(name[1:]) / 100))
    elif name in values:
        value = values[name]
    else:
        raise ValueError(f"unknown statistic {name}")
    return states.withColumn("value", value).drop(*STATE)
