"""Choice of a memory size from measured durations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsloom.operators.metrics import invocation_cost

# Weight of cost against speed for each strategy.
STRATEGY_WEIGHT = {"speed": 0.0, "cost": 1.0}


def power_select(
    measurements: DataFrame,
    strategy: str,
    weight: float = 0.5,
    power_values: Sequence[int] | None = None,
) -> DataFrame:
    """Best memory size per function from ``(region, function_name, memory_mb, duration_ms)``.

    Mean duration and the price of it are scaled to 0..1 within the function; the score
    is their mean weighted by ``weight`` (0 is speed only, 1 is cost only). Ties go to
    the smaller size. The windows run over one row per function and memory size.
    """
    if strategy not in ("cost", "speed", "balanced"):
        raise ValueError(f"unknown strategy {strategy}")
    share = STRATEGY_WEIGHT.get(strategy, weight)
    if not 0.0 <= share <= 1.0:
        raise ValueError("weight must be between 0 and 1")
    if power_values is not None:
        measurements = measurements.where(F.col("memory_mb").isin(list(power_values)))

    means = measurements.groupBy("region", "function_name", "memory_mb").agg(
        F.avg("duration_ms").alias("average_ms"), F.count("*").alias("invocations")
    )
    priced = means.withColumn("average_cost", invocation_cost(F.col("average_ms"), F.col("memory_mb")))

    function = Window.partitionBy("region", "function_name")

    def scaled(column: str):
        low, high = F.min(column).over(function), F.max(column).over(function)
        return F.when(high > low, (F.col(column) - low) / (high - low)).otherwise(F.lit(0.0))

    score = share * scaled("average_cost") + (1 - share) * scaled("average_ms")
    best = Window.partitionBy("region", "function_name").orderBy(F.round("score", 9), "memory_mb")
    return (
        priced.withColumn("score", score)
        .withColumn("_rank", F.row_number().over(best))
        .where(F.col("_rank") == 1)
        .select(
            "region",
            "function_name",
            F.lit(strategy).alias("strategy"),
            F.col("memory_mb").alias("power"),
            "average_ms",
            "average_cost",
            "invocations",
        )
    )
