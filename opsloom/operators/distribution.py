"""Count, percentiles, maximum and deviation of a value per group, safe for hot groups and for any distribution.

A group may hold a large share of all rows, and its values may all lie close together, so no task ever sees a
whole group or a whole range of values. Percentiles are selected by refining ranges, for all groups at once:

1. rows are counted per group and range with map-side combination; the first ranges grow with the value (a
   logarithm, so there are at most ``FIRST_RANGES`` of them whatever the values);
2. running counts tell which few ranges hold a wanted rank;
3. a range that holds more than ``most_rows`` rows of more than one value is cut into ``CUTS`` equal parts between its
   least and greatest value, and only the rows inside are counted again, until none is left;
4. the values of the remaining ranges are ranked.

So no window has more than ``max(FIRST_RANGES, CUTS, most_rows)`` rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.session import shared_dir

#: Ranges per factor e of the value; values of all sizes and both signs, infinite and undefined ones have so many.
PER_E = 64
FIRST_RANGES = 2 * 711 * PER_E + 6
CUTS = 4096
MOST_ROWS = 1_000_000
_FAR = 711 * PER_E + 1


def _first_range(value: str) -> Column:
    """A number that grows with the value, null for null. The logarithm never falls where the value rises."""
    v = F.col(value)
    size = F.floor(F.log1p(F.abs(v)) * PER_E)
    code = F.when(v < 0, -1 - size).otherwise(size)
    return (
        F.when(F.isnan(v), F.lit(_FAR + 1))
        .when(v == float("inf"), F.lit(_FAR))
        .when(v == float("-inf"), F.lit(-_FAR - 1))
        .otherwise(code)
        .cast("int")
    )


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _same(keys: list[str], left: str, right: str) -> Column:
    return reduce(Column.__and__, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def distribution_stats(
    df: DataFrame,
    keys: list[str],
    value: str,
    suffix: str,
    exact: bool = True,
    most_rows: int = MOST_ROWS,
) -> DataFrame:
    """Per group: row count, median, p75, p95, maximum and sample deviation of ``value``.

    Rows without a value are counted but leave the statistics alone; NaN counts as the greatest value. Percentiles
    interpolate linearly between neighbours; with ``exact=False`` they are sketches
    computed in one shuffle. The first counts are taken when the plan is built.
    """
    names = {f"median_{suffix}": 0.5, f"p75_{suffix}": 0.75, f"p95_{suffix}": 0.95}
    if not exact:
        sketch = [F.percentile_approx(value, p, 10000).alias(n) for n, p in names.items()]
        return df.groupBy(*keys).agg(
            F.count("*").alias("n"),
            *sketch,
            F.max(value).alias(f"max_{suffix}"),
            F.stddev_samp(value).alias(f"stddev_{suffix}"),
        )

    # Stored, so that what the values are parsed from is read once; they are read again for each round.
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).withColumn("_range", _first_range("_v"))
    rows = _stored(rows, "values")
    counts = rows.groupBy(*keys, "_range").agg(
        F.count("*").alias("_rows"),
        F.count("_v").alias("_n"),
        F.min("_v").alias("_lo"),
        F.max("_v").alias("_hi"),
        F.avg("_v").alias("_mean"),
        F.var_pop("_v").alias("_var"),
    )
    whole = Window.partitionBy(*keys)
    total = F.sum("_n").over(whole)
    counts = counts.select(
        *keys,
        "_range",
        "_n",
        "_lo",
        "_hi",
        total.alias("_total"),
        F.sum("_rows").over(whole).alias("n"),
        F.max("_hi").over(whole).alias("_max"),
        "_mean",
        "_var",
        (F.sum(F.col("_n") * F.col("_mean")).over(whole) / F.nullif(total, F.lit(0))).alias("_centre"),
        _before(keys, "_range").alias("_start"),
    )
    off = F.col("_mean") - F.col("_centre")
    squares = F.sum(F.col("_n") * (F.col("_var") + off * off)).over(whole)
    counts = counts.withColumn("_m2", squares).drop("_mean", "_var", "_centre")

    def rank(p: float, side) -> Column:
        return side(F.lit(p) * (F.col("_total") - 1)).cast("bigint")

    ranks = [rank(p, side) for p in names.values() for side in (F.floor, F.ceil)]

    # Every group has one row of totals: the first of its ranges.
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_range").asc_nulls_last()))
    group = [*keys, "n", "_total", "_max", "_m2"]
    counts = _stored(counts.withColumn("_row", first).where((F.col("_row") == 1) | _any_rank(ranks)), "ranges")
    groups = counts.where("_row = 1").select(*group)
    ranges = counts.where(_any_rank(ranks)).select(*keys, F.array("_range").alias("_path"), "_total", "_start", "_n", "_lo", "_hi")
    rows = rows.select(*keys, F.array("_range").alias("_path"), "_v", F.lit(1).cast("bigint").alias("_w"))

    single = F.col("_lo").eqNullSafe(F.col("_hi"))
    decided = []  # ranges of one value: the value is known
    while True:
        decided.append(ranges.where(single).select(*keys, "_start", "_n", F.col("_lo").alias("_v")))
        ranges = ranges.where(~single)
        # Only rows inside the ranges go on, equal values as one row.
        inside = rows.alias("l").join(ranges.alias("r"), _same([*keys, "_path"], "l", "r"))
        inside = inside.groupBy(*[F.col(f"r.{c}").alias(c) for c in ranges.columns], F.col("l._v").alias("_v"))
        inside = inside.agg(F.sum("l._w").alias("_w"))
        if ranges.where(F.col("_n") > most_rows).isEmpty():
            break
        # A value's share of the range; halves keep the difference of far ends finite.
        v, lo, hi = F.col("_v"), F.col("_lo"), F.col("_hi")
        half = (v / 2 - lo / 2) / (hi / 2 - lo / 2)
        share = F.when(hi - lo == float("inf"), half).otherwise((v - lo) / (hi - lo))
        cut = F.least(F.floor(share * CUTS), F.lit(CUTS - 1)).cast("int")
        inside = _stored(inside.withColumn("_cut", cut), "inside")
        parts = inside.groupBy(*keys, "_path", "_total", "_start", "_cut").agg(
            F.sum("_w").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
        )
        parts = parts.withColumn("_start", F.col("_start") + _before([*keys, "_path"], "_cut"))
        longer = F.concat("_path", F.array("_cut")).alias("_path")
        ranges = _stored(parts.where(_any_rank(ranks)).select(*keys, longer, "_total", "_start", "_n", "_lo", "_hi"), "ranges")
        rows = inside.select(*keys, longer, "_v", "_w")

    running = Window.partitionBy(*keys, "_path").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = inside.withColumn("_last", F.sum("_w").over(running))
    ranked = ranked.select(*keys, (F.col("_start") + F.col("_last") - F.col("_w")).alias("_start"), F.col("_w").alias("_n"), "_v")
    found = reduce(DataFrame.unionByName, [ranked, *decided])
    holds = lambda r: F.max(F.when((r >= F.col("_start")) & (r < F.col("_start") + F.col("_n")), F.col("_v")))
    located = groups.alias("g").join(found.alias("f"), _same(keys, "g", "f"), "left")
    gathered = located.groupBy(*[F.col(f"g.{c}").alias(c) for c in group]).agg(
        *[holds(rank(p, F.floor)).alias(f"_lo_{n}") for n, p in names.items()],
        *[holds(rank(p, F.ceil)).alias(f"_hi_{n}") for n, p in names.items()],
    )
    total = F.col("_total")

    def interpolate(name: str, p: float) -> Column:
        share = F.lit(p) * (total - 1) - rank(p, F.floor)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        return F.when(lo == hi, lo).otherwise(lo + (hi - lo) * share).alias(name)

    return gathered.select(
        *keys,
        "n",
        *[interpolate(name, p) for name, p in names.items()],
        F.col("_max").alias(f"max_{suffix}"),
        F.when(total > 1, F.sqrt(F.greatest(F.col("_m2"), F.lit(0.0)) / (total - 1))).alias(f"stddev_{suffix}"),
    )


def _any_rank(ranks: list[Column]) -> Column:
    """Whether a range holds a wanted rank."""
    last = F.col("_start") + F.col("_n")
    return reduce(Column.__or__, [F.coalesce((r >= F.col("_start")) & (r < last), F.lit(False)) for r in ranks])


def _before(by: list[str], order: str) -> Column:
    """Rows in the ranges before this one. A range of nulls is the last and has no rank."""
    ahead = Window.partitionBy(*by).orderBy(F.col(order).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("_n").over(ahead), F.lit(0))
