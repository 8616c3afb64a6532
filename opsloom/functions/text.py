"""Column expressions for names, ARNs and report text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trunc_name(name: Column, length: int) -> Column:
    """Names longer than ``length`` are cut there and marked with an ellipsis."""
    return F.when(F.length(name) > length, F.concat(F.substring(name, 1, length), F.lit("…"))).otherwise(name)


def human_size(size: Column) -> Column:
    """File size in powers of 1024; bytes without decimals, larger units with two."""
    text = F.concat(F.format_number(size.cast("double"), 0), F.lit(" bytes"))
    for power, unit in enumerate(["KB", "MB", "GB", "TB", "PB"], start=1):
        scaled = size.cast("double") / float(1024**power)
        text = F.when(scaled >= 1, F.concat(F.format_number(scaled, 2), F.lit(f" {unit}"))).otherwise(text)
    return F.when(size <= 0, F.lit("0 bytes")).otherwise(text)


def age_text(ts: Column, as_of: Column) -> Column:
    """Relative age such as "3 hours ago"; future times read "in 3 hours"."""
    micros = F.timestamp_diff("MICROSECOND", ts, as_of).cast("double")
    seconds = F.abs(micros) / 1e6
    whole_seconds = F.round(seconds)
    minutes = F.round(seconds / 60)
    hours = F.round(seconds / 3600)
    days = F.round(seconds / 86400)
    months = F.round(seconds / 86400 * 4800 / 146097)
    years = F.round(seconds / 86400 * 400 / 146097)

    def plural(count: Column, unit: str) -> Column:
        return F.concat(count.cast("bigint").cast("string"), F.lit(f" {unit}"))

    span = (
        F.when(whole_seconds <= 44, F.lit("a few seconds"))
        .when(minutes <= 1, F.lit("a minute"))
        .when(minutes < 45, plural(minutes, "minutes"))
        .when(hours <= 1, F.lit("an hour"))
        .when(hours < 22, plural(hours, "hours"))
        .when(days <= 1, F.lit("a day"))
        .when(days < 26, plural(days, "days"))
        .when(months <= 1, F.lit("a month"))
        .when(months < 11, plural(months, "months"))
        .when(years <= 1, F.lit("a year"))
        .otherwise(plural(years, "years"))
    )
    return F.when(micros >= 0, F.concat(span, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), span))


def cost_text(cost: Column) -> Column:
    """Ten decimals, or a dash for no cost."""
    return F.when(F.coalesce(cost, F.lit(0.0)) == 0, F.lit("-")).otherwise(F.format_string("%.10f", cost))


def init_band(ms: Column) -> Column:
    """Rating of an init duration in ms."""
    return (
        F.when(ms.isNull(), F.lit("none"))
        .when(ms < 100, F.lit("good"))
        .when(ms < 500, F.lit("plain"))
        .when(ms < 1000, F.lit("warn"))
        .otherwise(F.lit("bad"))
    )


def util_band(utilisation: Column) -> Column:
    """Rating of a utilisation ratio; unused capacity has no rating."""
    return (
        F.when(F.coalesce(utilisation, F.lit(0.0)) == 0, F.lit("-"))
        .when((utilisation > 0.3) & (utilisation < 0.8), F.lit("good"))
        .otherwise(F.lit("warn"))
    )


def util_text(utilisation: Column) -> Column:
    """Utilisation as a percentage, a dash when there is none."""
    percent = F.regexp_replace(F.format_string("%.6f", utilisation * 100), r"\.?0+$", "")
    return F.when(F.coalesce(utilisation, F.lit(0.0)) == 0, F.lit("-")).otherwise(F.concat(percent, F.lit("%")))


def percent_text(value: Column) -> Column:
    return F.format_string("%.2f", value)


def or_dash(column: Column) -> Column:
    """Missing or zero values are printed as a dash."""
    text = column.cast("string")
    return F.when(column.isNull() | (column.cast("double") == 0), F.lit("-")).otherwise(text)


def metric_name(metric: Column, stat: Column) -> Column:
    """Output name of a shard metric by its statistic."""
    return F.concat(metric, F.when(stat == "Sum", F.lit("Count")).otherwise(F.lit("PerSecond")))


def metric_id(name: Column) -> Column:
    """Lower case with all non-word characters removed."""
    return F.regexp_replace(F.lower(name), r"\W", "")


def log_group(function_name: Column) -> Column:
    return F.concat(F.lit("/aws/lambda/"), function_name)


def split_label(label: Column) -> Column:
    """``id:metric:stat`` as a struct."""
    parts = F.split(label, ":")
    return F.struct(
        F.get(parts, F.lit(0)).alias("id"),
        F.get(parts, F.lit(1)).alias("metric"),
        F.get(parts, F.lit(2)).alias("stat"),
    )


def arn_parts(arn: Column) -> Column:
    """Fields of an ARN; ``qualifier`` is its last segment."""
    parts = F.split(arn, ":")
    return F.struct(
        F.get(parts, F.lit(1)).alias("partition"),
        F.get(parts, F.lit(2)).alias("service"),
        F.get(parts, F.lit(3)).alias("region"),
        F.get(parts, F.lit(4)).alias("account"),
        F.get(parts, F.lit(5)).alias("resource"),
        F.element_at(parts, -1).alias("qualifier"),
    )


def strip_shard_prefix(shard_id: Column) -> Column:
    return F.regexp_replace(shard_id, "shardId-", "")


def number_or_null(text: Column) -> Column:
    """Number of a text, null where it is none or not finite."""
    number = text.try_cast("double")
    return F.when(F.abs(number) < float("inf"), number)


def time_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def details_json(*columns: str) -> Column:
    """The named columns as one JSON text; missing values are left out."""
    return F.to_json(F.struct(*columns))


def tags_map(tags: Column) -> Column:
    """``[{key, value}]`` as a map; the last of equal keys wins."""
    last_first = F.reverse(tags)
    keys = F.array_distinct(F.transform(last_first, lambda t: t["key"]))
    return F.map_from_arrays(
        keys,
        F.transform(keys, lambda k: F.get(F.filter(last_first, lambda t: t["key"] == k), F.lit(0))["value"]),
    )


def string_attributes(attributes: Column) -> Column:
    """Only attributes of type String, each reduced to its type and text value."""
    kept = F.map_filter(attributes, lambda _, v: v["data_type"] == "String")
    return F.transform_values(
        kept,
        lambda _, v: F.struct(v["data_type"].alias("data_type"), v["string_value"].alias("string_value")),
    )
