"""Scope and look-back filters shared by all scans.

Bounds are literals of the column's own type, so that they reach the file scan.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Moment = datetime | str


def moment(value: Moment) -> datetime:
    """A moment in UTC without an offset; one with an offset is converted."""
    value = value if isinstance(value, datetime) else datetime.fromisoformat(value)
    return value.astimezone(timezone.utc).replace(tzinfo=None) if value.tzinfo else value


def time_literal(df: DataFrame, column: str, value: Moment) -> Column:
    text = moment(value).strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(text).cast(df.schema[column].dataType)


def between(df: DataFrame, start: Moment, end: Moment, column: str = "ts") -> DataFrame:
    """Rows of a time range, both ends included.

    A table partitioned by ``date`` (the UTC day of ``ts``) only reads the days of the range.
    """
    if column == "ts" and "date" in df.columns:
        days = [F.lit(str(moment(m).date())).cast("date") for m in (start, end)]
        df = df.where(F.col("date").cast("date").between(*days))
    return df.where(
        (F.col(column) >= time_literal(df, column, start)) & (F.col(column) <= time_literal(df, column, end))
    )


def window_minutes(minutes: int = 60, hours: int | None = None, days: int | None = None) -> int:
    """Length of a look-back window; hours and days exclude each other and override minutes."""
    if hours is not None and days is not None:
        raise ValueError("give hours or days, not both")
    if days is not None:
        return days * 24 * 60
    return hours * 60 if hours is not None else minutes


def lookback(
    df: DataFrame,
    as_of: Moment,
    minutes: int = 60,
    hours: int | None = None,
    days: int | None = None,
    column: str = "ts",
) -> DataFrame:
    end = moment(as_of)
    return between(df, end - timedelta(minutes=window_minutes(minutes, hours, days)), end, column)


def scope(
    df: DataFrame,
    region: str | None = None,
    name: str | None = None,
    name_column: str = "function_name",
) -> DataFrame:
    """One resource, one region, or everything. A name is only unique inside a region."""
    if name is not None and region is None:
        raise ValueError("a name needs a region")
    if region is not None:
        df = df.where(F.col("region") == region)
    if name is not None:
        df = df.where(F.col(name_column) == name)
    return df


def in_regions(df: DataFrame, regions: list[str] | None) -> DataFrame:
    return df if regions is None else df.where(F.col("region").isin(regions))
