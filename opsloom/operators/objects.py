"""SQL over a set of files, per file or over all of them."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def query_objects(
    spark: SparkSession,
    records: DataFrame,
    expression: str,
    scope: str = "object",
    objects: DataFrame | None = None,
    object_column: str = "object",
) -> DataFrame:
    """A Spark SQL query over records, which it sees as the table ``s3object``.

    The query is answered for each object on its own, so that limits and aggregates count
    per object; ``object_column`` names the object of a row. ``objects`` lists the objects that answer, those
    without records too; without it, those that have records do. Spark turns the lateral join into
    grouping and ranking by object. A limit is best given with an order: without one,
    all matching rows of an object meet in one task (``select_objects`` avoids that).
    With ``scope="dataset"`` all records are one table.
    """
    columns = [f"`{c}`" for c in records.columns if c != object_column]
    if scope == "dataset":
        records.select(*columns).createOrReplaceTempView("s3object")
        return spark.sql(expression)
    records.createOrReplaceTempView("s3object_records")
    each = "SELECT DISTINCT `{0}` AS object_name FROM s3object_records"
    if objects is not None:
        objects.select(F.col(object_column).alias("object_name")).createOrReplaceTempView("s3object_names")
        each = "SELECT object_name FROM s3object_names"
    # A text with tables of its own is a query within the one that defines s3object.
    if re.match(r"(\s|--[^\n]*\n|/\*.*?\*/)*WITH\b", expression, re.IGNORECASE | re.DOTALL):
        expression = f"SELECT * FROM ({expression})"
    return spark.sql(
        f"""SELECT each.object_name AS `{object_column}`, answer.*
        FROM ({each.format(object_column)}) each, LATERAL (
            WITH s3object AS (
                SELECT {", ".join(columns)} FROM s3object_records all WHERE all.`{object_column}` = each.object_name
            ) {expression}
        ) answer"""
    )


def select_objects(
    records: DataFrame,
    columns: Sequence[str] = ("*",),
    where: str | None = None,
    aggs: Sequence[str] | None = None,
    limit: int | None = None,
    order: Sequence[str] = (),
    scope: str = "object",
    object_column: str = "object",
    objects: DataFrame | None = None,
) -> DataFrame:
    """One selection evaluated against each object: a limit or an aggregate counts per object.

    ``columns``, ``where`` and ``aggs`` are SQL texts. ``order`` names the columns that
    order the rows of an object; a limit needs them to be repeatable. With
    ``scope="dataset"`` all objects count as one. With ``aggs``, ``objects`` lists the objects
    that answer, those without records too.
    """
    picked = records if where is None else records.where(where)
    per_object = scope == "object"
    if aggs:
        expressions = [F.expr(a) for a in aggs]
        if not per_object:
            return picked.agg(*expressions)
        # An object whose rows are all filtered away still answers with one row.
        answered = picked.groupBy(object_column).agg(*expressions)
        if where is None and objects is None:
            return answered
        empty = picked.where("false").agg(*expressions)
        hit = records.select(object_column, F.coalesce(F.expr(where or "true"), F.lit(False)).alias("_hit"))
        if objects is not None:
            hit = hit.unionByName(objects.select(object_column, F.lit(False).alias("_hit")))
        silent = hit.groupBy(object_column).agg(F.max("_hit").alias("_any")).where(~F.col("_any"))
        defaults = [empty.select(name).scalar().alias(name) for name in empty.columns]
        return answered.unionByName(silent.select(object_column, *defaults))
    if limit is not None and per_object:
        rank = Window.partitionBy(object_column).orderBy(*(order or [F.monotonically_increasing_id()]))
        picked = picked.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= limit).drop("_rank")
    selected = picked.selectExpr(*columns)
    if limit is not None and not per_object:
        selected = picked.orderBy(*order).selectExpr(*columns).limit(limit) if order else selected.limit(limit)
    return selected
