"""Region fan-out: read one path per region, skipping regions that cannot be read."""

from __future__ import annotations

from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.constants import REGIONS


def region_paths(root: str, regions: list[str] = REGIONS) -> dict[str, str]:
    """Folder of every region below a table that is laid out by region."""
    return {region: f"{root}/region={region}" for region in regions}


def read_regions(
    spark: SparkSession, paths: dict[str, str], schema: str, on_error: str = "skip"
) -> tuple[DataFrame, DataFrame]:
    """Rows of every readable region and a table ``(region, error)`` of the others.

    Paths and the footers of their files are checked when the plan is built; a region with a file that cannot
    be read is an error as a whole, so no rows go missing in silence. The list of regions is short and fixed.
    Tables already partitioned by ``region`` need none of this: filter that column.
    """
    tables, errors = [], []
    for region, path in paths.items():
        try:
            table = spark.read.schema(schema).parquet(path)
            table.count()  # reads the footers only
        except (PySparkException, Py4JJavaError) as error:
            if on_error != "skip":
                raise
            errors.append((region, str(error).splitlines()[0]))
            continue
        tables.append(table.withColumn("region", F.lit(region)))
    empty = spark.createDataFrame([], schema)
    if "region" not in empty.columns:
        empty = empty.withColumn("region", F.lit(None).cast("string"))
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables, empty)
    return union, spark.createDataFrame(errors, "region STRING, error STRING")
