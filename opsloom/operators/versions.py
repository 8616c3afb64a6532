"""Latest published versions and drift of deployed applications."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsloom.constants import STATE_MACHINE_OUTPUT, VERSION_TAG
from opsloom.functions.versions import is_version, version_key


def latest_version(versions: DataFrame, on_invalid: str = "error") -> DataFrame:
    """Highest semantic version per application.

    Text that is no version raises an error, or is left out with ``on_invalid="skip"``.
    """
    key = version_key(F.col("version"))
    if on_invalid == "skip":
        versions = versions.where(is_version(F.col("version")))
    else:
        message = F.concat(F.lit("not a semantic version: "), F.col("version"))
        key = F.coalesce(key, F.raise_error(message).cast("string"))
    highest = versions.groupBy("app").agg(F.max(F.struct(key.alias("key"), "version")).alias("_m"))
    return highest.select("app", F.col("_m.version").alias("latest_version"))


def sorted_versions(versions: DataFrame) -> DataFrame:
    """Versions in descending precedence within each application."""
    return versions.orderBy("app", F.desc(version_key(F.col("version"))))


def version_places(versions: DataFrame) -> DataFrame:
    """Versions with their ``place`` within the application, the highest being 1 and equal ones sharing theirs."""
    highest = Window.partitionBy("app").orderBy(F.desc(version_key(F.col("version"))))
    return versions.select("app", "version").distinct().withColumn("place", F.dense_rank().over(highest))


def version_drift(latest: DataFrame, stacks: DataFrame) -> DataFrame:
    """Deployed against latest version. ``stacks`` has ``(app, tags, outputs)``."""
    deployed = stacks.select(
        "app",
        F.col("tags")[VERSION_TAG].alias("deployed_version"),
        F.col("outputs")[STATE_MACHINE_OUTPUT].alias("state_machine_arn"),
    )
    joined = latest.join(deployed, "app", "left")
    # A stack without a version tag cannot be told apart from none.
    status = (
        F.when(F.col("deployed_version").isNull(), "not found")
        .when(F.col("deployed_version") != F.col("latest_version"), "outdated")
        .when(F.col("state_machine_arn").isNull(), "not found")
        .otherwise("active")
    )
    return joined.select(
        "app",
        "latest_version",
        "deployed_version",
        status.alias("status"),
        F.when(status == "active", F.col("state_machine_arn")).alias("state_machine_arn"),
    )
