"""Semantic version ordering as a sortable text key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The grammar of a semantic version.
SEMVER = r"^v?(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$"


def is_version(version: Column) -> Column:
    return version.rlike(SEMVER)


def version_key(version: Column) -> Column:
    """Text whose order is version precedence; null for text that is no version.

    A number is preceded by how many digits it has. A release sorts after its pre-releases; in a
    pre-release numeric identifiers sort by value and before alphanumeric ones, and a
    shorter list of identifiers sorts first. Build metadata has no weight.
    """

    def pad(text: Column) -> Column:
        digits = F.regexp_replace(text, r"^0+(?=\d)", "")
        return F.concat(F.lpad(F.length(digits).cast("string"), 9, "0"), digits)

    core = F.concat(*[pad(F.regexp_extract(version, SEMVER, i)) for i in (1, 2, 3)])
    pre = F.regexp_extract(version, SEMVER, 4)
    identifiers = F.transform(
        F.split(pre, r"\."),
        lambda part: F.when(part.rlike(r"^\d+$"), F.concat(F.lit("0"), pad(part))).otherwise(
            F.concat(F.lit("1"), part)
        ),
    )
    pre_key = F.when(pre == "", F.lit("~")).otherwise(F.concat(F.lit("!"), F.array_join(identifiers, " ")))
    return F.when(is_version(version), F.concat(core, pre_key))
