"""The given tables landed as files, for the operators that read files: shards, queues, objects, lines."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.session import shuffles_dropped
from opsloom.sources.remote import opened


def land_shards(records: DataFrame, path: str, shards: list[dict]) -> None:
    """Records (``shard_id, sequence_number, data``) and descriptions in the layout of ``sources.shards``."""
    spark = records.sparkSession
    described = spark.createDataFrame([(json.dumps(s),) for s in shards], "value STRING")
    described.coalesce(1).write.text(f"{path}/shards")
    columns = ["shard_id", "sequence_number", "data"]
    # Tasks hold ranges of a shard's records, and their files are named in the order of the ranges.
    ordered = records.select(*columns).repartitionByRange("shard_id", "sequence_number").sortWithinPartitions(*columns[:2])
    ordered.write.mode("append").partitionBy("shard_id").parquet(f"{path}/records")


#: Parts that a source's rows are dealt over, a file each.
PARTS = 4


def _in_parts(rows: DataFrame, path: str) -> None:
    """``source, doc_id, value`` rows as text, one file per source and part in the order of doc_id."""
    rows = rows.select("source", (F.col("doc_id") % PARTS).alias("part"), "doc_id", "value")
    rows = rows.repartition("source", "part").sortWithinPartitions("source", "part", "doc_id").drop("doc_id")
    with shuffles_dropped(rows.sparkSession):
        rows.write.partitionBy("source", "part").text(path)


def part_name(path: Column | str) -> Column:
    """``<source>/<part>`` of the path of a file that was landed so, and the name of any other."""
    path = F.col(path) if isinstance(path, str) else path
    # Only the end of the path: a search that may begin anywhere tries every sign of it.
    end = F.substring_index(path, "/", -3)
    found, part = [F.regexp_extract(end, r"^([^/]*)/part=(\d+)/[^/]*$", i) for i in (1, 2)]
    return F.when(found == "", F.element_at(F.split(path, "/"), -1)).otherwise(F.concat(found, F.lit("/"), part))


def land_texts(docs: DataFrame, path: str) -> None:
    """The texts of documents as line files."""
    _in_parts(docs.select("source", "doc_id", F.coalesce("text", F.lit("")).alias("value")), path)


def land_objects(docs: DataFrame, path: str) -> None:
    """Documents as files of JSON lines, with names that Spark's readers would not find or not take as names.

    The first source's folder begins with an underscore and holds signs of patterns. Every 97th line is broken off. Next
    to the folders lie an empty file and a hidden one that is not what its name says.
    """
    line = F.to_json(F.struct("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "n_chars"))
    broken = F.concat(F.lit('{"doc_id": '), F.col("doc_id").cast("string"))
    value = F.when(F.col("doc_id") % 97 == 5, broken).otherwise(line)
    _in_parts(docs.select("source", "doc_id", value.alias("value")), path)
    system, inside = opened(path)
    system.move(f"{inside}/source=src0", f"{inside}/_src0 [a-b]{{c}}*")
    for name, content in (("empty.json", b""), (".cut.json.gz", b"\x1f\x8b\x08\x00")):
        with system.open_output_stream(f"{inside}/{name}", compression=None) as out:
            out.write(content)


def landed(files: DataFrame) -> DataFrame:
    """Of a listing what was landed, without the checksums and marks that the writer of files leaves."""
    return files.where(~F.col("path").rlike(r"(\.crc|/_SUCCESS)$"))


def land_regions(rows: DataFrame, path: str, unreadable: str) -> dict[str, str]:
    """Rows by region in a folder each; a file of one region is not what its name says. Returns the folders."""
    rows.write.partitionBy("region").parquet(path)
    names = sorted(r["region"] for r in rows.select("region").distinct().collect())  # regions are few
    folders = {name: f"{path}/region={name}" for name in [*names, "nowhere"]}
    system, inside = opened(folders[unreadable])
    with system.open_output_stream(f"{inside}/part-bad.parquet") as out:
        out.write(b"PAR1 but no more")
    return folders
