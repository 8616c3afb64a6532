"""Line files: one message per non-empty line."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.session import shared_dir
from opsloom.sources.files import SPLIT_BYTES, list_files, read_lines
from opsloom.sources.remote import named, opened

#: Bytes of a file whose lines count as one block.
BLOCK_BYTES = 16 << 20


class Unreadable(RuntimeError):
    """Files that could not be read to their end."""


def _found(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    system, inside = opened(path.rstrip("/"))
    kind = system.get_file_info(inside).type
    if kind == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if kind == fs.FileType.File:
        files, unlisted = list_files(spark, path)
        return files.where(F.col("path") == named(path, inside)), unlisted
    files, unlisted = list_files(spark, f"{path.rstrip('/')}/")
    below = F.substring("path", len(named(path, inside)) + 1, 1 << 30)
    return files.where(~below.rlike(r"/[_.]")), unlisted


def scan_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Non-empty lines as ``(file, block, pos, line)``, of a file or of all files below a folder but the hidden ones.

    ``pos`` is the byte at which a line begins in its file and ``block`` a stretch of ``BLOCK_BYTES`` of it, so both are the
    same however the reading was split. Lines are read once and stored; what is done with them afterwards sees the
    same lines, whatever happens to the files. A file that cannot be read to its end stops the scan: a
    message that is not sent would go unnoticed.
    """
    files, unlisted = _found(spark, path)
    folder = shared_dir(spark, "lines")
    rows = read_lines(files, split_bytes).where(F.col("error").isNotNull() | (F.length("line") > 0))
    rows.write.option("compression", "zstd").parquet(folder)
    rows = spark.read.schema(rows.schema).parquet(folder)
    failed = rows.where(F.col("error").isNotNull()).select("path", "error").unionByName(unlisted).take(5)
    if failed:
        raise Unreadable("; ".join(f"{r['path']}: {r['error']}" for r in failed))
    return rows.select(
        F.col("path").alias("file"),
        F.floor(F.col("offset") / BLOCK_BYTES).cast("bigint").alias("block"),
        F.col("offset").alias("pos"),
        "line",
    )
