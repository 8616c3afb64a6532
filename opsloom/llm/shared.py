"""Helpers of the corpus operators: the shared folder, stored tables, row keys, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one pass of numpy works on; bounds the memory of a Python worker.
SLICE_BYTES = 1 << 20


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor reaches.

    Only a local session without that setting may use a temporary folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = f"file://{tempfile.mkdtemp(prefix='run-')}"
    return f"{base.rstrip('/')}/corpus/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends, lost executors lose nothing."""
    spark = df.sparkSession
    path = shared_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_key(text: str = "text") -> Column:
    """128 bits that stand for a whole text; null is a text of its own."""
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("binary"), F.lit(b"\x00null"))))


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Documents that no model learns from: crc32 of the id as text, modulo 4, is 2. A null id is not one."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def spread(*columns: Column | str) -> Column:
    """A stable number in 0..1 per row, for bounded samples."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / float(1 << 40)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column without a copy; null counts as empty."""
    if pa.types.is_large_string(column.type) or column.null_count:
        column = column.cast(pa.string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about ``most`` bytes (one row at least): first, last, bytes, offsets."""
    raw, bounds = utf8(column)
    first, rows = 0, len(column)
    while first < rows:
        last = int(np.searchsorted(bounds, bounds[first] + most, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last, raw[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        first = last


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ``arange(start, start + count)``."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, counts)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """128 bits for a document: its id and whole text, nulls included. Rows that repeat share it."""
    parts = F.concat(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit("\x00"), F.coalesce(F.col(text), F.lit("\x00"))
    )
    return F.unhex(F.md5(parts.cast("binary")))


def small(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most_rows`` rows; else Spark joins it by a shuffle."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
