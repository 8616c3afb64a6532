"""Greedy packing of the lines of a file into batches, without one task per file.

Lines are packed in file order; a line opens a new batch when the open one has the
allowed number of messages or would reach the byte limit. Where a batch starts depends
on all lines before it, so a file is cut into chunks of equal length and each chunk is
packed for every place at which its first batch can start. A batch holds at most
``max_n`` lines, so there are only ``max_n`` such places. Chaining these small tables
gives the true start of every chunk, and the result equals that of one pass over the
file. Python sees line sizes only, never the text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsloom.constants import BATCH_MAX_BYTES, BATCH_MAX_MESSAGES

CHUNK_ROWS = 20_000
CHUNKS_PER_RUN = 1_000


def dense_positions(sizes: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``_p``, the running number of a line in its file, starting at 0.

    ``block`` cuts a file into ordered stretches of limited length, so no window holds
    more than one stretch, or one row per stretch.
    """
    stretch = Window.partitionBy("file", "block").orderBy(*order)
    numbered = sizes.withColumn("_r", F.row_number().over(stretch))
    # The last row of a stretch, whole, so that both branches share one shuffle of the sizes.
    last = numbered.groupBy("file", "block").agg(F.max(F.struct("_r", "n_bytes")).alias("_last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = last.select(
        F.col("file").alias("_file"),
        F.col("block").alias("_block"),
        F.coalesce(F.sum("_last._r").over(before), F.lit(0)).alias("_before"),
    )
    same = F.col("file").eqNullSafe(F.col("_file")) & F.col("block").eqNullSafe(F.col("_block"))
    return numbered.join(offsets, same).select(
        *sizes.columns, (F.col("_before") + F.col("_r") - 1).alias("_p")
    )


def _next_starts(sizes: np.ndarray, max_n: int, max_bytes: int) -> np.ndarray:
    """For every line, the line that opens the next batch if a batch starts here."""
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    here = np.arange(len(sizes))
    by_bytes = np.searchsorted(total, total[:-1] + max_bytes, side="left") - 1
    return np.maximum(here + 1, np.minimum(np.minimum(here + max_n, len(sizes)), by_bytes))


def _walk(following: np.ndarray, entry: int, own: int) -> list[int]:
    starts = []
    while entry < own:
        starts.append(entry)
        entry = int(following[entry])
    starts.append(entry)
    return starts


def pack_batches(
    lines: DataFrame,
    order: list[str] | None = None,
    max_n: int = BATCH_MAX_MESSAGES,
    max_bytes: int = BATCH_MAX_BYTES,
    chunk_rows: int = CHUNK_ROWS,
    chunks_per_run: int = CHUNKS_PER_RUN,
) -> DataFrame:
    """Adds ``n_bytes``, ``batch_id`` (within its file) and ``entry_id`` to lines.

    Lines have ``(file, block, line)`` and the ``order`` columns, which order the lines of
    a block and identify them. Sizes are UTF-8 bytes. A line over the limit is alone in
    its batch.
    """
    order = order or ["pos"]
    if chunk_rows < max_n:
        raise ValueError("a chunk must hold at least one full batch")
    keys = ["file", "block", *order]
    lines = lines.withColumn("n_bytes", F.octet_length("line"))
    chunk = F.floor(F.col("_p") / chunk_rows)
    sizes = dense_positions(lines.select(*keys, "n_bytes"), order).withColumn("_own", chunk)

    # The last batch of a chunk can reach into the next one: its first lines are shown to both.
    shared = (F.col("_p") % chunk_rows < max_n - 1) & (F.col("_own") > 0)
    spread = sizes.withColumn(
        "_chunk",
        F.explode(
            F.when(shared, F.array("_own", F.col("_own") - 1)).otherwise(F.array("_own"))
        ),
    )
    mine = (F.col("_own") == F.col("_chunk")).alias("_mine")
    rows = spread.select(*keys, "_chunk", mine, "_p", "n_bytes")

    def chunk_table(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_p")
        own = int(pdf["_mine"].sum())
        following = _next_starts(pdf["n_bytes"].to_numpy(), max_n, max_bytes)
        walks = [_walk(following, entry, own) for entry in range(max_n)]
        return pd.DataFrame(
            {
                "file": [pdf["file"].iloc[0]],
                "_chunk": [pdf["_chunk"].iloc[0]],
                "exits": [[w[-1] - own for w in walks]],
                "batches": [[len(w) - 1 for w in walks]],
            }
        )

    table = "exits ARRAY<INT>, batches ARRAY<BIGINT>"
    chunks = rows.groupBy("file", "_chunk").applyInPandas(
        chunk_table, f"file STRING, _chunk BIGINT, {table}"
    )
    chunks = chunks.withColumn("_run", F.floor(F.col("_chunk") / chunks_per_run))

    def run_table(pdf: pd.DataFrame) -> pd.DataFrame:
        exits, batches = np.arange(max_n), np.zeros(max_n, dtype=np.int64)
        for row in pdf.sort_values("_chunk").itertuples():
            batches = batches + np.asarray(row.batches)[exits]
            exits = np.asarray(row.exits)[exits]
        return pd.DataFrame(
            {
                "file": [pdf["file"].iloc[0]],
                "_run": [pdf["_run"].iloc[0]],
                "exits": [exits.tolist()],
                "batches": [batches.tolist()],
            }
        )

    def starts(column: str, given: bool):
        """Entry and number of earlier batches for each table, chained in order."""

        def chain(pdf: pd.DataFrame, entry: int, base: int) -> pd.DataFrame:
            pdf = pdf.sort_values(column)
            entries, bases = [], []
            for row in pdf.itertuples():
                entries.append(entry)
                bases.append(base)
                base += int(row.batches[entry])
                entry = int(row.exits[entry])
            return pd.DataFrame(
                {"file": pdf["file"], column: pdf[column], "_entry": entries, "_base": bases}
            )

        if not given:
            return lambda pdf: chain(pdf, 0, 0)
        return lambda pdf, at: chain(pdf, int(at["_entry"].iloc[0]), int(at["_base"].iloc[0]))

    run_starts = (
        chunks.groupBy("file", "_run")
        .applyInPandas(run_table, f"file STRING, _run BIGINT, {table}")
        .groupBy("file")
        .applyInPandas(starts("_run", False), "file STRING, _run BIGINT, _entry INT, _base BIGINT")
    )
    chunk_starts = (
        chunks.groupBy("file", "_run")
        .cogroup(run_starts.groupBy("file", "_run"))
        .applyInPandas(starts("_chunk", True), "file STRING, _chunk BIGINT, _entry INT, _base BIGINT")
    )

    def number(pdf: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_p")
        own = int(pdf["_mine"].sum())
        following = _next_starts(pdf["n_bytes"].to_numpy(), max_n, max_bytes)
        opens = np.zeros(own, dtype=np.int64)
        opens[_walk(following, int(at["_entry"].iloc[0]), own)[:-1]] = 1
        # Lines before the first start belong to the batch opened in the chunk before.
        batch = int(at["_base"].iloc[0]) - 1 + np.cumsum(opens)
        return pdf.loc[pdf["_mine"], keys].assign(batch_id=batch)

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys)
    numbered = (
        rows.groupBy("file", "_chunk")
        .cogroup(chunk_starts.groupBy("file", "_chunk"))
        .applyInPandas(number, f"{kinds}, batch_id BIGINT")
    )
    return lines.join(numbered, keys).withColumn(
        "entry_id", F.sha2(F.concat_ws(":", *[F.col(k).cast("string") for k in keys]), 256)
    )
