"""First sightings of messages, with a memory that is bounded by number and not by time.

Ids are dealt over buckets by their hash. A bucket numbers the ids that it shows and remembers the last ``per_bucket`` of
them; the oldest go when others come. So the whole memory is ``buckets * per_bucket`` ids whatever the stream holds. A
message that comes again after ``per_bucket`` other ids of its bucket is shown again.

The state of a bucket is the ids in the order in which they were shown, in pages: one row with the newest ids and the
numbers, and a row for each ``PAGE`` ids before them, which is written once and deleted when all of its ids are
forgotten. A bucket that remembers up to ``PAGE`` ids is one row. A task holds the ids and turns of a bucket's messages
in a micro-batch and ``SLICE`` ids at a time of those remembered; payloads wait in a file.
"""

from __future__ import annotations

import tempfile
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from opsloom.session import STATE_STORE

#: Fixed value: ids that a tail remembers in all.
REMEMBERED = 100_000
BUCKETS = 256
#: Ids of a page of the state, ids that are compared at a time, and bytes of payloads that are held before a file is used.
PAGE, SLICE, HELD_BYTES = 1 << 16, 1 << 19, 8 << 20
_TEXT = pa.large_string()
#: Messages on their way to their bucket, many in a row: Python takes a row of a grouped stream as slowly as a thousand values.
_ROWS = pa.schema([("m_id", _TEXT), ("m_order", pa.float64()), ("m_payload", _TEXT)])
_ROWS_BYTES = 1 << 20
#: Settings to start a tail with: its state store, and fewer of those rows between Spark and Python at a time.
SETTINGS = {**STATE_STORE, "spark.sql.execution.arrow.maxBytesPerBatch": f"{8 * _ROWS_BYTES}b"}


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(pa.py_buffer(packed)).read_next_batch()


def _page(ids: pa.Array) -> bytes:
    return _packed(pa.record_batch([ids], names=["id"]))


def _in_turn(ids: pa.Array, order: np.ndarray) -> pa.Array:
    """Places of the messages by order and id; those without an order come last."""
    late = np.isnan(order)
    keys = pa.table({"late": late, "order": np.where(late, 0.0, order), "id": ids})
    return pc.sort_indices(keys, sort_keys=[(c, "ascending") for c in keys.column_names])


class _Bucket(StatefulProcessor):
    def __init__(self, per_bucket: int, ttl_ms: int | None):
        self.per_bucket, self.ttl_ms = per_bucket, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        numbers = "shown BIGINT, forgotten BIGINT, pages ARRAY<BIGINT>"
        self.newest = handle.getValueState("newest", f"{numbers}, ids BINARY", self.ttl_ms)
        self.older = handle.getMapState("older", "first BIGINT", "ids BINARY", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        names, order, sizes = [], [], []
        with tempfile.SpooledTemporaryFile(HELD_BYTES) as file:
            for frame in rows:
                for part in frame["m_rows"]:
                    m_id, m_order, _ = _unpacked(part).columns
                    names.append(m_id)
                    order.append(m_order.to_numpy(zero_copy_only=False))
                    sizes.append(file.write(part))
            ids, order = pa.concat_arrays(names), np.concatenate(order)
            del names
            held = self._held(ids, _in_turn(ids, order))
            file.seek(0)
            first = 0
            for size in sizes:
                part = _unpacked(file.read(size))
                here = held[first : first + len(part)]
                fresh = np.flatnonzero(here)
                if len(fresh):
                    m_id, _, m_payload = (c.to_numpy(zero_copy_only=False) for c in part.take(pa.array(fresh)).columns)
                    yield pd.DataFrame({"m_id": m_id, "m_payload": m_payload, "m_held": here[fresh]})
                first += len(part)

    def _held(self, ids: pa.Array, turn: pa.Array) -> np.ndarray:
        """For each message the number of ids that are remembered with it, 0 if it is not shown."""
        held = np.zeros(len(ids), dtype=np.int64)
        shown, forgotten, self.pages, newest = self.newest.get() or (0, 0, [], None)
        self.pages, self.tail = list(self.pages), pa.array([], _TEXT) if newest is None else _unpacked(newest).column(0)
        before = shown
        for start in range(0, len(turn), SLICE):
            places = turn.slice(start, SLICE)
            coded = ids.take(places).dictionary_encode()
            numbers = array("q", self._numbers(coded.dictionary, shown).tobytes())
            fresh, count, codes = array("q"), array("q"), coded.indices.to_numpy()
            for at, code in enumerate(codes.tolist()):
                if numbers[code] > forgotten:
                    continue
                shown += 1
                numbers[code] = shown
                forgotten = max(forgotten, shown - self.per_bucket)
                fresh.append(at)
                count.append(shown - forgotten)
            if fresh:
                fresh = np.frombuffer(fresh, np.int64)
                held[places.to_numpy()[fresh]] = np.frombuffer(count, np.int64)
                self.tail = pa.concat_arrays([self.tail, coded.dictionary.take(codes[fresh])])
                self._settle(shown, forgotten)
        if shown > before:
            for first in self.pages if self.ttl_ms else []:  # the bucket is forgotten as one
                self.older.updateValue((first,), self.older.getValue((first,)))
            self.newest.update((shown, forgotten, self.pages, _page(self.tail)))
        return held

    def _numbers(self, wanted: pa.Array, shown: int) -> np.ndarray:
        """The number under which each of the wanted ids was shown last, 0 for those that are not in the state."""
        numbers = np.zeros(len(wanted), dtype=np.int64)
        held, first, n = [], 0, 0
        for page in [*self.pages, None]:  # in the order of numbers, which have no gaps
            held.append(self.tail if page is None else _unpacked(self.older.getValue((page,))[0]).column(0))
            first = first or (shown - len(self.tail) + 1 if page is None else page)
            n += len(held[-1])
            if n >= SLICE or page is None:
                codes = pc.index_in(pa.concat_arrays(held), value_set=wanted)
                there = np.flatnonzero(codes.is_valid().to_numpy(zero_copy_only=False))
                numbers[codes.drop_null().to_numpy()] = first + there
                held, first, n = [], 0, 0
        return numbers

    def _settle(self, shown: int, forgotten: int) -> None:
        """Full pages leave the tail, and what is forgotten leaves the state."""
        if self.per_bucket <= PAGE:
            self.tail = self.tail.slice(max(len(self.tail) - (shown - forgotten), 0))
        while self.per_bucket > PAGE <= len(self.tail):
            self.pages.append(shown - len(self.tail) + 1)
            self.older.updateValue((self.pages[-1],), (_page(self.tail.slice(0, PAGE)),))
            self.tail = self.tail.slice(PAGE)
        while self.pages and [*self.pages, shown - len(self.tail) + 1][1] <= forgotten + 1:
            self.older.removeKey((self.pages.pop(0),))

    def close(self) -> None:
        pass


def _once(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Repeats within a batch of rows go before the shuffle, so an id that comes very often is not all in one task."""
    for frame in frames:
        yield frame.sort_values("m_order", kind="stable").drop_duplicates("m_id")


def _by_bucket(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The messages of each bucket in rows of about ``_ROWS_BYTES``."""
    for frame in _once(frames):
        dealt = []
        for bucket, own in frame.groupby("m_bucket"):
            columns = [pa.array(own[f.name], f.type, from_pandas=f.name != "m_order") for f in _ROWS]
            rows = pa.record_batch(columns, schema=_ROWS)
            step = max(len(rows) * _ROWS_BYTES // max(rows.nbytes, 1), 1)
            dealt += [(bucket, _packed(rows.slice(at, step))) for at in range(0, len(rows), step)]
        yield pd.DataFrame(dealt, columns=["m_bucket", "m_rows"])


def tail_queue_bounded(
    messages: DataFrame,
    order: str,
    remembered: int = REMEMBERED,
    buckets: int = BUCKETS,
    ttl_ms: int | None = None,
) -> DataFrame:
    """``message_id, body, attributes, held``: messages that are not among the last ones remembered.

    ``order`` is a column by which messages of one micro-batch are taken in turn (a number or time). ``held`` is the
    number of ids that the message's bucket remembers with it, at most ``remembered / buckets``. With ``ttl_ms`` a bucket
    that nothing has come to for so long is forgotten. Messages without id are dropped, as they cannot be known again.
    The stream starts with ``session.STATE_STORE`` only, which a session has from ``build_session`` or
    ``runner.run_available`` sets; ``SETTINGS`` has it.
    """
    per_bucket = remembered // buckets
    if per_bucket < 1:
        raise ValueError("every bucket must remember an id")
    content = F.struct("body", "attributes")
    rows = messages.where(F.col("message_id").isNotNull()).select(
        F.col("message_id").alias("m_id"),
        F.col(order).cast("double").alias("m_order"),
        F.to_json(content).alias("m_payload"),
    )
    rows = rows.withColumn("m_bucket", F.pmod(F.xxhash64("m_id"), F.lit(buckets)).cast("int"))
    rows = rows.mapInPandas(_by_bucket, "m_bucket INT, m_rows BINARY")
    found = rows.groupBy("m_bucket").transformWithStateInPandas(
        statefulProcessor=_Bucket(per_bucket, ttl_ms),
        outputStructType="m_id STRING, m_payload STRING, m_held BIGINT",
        outputMode="Append",
        timeMode="ProcessingTime" if ttl_ms else "None",
    )
    kinds = messages.select(content.alias("c")).schema["c"].dataType
    return found.select(
        F.col("m_id").alias("message_id"),
        F.from_json("m_payload", kinds).alias("c"),
        F.col("m_held").alias("held"),
    ).select("message_id", "c.body", "c.attributes", "held")
