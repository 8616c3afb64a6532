"""A sink with a result per message, for batch and streaming writes, that shows every epoch once.

Tasks hand entries to a sender in requests and stage a part file with the outcome of each (``parts/``). The driver then
commits the names of the parts in one manifest per epoch (``manifests/``); only small numbers and names
pass through it. Readers see parts that a manifest names. So what a failed or repeated task staged is never read, and an epoch
that runs again after a crash finds its manifest and withdraws. Towards a service delivery is at least once, with
the same ids.

A ``sender`` is a picklable callable as in ``sinks.delivery``; without one, messages land in the parts themselves
and are refused for their size only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceStreamArrowWriter,
    WriterCommitMessage,
)
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from opsloom.constants import BATCH_MAX_BYTES
from opsloom.sinks.delivery import REQUEST_SIZE, Sender, _send
from opsloom.sources.remote import opened

FORMAT = "opsloom_outbox"
_PART = pa.schema([("entry_id", pa.string()), ("body", pa.string()), ("status", pa.string()), ("error", pa.string())])
#: Bytes of bodies after which a task writes what it has to its part.
_FLUSH_BYTES = 8 << 20


@dataclass
class Staged(WriterCommitMessage):
    part: str | None
    accepted: int
    refused: int


class _Outbox:
    """What batch and streaming writers share. The fields are plain values, as writers travel to the tasks."""

    def __init__(self, options: dict, schema: StructType, sender: Sender | None):
        missing = {"entry_id", "body"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"an entry has {', '.join(sorted(missing))}")
        self.path = options["path"].rstrip("/")
        self.max_bytes = int(options.get("max_bytes", BATCH_MAX_BYTES))
        self.request_size = int(options.get("request_size", REQUEST_SIZE["queue"]))
        self.sender = sender

    def _requests(self, batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        """Entries one after the other; one request has entries of one ``request``, if rows have that column."""
        held: list[dict] = []
        for batch in batches:
            names = batch.schema.names
            requests = batch.column(names.index("request")).to_pylist() if "request" in names else None
            ids, bodies = (batch.column(names.index(c)).to_pylist() for c in ("entry_id", "body"))
            for i, (entry_id, body) in enumerate(zip(ids, bodies, strict=True)):
                request = requests[i] if requests else None
                if held and (len(held) == self.request_size or held[-1]["request"] != request):
                    yield held
                    held = []
                held.append({"entry_id": entry_id, "body": body, "request": request})
        if held:
            yield held

    def _outcome(self, request: list[dict]) -> list[str | None]:
        """The error of every entry; those that are too long are not handed on."""
        errors: list[str | None] = ["message is too long" if len((e["body"] or "").encode()) >= self.max_bytes else None for e in request]
        if self.sender is not None:
            entries = [{"entry_id": e["entry_id"], "body": e["body"]} for e, bad in zip(request, errors, strict=True) if not bad]
            sent = iter(_send(entries, self.sender) if entries else [])
            errors = [bad or next(sent) for bad in errors]
        return errors

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        part = accepted = refused = writer = out = None
        accepted = refused = 0
        rows: list[tuple] = []
        size = 0
        system, inside = opened(f"{self.path}/parts")

        def flush() -> None:
            nonlocal writer, out, part, rows, size
            if writer is None:
                system.create_dir(inside, recursive=True)
                part = f"{uuid.uuid4().hex}.parquet"
                out = system.open_output_stream(f"{inside}/{part}")
                writer = pq.ParquetWriter(out, _PART, compression="zstd")
            writer.write_table(pa.table([list(c) for c in zip(*rows, strict=True)], schema=_PART))
            rows, size = [], 0

        for request in self._requests(iterator):
            for entry, error in zip(request, self._outcome(request), strict=True):
                rows.append((entry["entry_id"], entry["body"], "fail" if error else "success", error))
                size += len(entry["body"] or "")
                refused += bool(error)
                accepted += not error
            if size >= _FLUSH_BYTES:
                flush()
        if rows:
            flush()
        if writer is not None:
            writer.close()
            out.close()
        return Staged(part, accepted, refused)

    def _drop(self, messages: list[Staged | None]) -> None:
        system, inside = opened(f"{self.path}/parts")
        for message in messages:
            if message is not None and message.part and system.get_file_info(f"{inside}/{message.part}").type == fs.FileType.File:
                system.delete_file(f"{inside}/{message.part}")

    def _manifest(self, name: str, messages: list[Staged | None]) -> bool:
        """Writes the manifest of an epoch, unless it is there."""
        system, inside = opened(f"{self.path}/manifests")
        if system.get_file_info(f"{inside}/{name}.json").type == fs.FileType.File:
            return False
        system.create_dir(inside, recursive=True)
        lines = [
            {"epoch": name, "part": m.part, "accepted": m.accepted, "refused": m.refused}
            for m in messages
            if m is not None and m.part
        ]
        # Readers leave out hidden files, so a manifest is there as a whole or not at all.
        with system.open_output_stream(f"{inside}/.{name}") as out:
            out.write("".join(json.dumps(line) + "\n" for line in lines).encode())
        system.move(f"{inside}/.{name}", f"{inside}/{name}.json")
        return True


class OutboxWriter(_Outbox, DataSourceArrowWriter):
    def commit(self, messages: list[Staged | None]) -> None:
        self._manifest(uuid.uuid4().hex, messages)

    def abort(self, messages: list[Staged | None]) -> None:
        self._drop(messages)


class OutboxStreamWriter(_Outbox, DataSourceStreamArrowWriter):
    def __init__(self, options: dict, schema: StructType, sender: Sender | None):
        super().__init__(options, schema, sender)
        if "query" not in options:
            raise ValueError("a stream is sent by send_stream, which knows it by its checkpoint")
        self.query = options["query"]

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        if not self._manifest(f"{self.query}-{batchId}", messages):
            self._drop(messages)  # an earlier run of this epoch has been committed

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        self._drop(messages)


def outbox(sender: Sender | None = None) -> type[DataSource]:
    """A data source class to register; its writers hand entries to ``sender``."""

    class Outbox(DataSource):
        @classmethod
        def name(cls) -> str:
            return FORMAT

        def writer(self, schema: StructType, overwrite: bool) -> OutboxWriter:
            if overwrite:
                raise ValueError("what was sent cannot be overwritten")
            return OutboxWriter(dict(self.options), schema, sender)

        def streamWriter(self, schema: StructType, overwrite: bool) -> OutboxStreamWriter:
            return OutboxStreamWriter(dict(self.options), schema, sender)

    return Outbox


def _entries(messages: DataFrame) -> DataFrame:
    return messages.select("entry_id", "body", *(["request"] if "request" in messages.columns else []))


def send(messages: DataFrame, path: str, sender: Sender | None = None, **options: int) -> None:
    """Sends ``entry_id, body`` rows, and ``request`` where some are to go together; see :func:`results`.

    Rows of one request must stand together. ``request_size`` bounds a request and ``max_bytes`` a message.
    """
    messages.sparkSession.dataSource.register(outbox(sender))
    writer = _entries(messages).write.format(FORMAT).mode("append").option("path", path)
    writer.options(**options).save()


def send_stream(
    messages: DataFrame, path: str, checkpoint: str, sender: Sender | None = None, **options: int
) -> StreamingQuery:
    """Sends all that a stream has now, and returns the ended query. The checkpoint tells streams of one path apart."""
    messages.sparkSession.dataSource.register(outbox(sender))
    writer = _entries(messages).writeStream.format(FORMAT).option("path", path).option("query", _known(checkpoint))
    query = writer.options(**options).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _known(checkpoint: str) -> str:
    """The name of the query that a checkpoint is of; it goes with the checkpoint."""
    system, inside = opened(checkpoint.rstrip("/"))
    file = f"{inside}/outbox"
    if system.get_file_info(file).type == fs.FileType.File:
        with system.open_input_stream(file) as stream:
            return stream.read().decode()
    system.create_dir(inside, recursive=True)
    name = uuid.uuid4().hex
    with system.open_output_stream(file) as out:
        out.write(name.encode())
    return name


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """``epoch, part, accepted, refused`` of all that was committed."""
    counted = [StructField(c, LongType()) for c in ("accepted", "refused")]
    schema = StructType([StructField("epoch", StringType()), StructField("part", StringType()), *counted])
    system, inside = opened(f"{path.rstrip('/')}/manifests")
    if system.get_file_info(inside).type != fs.FileType.Directory:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(f"{path.rstrip('/')}/manifests")


def results(spark: SparkSession, path: str) -> DataFrame:
    """``entry_id, body, status, error, epoch`` of every entry that was sent, each epoch once."""
    listed = manifests(spark, path).select("epoch", F.col("part").alias("_part"))
    schema = "entry_id STRING, body STRING, status STRING, error STRING"
    system, inside = opened(f"{path.rstrip('/')}/parts")
    if system.get_file_info(inside).type != fs.FileType.Directory:
        return spark.createDataFrame([], f"{schema}, epoch STRING")
    parts = spark.read.schema(schema).parquet(f"{path.rstrip('/')}/parts").select("*", F.col("_metadata.file_name").alias("_part"))
    return parts.join(listed, "_part").select("entry_id", "body", "status", "error", "epoch")
