"""Streams that are read shard by shard, with a position of its own for each.

Landed layout, below one folder: the files in ``shards`` hold JSON lines that describe shards (``shard_id``, ``parent_shard_id``, ``closed``; of
several lines about a shard the one in the last file counts), ``records/shard_id=<id>/*.parquet`` holds their
records, files in the order of their names and rows in the order of the file. Files are only added.

A position is the number of records of a shard that have been read. A read moves every shard on by at most
``records_per_read`` records. A shard is begun when its parent is closed and read to its end; a closed
shard that is read to its end is left alone from then on.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from opsloom.sources.remote import listed, opened

FORMAT = "opsloom_shards"
SCHEMA = "shard_id STRING, sequence_number STRING, data STRING, position BIGINT"
#: Records that one read takes from a shard, as the service does by default.
RECORDS_PER_READ = 10_000


class NoStream(ValueError):
    """A table that has no stream of changes."""


class ShardRange(InputPartition):
    """Consecutive records of a shard: stretches of files, in order."""

    def __init__(self, shard_id: str, position: int, stretches: list[tuple[str, int, int]]):
        super().__init__(shard_id)
        self.shard_id, self.position, self.stretches = shard_id, position, stretches


class ShardReader(DataSourceStreamReader):
    """Offsets are ``{shard_id: position}``; ``after`` is the last planned one of a query that is started again."""

    def __init__(self, path: str, start: str, records_per_read: int, after: dict | None):
        if start not in ("earliest", "latest"):
            raise ValueError("start must be earliest or latest")
        if records_per_read < 1:
            raise ValueError("a read must take records")
        self.path, self.start, self.records_per_read = path.rstrip("/"), start, records_per_read
        self.planned, self.first = after, None
        self.rows: dict[str, int] = {}  # records of a file, which does not change

    def describe(self) -> dict[str, dict]:
        """The shards as they are described now."""
        shards = {}
        system, _ = opened(self.path)
        for file in listed(f"{self.path}/shards"):
            if file.path.rsplit("/", 1)[-1].startswith((".", "_")):
                continue
            with system.open_input_stream(file.path) as stream:
                for line in stream.read().decode().splitlines():
                    if line.strip():
                        shard = json.loads(line)
                        shards[shard["shard_id"]] = shard
        return shards

    def files(self, shard_id: str) -> list[tuple[str, int]]:
        """Files of a shard with their number of records."""
        system, _ = opened(self.path)
        found = []
        for file in listed(f"{self.path}/records/shard_id={shard_id}"):
            name = file.path.rsplit("/", 1)[-1]
            if name.startswith((".", "_")) or not name.endswith(".parquet"):
                continue
            if file.path not in self.rows:
                with system.open_input_file(file.path) as source:
                    self.rows[file.path] = pq.ParquetFile(source).metadata.num_rows
            found.append((file.path, self.rows[file.path]))
        return found

    def _totals(self, shards: dict[str, dict]) -> dict[str, int]:
        return {s: sum(n for _, n in self.files(s)) for s in shards}

    def initialOffset(self) -> dict:
        """The first record of every shard, or with ``latest`` the end of each; shards that come later begin at 0.

        Spark asks again if the first batch was not committed. So with ``latest`` the first batch is the starting
        point and nothing else, and a query that is started again finds it as the offset that was planned.
        """
        if self.start == "earliest":
            return dict.fromkeys(self.describe(), 0)
        if self.planned is None:
            self.first = self._totals(self.describe())
            return self.first
        return self.planned

    def latestOffset(self) -> dict:
        if self.planned is None and self.start == "latest":
            self.planned = self.first if self.first is not None else self.initialOffset()
            return self.planned
        before, shards = self.planned or {}, self.describe()
        totals = self._totals(shards)
        after = {}
        for shard_id, shard in shards.items():
            at, parent = before.get(shard_id, 0), shard.get("parent_shard_id")
            waits = parent in shards and not (shards[parent].get("closed") and before.get(parent, 0) >= totals[parent])
            after[shard_id] = at if waits else max(at, min(totals[shard_id], at + self.records_per_read))
        self.planned = after
        return after

    def partitions(self, start: dict, end: dict) -> list[ShardRange]:
        ranges = []
        for shard_id, last in end.items():
            first, at, stretches = start.get(shard_id, 0), 0, []
            for path, n in self.files(shard_id) if last > first else ():
                low, high = max(first, at), min(last, at + n)
                if low < high:
                    stretches.append((path, low - at, high - at))
                at += n
            if stretches:
                ranges.append(ShardRange(shard_id, first, stretches))
        return ranges

    def read(self, partition: ShardRange) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        position = partition.position
        names = ["sequence_number", "data"]
        for path, low, high in partition.stretches:
            with system.open_input_file(path) as source:
                at = 0
                for batch in pq.ParquetFile(source).iter_batches(batch_size=4096, columns=names):
                    part = batch.slice(max(low - at, 0), max(0, min(high, at + len(batch)) - max(low, at)))
                    at += len(batch)
                    if len(part):
                        n = len(part)
                        columns = [
                            pa.array([partition.shard_id] * n),
                            *(part.column(c).cast(pa.string()) for c in names),
                            pa.array(range(position, position + n), pa.int64()),
                        ]
                        position += n
                        yield pa.RecordBatch.from_arrays(columns, ["shard_id", *names, "position"])
                    if at >= high:
                        break


class ShardSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ShardReader:
        after = self.options.get("after")
        return ShardReader(
            self.options["path"],
            self.options.get("start", "earliest"),
            int(self.options.get("records_per_read", RECORDS_PER_READ)),
            json.loads(after) if after else None,
        )


def planned_offset(checkpoint: str) -> str | None:
    """The offset that the last batch of a query was planned to reach, from its checkpoint; none before the first."""
    batches = [f for f in listed(f"{checkpoint.rstrip('/')}/offsets") if f.path.rsplit("/", 1)[-1].isdigit()]
    if not batches:
        return None
    last = max(batches, key=lambda f: int(f.path.rsplit("/", 1)[-1]))
    system, _ = opened(checkpoint)
    with system.open_input_stream(last.path) as stream:
        return stream.read().decode().splitlines()[-1]


def read_shards(
    spark: SparkSession,
    path: str,
    checkpoint: str,
    start: str = "earliest",
    records_per_read: int = RECORDS_PER_READ,
) -> DataFrame:
    """A stream of ``shard_id, sequence_number, data, position``.

    ``checkpoint`` is the folder of the query that will read it: a query that is started again goes on behind the
    records of its last batch. ``start`` counts for a query that begins: ``latest`` leaves out what has landed.
    """
    spark.dataSource.register(ShardSource)
    reader = spark.readStream.format(FORMAT).option("path", path).option("start", start)
    reader = reader.option("records_per_read", records_per_read)
    after = planned_offset(checkpoint)
    if after:
        reader = reader.option("after", after)
    return reader.load()


def table_stream(tables: DataFrame, name: str) -> str:
    """Where the changes of a table land. ``tables`` has ``table_name`` and, where tables have streams, ``stream_path``."""
    if "stream_path" not in tables.columns:
        tables = tables.withColumn("stream_path", F.lit(None).cast("string"))
    found = tables.where(F.col("table_name") == name).select("stream_path").take(2)
    if not found:
        raise NoStream(f"there is no table {name}")
    if len(found) > 1:
        raise NoStream(f"there are several tables named {name}: give a region")
    if not found[0]["stream_path"]:
        raise NoStream(f"table {name} has no stream of changes")
    return found[0]["stream_path"]
