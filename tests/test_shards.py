"""Streams with a position per shard."""

import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from opsloom.commands import run
from opsloom.sources import shards
from opsloom.streaming import runner


class Landed:
    """A stream on disk, written by hand."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder
        self.path, self.checkpoint, self.table = f"{folder}/stream", f"{folder}/checkpoint", f"{folder}/table"
        os.makedirs(f"{self.path}/shards")
        self.described = 0

    def describe(self, *lines):
        with open(f"{self.path}/shards/{self.described:03d}.json", "w") as out:
            out.write("\n".join(json.dumps(line) for line in lines) + "\n")
        self.described += 1

    def add(self, shard, file, first, n):
        folder = f"{self.path}/records/shard_id={shard}"
        os.makedirs(folder, exist_ok=True)
        numbers = [f"{i:06d}" for i in range(first, first + n)]
        table = pa.table({"data": [f"{shard}:{x}" for x in numbers], "sequence_number": numbers})
        pq.write_table(table, f"{folder}/{file}.parquet", row_group_size=3)

    def stream(self, **options):
        return shards.read_shards(self.spark, self.path, self.checkpoint, **options)

    def run(self, batches=None, **options):
        runner.run_batches(self.stream(**options), self.checkpoint, self.table, batches)

    def rows(self):
        """(shard, batch) with the sequence numbers read."""
        found = {}
        table = runner.batch_table(self.spark, self.table, self.spark.createDataFrame([], shards.SCHEMA).schema)
        for r in sorted(table.collect(), key=lambda r: (r["shard_id"], r["batch"], r["position"])):
            assert r["data"] == f"{r['shard_id']}:{r['sequence_number']}"
            found.setdefault((r["shard_id"], r["batch"]), []).append(int(r["sequence_number"]))
        return found


@pytest.fixture()
def landed(spark, tmp_path):
    return Landed(spark, str(tmp_path))


def test_reads_restart_and_parents_before_children(landed):
    landed.describe({"shard_id": "a", "closed": True}, {"shard_id": "b"}, {"shard_id": "c", "parent_shard_id": "a"})
    landed.add("a", "0", 0, 7)
    landed.add("a", "1", 7, 6)
    landed.add("b", "0", 0, 4)
    landed.add("c", "0", 100, 7)
    landed.run(1, records_per_read=5)
    assert landed.rows() == {("a", 0): [0, 1, 2, 3, 4], ("b", 0): [0, 1, 2, 3]}
    landed.run(records_per_read=5)
    expected = {
        ("a", 0): list(range(5)), ("a", 1): list(range(5, 10)), ("a", 2): list(range(10, 13)),
        ("b", 0): list(range(4)), ("c", 3): list(range(100, 105)), ("c", 4): [105, 106],
    }
    assert landed.rows() == expected
    # Nothing new: nothing is read. Then a file of an open shard, and a shard that is split off it.
    landed.run(records_per_read=5)
    assert landed.rows() == expected
    landed.add("b", "1", 4, 2)
    landed.describe({"shard_id": "b", "closed": True}, {"shard_id": "d", "parent_shard_id": "b"})
    landed.add("d", "0", 0, 1)
    landed.run(records_per_read=5)
    assert landed.rows() == {**expected, ("b", 5): [4, 5], ("d", 6): [0]}


def test_a_batch_that_was_not_committed_is_read_again_once(landed):
    landed.describe({"shard_id": "a"})
    landed.add("a", "0", 0, 9)
    landed.run(1, records_per_read=4)
    # As after a crash between the work and its commit: the batch is planned, and not known to be done.
    for name in os.listdir(f"{landed.checkpoint}/commits"):
        os.remove(f"{landed.checkpoint}/commits/{name}")
    landed.run(records_per_read=4)
    assert landed.rows() == {("a", 0): [0, 1, 2, 3], ("a", 1): [4, 5, 6, 7], ("a", 2): [8]}


def test_latest_leaves_out_what_has_landed_per_shard(landed):
    landed.describe({"shard_id": "a"}, {"shard_id": "b"})
    landed.add("a", "0", 0, 5)
    query = landed.stream(start="latest").writeStream.format("memory").queryName("latest_shards")
    query = query.option("checkpointLocation", landed.checkpoint).trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
        landed.add("a", "1", 5, 1)
        landed.add("b", "0", 0, 2)
        query.processAllAvailable()
        rows = landed.spark.sql("SELECT shard_id, sequence_number FROM latest_shards").collect()
    finally:
        query.stop()
    assert sorted(tuple(r) for r in rows) == [("a", "000005"), ("b", "000000"), ("b", "000001")]


def test_a_start_at_the_latest_survives_a_crash_in_its_first_batch(landed):
    landed.describe({"shard_id": "a"})
    landed.add("a", "0", 0, 5)
    landed.run(1, start="latest")
    for name in os.listdir(f"{landed.checkpoint}/commits"):
        os.remove(f"{landed.checkpoint}/commits/{name}")
    landed.add("a", "1", 5, 2)
    landed.run(start="latest")
    assert landed.rows() == {("a", 1): [5, 6]}


def test_reader_positions_without_spark(landed):
    landed.describe({"shard_id": "x", "closed": True}, {"shard_id": "y", "parent_shard_id": "x"}, {"shard_id": "z", "parent_shard_id": "gone"})
    landed.add("y", "0", 0, 2)
    landed.add("z", "0", 0, 2)
    reader = shards.ShardReader(landed.path, "earliest", 1, None)
    assert reader.initialOffset() == {"x": 0, "y": 0, "z": 0}
    # An empty closed parent holds nobody up, and neither does one that is no longer listed.
    assert reader.latestOffset() == {"x": 0, "y": 1, "z": 1}
    assert reader.latestOffset() == reader.latestOffset() == {"x": 0, "y": 2, "z": 2}
    assert reader.partitions({"y": 2, "z": 2}, {"x": 0, "y": 2, "z": 2}) == []
    (only,) = reader.partitions({"z": 1}, {"z": 2})
    assert [b.to_pydict()["position"] for b in reader.read(only)] == [[1]]
    for bad in ({"start": "middle"}, {"records_per_read": 0}):
        with pytest.raises(ValueError):
            shards.ShardReader(**{"path": landed.path, "start": "latest", "records_per_read": 1, "after": None, **bad})


def test_a_table_without_a_stream_is_an_error(spark, tmp_path):
    rows = [("eu", "users", None), ("eu", "orders", "/streams/orders"), ("us", "twice", "/a"), ("eu", "twice", "/b")]
    tables = spark.createDataFrame(rows, "region STRING, table_name STRING, stream_path STRING")
    assert shards.table_stream(tables, "orders") == "/streams/orders"
    for name in ("users", "none", "twice"):
        with pytest.raises(shards.NoStream):
            shards.table_stream(tables, name)
    with pytest.raises(shards.NoStream):
        shards.table_stream(tables.drop("stream_path"), "orders")
    tables.write.parquet(f"{tmp_path}/tables")
    with pytest.raises(shards.NoStream):
        run(spark, ["tail-dynamodb", "-n", "users", "--tables", str(tmp_path)])
    with pytest.raises(ValueError):
        run(spark, ["tail-dynamodb", "--tables", str(tmp_path)])
