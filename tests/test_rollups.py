"""Rollups that take late points, versioned inventories, progress and end of a drain."""

import os
import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opsloom.operators import metrics
from opsloom.streaming import rollups, runner

POINTS = "region STRING, metric STRING, dims MAP<STRING,STRING>, ts TIMESTAMP, value DOUBLE"
START = datetime(2024, 1, 10)
DIMS = {"d": "D"}


class Landed:
    def __init__(self, spark, folder):
        self.spark, self.folder, self.rows = spark, str(folder), []

    def add(self, *points):
        rows = [("r", "m", {"D": d}, at, value) for d, at, value in points]
        self.rows += rows
        self.spark.createDataFrame(rows, POINTS).coalesce(1).write.mode("append").parquet(f"{self.folder}/points")

    def run(self, **options):
        stream = self.spark.readStream.schema(POINTS).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/points")
        rollups.rollup_stream(stream, f"{self.folder}/rollup", f"{self.folder}/checkpoint", "1 hour", DIMS, **options)

    def found(self):
        rows = rollups.rollup(self.spark, f"{self.folder}/rollup", ["d"]).drop("sketch").collect()
        return sorted(tuple(r) for r in rows)

    def expected(self):
        states = {}
        for region, metric, dims, at, value in self.rows:
            if at is None or value is None:
                continue
            key = (region, metric, dims["D"], at.replace(minute=0, second=0, microsecond=0))
            n, total, least, greatest = states.get(key, (0, 0.0, value, value))
            states[key] = (n + 1, total + value, min(least, value), max(greatest, value))
        return sorted((*k, *v) for k, v in states.items())


@pytest.fixture()
def landed(spark, tmp_path):
    return Landed(spark, tmp_path)


def at(**shift):
    return START + timedelta(**shift)


def test_points_days_late_change_their_period(landed):
    landed.add(("a", at(minutes=5), 1.0), ("a", at(minutes=50), 2.0), ("b", at(hours=1), 4.0))
    landed.add(("a", at(days=9), 8.0))
    landed.run(compact_every=2)
    assert landed.found() == landed.expected()
    landed.add(("a", at(minutes=6), 16.0), ("b", at(days=-3), 32.0), ("c", at(days=9), None), ("c", None, 1.0))
    landed.run(compact_every=2)
    assert landed.found() == landed.expected()
    assert ("r", "m", "a", START, 3, 19.0, 1.0, 16.0) in landed.found()
    for n in range(5):
        landed.add(("a", at(days=n), float(n)), ("a", at(minutes=n), -1.0))
        landed.run(compact_every=2)
        assert landed.found() == landed.expected()
    # What has been compacted twice over is gone; days that nothing came for keep their base.
    parts = {d for d in os.listdir(f"{landed.folder}/rollup/parts") if d.startswith("batch=")}
    assert "batch=0" not in parts and len(parts) <= 4
    bases = rollups._bases(f"{landed.folder}/rollup")
    assert bases["2024-01-19"] == [1]
    assert max(len(b) for b in bases.values()) <= 3


def test_a_batch_that_runs_again_with_its_compaction(landed):
    for n in range(4):
        landed.add(("a", at(days=n % 2), float(n)))
    landed.run(compact_every=2)
    expected = landed.found()
    assert expected == landed.expected()
    for name in os.listdir(f"{landed.folder}/checkpoint/commits"):
        if name.lstrip(".").startswith("3"):
            os.remove(f"{landed.folder}/checkpoint/commits/{name}")
    landed.run(compact_every=2)
    assert landed.found() == expected
    # A compaction that did not end is as if it had not begun.
    shutil.copytree(f"{landed.folder}/rollup/base/upto=3", f"{landed.folder}/rollup/base/upto=9")
    os.remove(f"{landed.folder}/rollup/base/upto=9/_SUCCESS")
    assert landed.found() == expected


def test_statistics_of_states(landed):
    landed.add(*[("a", at(minutes=n % 60), float(n)) for n in range(100)])
    landed.add(*[("a", at(minutes=n % 60), float(n)) for n in range(100, 200)])
    landed.run()
    states = rollups.rollup(landed.spark, f"{landed.folder}/rollup", ["d"])
    values = {s: rollups.stat(states, s).first()["value"] for s in ("Sum", "Average", "Minimum", "Maximum", "SampleCount", "p50")}
    assert values.pop("p50") == pytest.approx(99.5, abs=4)
    assert values == {"Sum": 19900.0, "Average": 99.5, "Minimum": 0.0, "Maximum": 199.0, "SampleCount": 200.0}
    with pytest.raises(ValueError):
        rollups.stat(states, "Median")
    assert landed.spark.createDataFrame([], POINTS).transform(lambda d: rollups.partial_states(d, "1 hour", DIMS)).count() == 0


def test_utilisation_by_the_shards_of_the_time(spark):
    versions = spark.createDataFrame(
        [("r", "s", 1, at(hours=0)), ("r", "s", 4, at(hours=2)), ("r", "t", 1, at(hours=9))],
        "region STRING, stream_name STRING, shards INT, valid_from TIMESTAMP",
    )
    names = ["GetRecords.Bytes", "GetRecords.Records", "IncomingBytes", "IncomingRecords"]
    rows = [("r", s, at(hours=h), 0.0, 0.0, None, 150000.0) for s, h in (("s", -1), ("s", 0), ("s", 1), ("s", 2), ("s", 99), ("t", 1))]
    usage = spark.createDataFrame(rows, "region STRING, stream_name STRING, bucket_start TIMESTAMP, " + ", ".join(f"`{n}Sum` DOUBLE" for n in names))
    got = metrics.utilisation_by_period(usage, versions).orderBy("bucket_start").collect()
    assert [(r["shards"], r["write_records_pct"], r["write_mb_pct"]) for r in got] == [(1, 50.0, 0.0)] * 2 + [(4, 12.5, 0.0)] * 2


ROWS = "id BIGINT"


def test_a_drain_notes_its_progress_and_ends(spark, tmp_path):
    queue, checkpoint, seen = f"{tmp_path}/q", f"{tmp_path}/c", f"{tmp_path}/seen"
    spark.range(7).coalesce(1).write.parquet(queue)

    def read():
        return spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(queue)

    def route(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{seen}/batch={batch_id}")
        if batch_id == 0:  # something lands while the drain is running
            spark.range(100, 105).coalesce(1).write.mode("append").parquet(queue)

    assert runner.drain_until_empty(read, checkpoint, route, empty_reads=2, interval=0.0) == 12
    assert spark.read.parquet(seen).count() == 12
    notes = [tuple(r) for r in runner.progress(spark, checkpoint).orderBy("batch").collect()]
    assert notes == [(0, 7, 7), (1, 5, 12)]
    assert runner.drain_until_empty(read, checkpoint, route, empty_reads=1) == 0
    assert runner.progress(spark, checkpoint).agg(F.sum("messages")).first()[0] == 12
