"""Tails whose memory is bounded by number."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

import __spark_entry__ as contract
from opsloom.streaming import remembered, runner

SCHEMA = "message_id STRING, body STRING, attributes MAP<STRING, STRUCT<data_type: STRING, binary_value: BINARY>>, n BIGINT"


def land(spark, folder, batches):
    for rows in batches:
        rows = [(m, b, {"k": ("Binary", b"\x00\xff")}, n) for n, (m, b) in enumerate(rows)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def tail(spark, folder, **options):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    return runner.run_available(remembered.tail_queue_bounded(stream, "n", **options), "bounded").collect()


def by_hand(batches, capacity):
    """One bucket: messages shown, in order."""
    known, shown = [], []
    for rows in batches:
        for m, b in rows:
            if m is None or m in known:
                continue
            known.append(m)
            shown.append((m, b, min(len(known), capacity)))
            known = known[-capacity:]
    return shown


def test_the_oldest_are_forgotten(spark, tmp_path):
    batches = [[(f"m{i}", f"b{i}") for i in range(6)], [("m1", "b1"), ("m5", "b5"), (None, "x"), ("m7", "b7")], [("m1", "b1"), ("m0", "b0")]]
    land(spark, f"{tmp_path}/in", batches)
    got = tail(spark, f"{tmp_path}/in", remembered=4, buckets=1)
    assert sorted((r["message_id"], r["body"], r["held"]) for r in got) == sorted(by_hand(batches, 4))
    # m1 was forgotten when m5 came, so it is shown again; m5 is not.
    assert sorted(r["message_id"] for r in got).count("m1") == 2
    assert {bytes(r["attributes"]["k"]["binary_value"]) for r in got} == {b"\x00\xff"}


def test_redeliveries_within_the_memory_are_dropped(spark, tmp_path):
    batches = [[(f"m{i % 40}", "b") for i in range(90)], [(f"m{i}", "b") for i in range(60)]]
    land(spark, f"{tmp_path}/in", batches)
    got = tail(spark, f"{tmp_path}/in", remembered=400, buckets=4)
    assert sorted(r["message_id"] for r in got) == sorted(f"m{i}" for i in range(60))
    assert max(r["held"] for r in got) <= 100


def test_state_rows_are_bounded_by_the_buckets(spark, tmp_path):
    land(spark, f"{tmp_path}/in", [[(f"{b}-{i}", "b") for i in range(300)] for b in range(3)])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    tailed = remembered.tail_queue_bounded(stream, "n", remembered=80, buckets=8)
    query = tailed.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert rows and max(rows) <= 8
    assert sum(p["numInputRows"] for p in query.recentProgress) == 900


def test_repeats_go_before_the_shuffle_and_odd_sizes():
    frame = pd.DataFrame({"m_id": ["a", "b", "a"], "m_order": [2.0, 1.0, 0.0], "m_payload": ["late", "b", "first"]})
    assert [f["m_payload"].tolist() for f in remembered._once(iter([frame]))] == [["first", "b"]]
    with pytest.raises(ValueError):
        remembered.tail_queue_bounded(None, "n", remembered=3, buckets=4)


def test_the_query_runs_in_a_session_with_another_state_store(spark):
    key, other = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    plain = spark.newSession()
    plain.conf.set(key, other)
    folder = "/root/testdata/sf0.001"
    got = contract.queries()["tail_queue_bounded"](plain, folder).collect()
    wanted = [f"msg-{r.event_id}" for r in spark.read.parquet(f"{folder}/events.parquet").select("event_id").collect()]
    assert sorted(r.message_id for r in got) == sorted(wanted)
    assert plain.conf.get(key) == other


class State:
    """Values in memory as Spark would keep them: one row per key of a state variable."""

    def __init__(self):
        self.rows, self.written = {}, 0

    def getValueState(self, name, schema, ttl):
        return self

    def getMapState(self, name, schema, values, ttl):
        return self

    def get(self):
        return self.rows.get(None)

    def update(self, value):
        self.rows[None] = value

    def getValue(self, key):
        return self.rows.get(key)

    def updateValue(self, key, value):
        self.rows[key] = value
        self.written += 1

    def removeKey(self, key):
        del self.rows[key]


@pytest.mark.parametrize("capacity", [1, 3, 4, 5, 17, 40])
def test_pages_of_a_large_memory(monkeypatch, capacity):
    monkeypatch.setattr(remembered, "PAGE", 4)
    monkeypatch.setattr(remembered, "SLICE", 7)
    monkeypatch.setattr(remembered, "HELD_BYTES", 100)
    monkeypatch.setattr(remembered, "_ROWS_BYTES", 300)
    monkeypatch.setattr(remembered, "_once", iter)
    rng, state, bucket = random.Random(capacity), State(), remembered._Bucket(capacity, None)
    bucket.init(state)
    batches = [[(f"m{rng.randrange(60)}", f"b{i}") for i in range(rng.choice([1, 5, 50]))] for _ in range(40)]
    got = []
    for rows in batches:
        frame = pd.DataFrame({"m_id": [m for m, _ in rows], "m_order": [float(n) for n in range(len(rows))], "m_payload": [b for _, b in rows], "m_bucket": 0})
        frame = frame.sample(frac=1, random_state=rng.randrange(99))
        for found in bucket.handleInputRows((0,), remembered._by_bucket(iter([frame.iloc[:3], frame.iloc[3:]])), None):
            got += found.itertuples(index=False, name=None)
        # The newest ids, and the pages before them that the memory reaches.
        assert len(state.rows) <= 1 + (capacity > 4) * (capacity // 4 + 2)
    assert sorted(got) == sorted(by_hand(batches, capacity))
    # A page is written once, whatever the number of batches.
    assert state.written <= (len(got) // 4 if capacity > 4 else 0)


def test_messages_without_a_turn_come_last():
    order = np.array([2.0, np.nan, 1.0, 2.0, np.nan])
    assert remembered._in_turn(pa.array(["b", "z", "c", "a", "y"]), order).to_pylist() == [2, 3, 0, 4, 1]
