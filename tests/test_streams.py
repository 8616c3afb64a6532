import base64
import gzip
import json
import os
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opsloom import schemas
from opsloom.operators import metrics
from opsloom.session import shared_dir
from opsloom.sinks.delivery import replay_router
from opsloom.streaming import runner, tails

START = datetime(2024, 1, 1)


def land(spark, rows, schema, folder, n):
    """One file per call, each newer than the one before."""
    path = f"{folder}/file-{n}"
    spark.createDataFrame(rows, schema).coalesce(1).write.json(path)
    for name in os.listdir(path):
        if name.endswith(".json"):
            os.makedirs(f"{folder}/in", exist_ok=True)
            target = f"{folder}/in/{n}.json"
            with open(f"{path}/{name}") as source, open(target, "w") as out:
                out.write(source.read())
            moment = (START + timedelta(hours=n)).timestamp()
            os.utime(target, (moment, moment))


MESSAGES = "message_id STRING, receipt_handle STRING, body STRING, attributes MAP<STRING,STRING>, event_time TIMESTAMP"


@pytest.fixture()
def landed(spark, tmp_path):
    """Three files, each with messages of every event time and redeliveries of the first file."""
    for n in range(3):
        fresh = [(f"m{n}-{i}", "r", f"b{i}", None, START + timedelta(days=(i * 7 + n) % 30)) for i in range(50)]
        again = [(f"m0-{i}", "r", f"b{i}", None, START + timedelta(days=(i * 7) % 30)) for i in range(20)]
        land(spark, fresh + (again if n else []), MESSAGES, tmp_path, n)
    return f"{tmp_path}/in"


def test_redeliveries_are_dropped_and_no_late_message_is_lost(spark, landed):
    stream = runner.read_stream(spark, landed, MESSAGES, "json", max_files=1, arrival="received_at")
    got = runner.run_available(tails.tail_queue(stream, horizon="12 hours"), "dedup")
    assert got.count() == 150 and got.select("message_id").distinct().count() == 150


def test_an_event_time_watermark_would_lose_messages(spark, landed):
    stream = runner.read_stream(spark, landed, MESSAGES, "json", max_files=1)
    got = runner.run_available(tails.tail_queue(stream, arrival="event_time"), "dedup-late")
    assert got.count() < 150


def test_drain_stops_and_continues_from_its_checkpoint(spark, landed, tmp_path):
    target, checkpoint = f"{tmp_path}/target", f"{tmp_path}/checkpoint"
    attributes = F.map_from_entries(F.array().cast("array<struct<key: string, value: struct<data_type: string, string_value: string>>>"))

    def read():
        stream = runner.read_stream(spark, landed, MESSAGES, "json", max_files=1)
        return stream.withColumn("attributes", attributes)

    runner.drain(read(), checkpoint, replay_router("stream", target))
    assert spark.read.json(target).count() == 190
    runner.drain(read(), checkpoint, replay_router("stream", target))
    assert spark.read.json(target).count() == 190
    land(spark, [("new", "r", "b", None, START)], MESSAGES, tmp_path, 3)
    runner.drain(read(), checkpoint, replay_router("stream", target))
    assert spark.read.json(target).count() == 191


def test_router_overwrites_a_repeated_batch(spark, tmp_path):
    route = replay_router("topic", f"{tmp_path}/t", replay="one")
    batch = spark.createDataFrame([("m", "r", "b", {"a": ("String", "x", None)}, START)], schemas.MESSAGES)
    route(batch, 0)
    route(batch, 0)
    assert spark.read.json(f"{tmp_path}/t").count() == 1


def test_an_older_file_that_lands_later_is_replayed(spark, tmp_path):
    attributes = F.map_from_entries(F.array().cast("array<struct<key: string, value: struct<data_type: string, string_value: string>>>"))

    def go(queue, checkpoint):
        stream = runner.read_stream(spark, f"{queue}/in", MESSAGES, "json", arrival="received_at")
        runner.drain(tails.tail_queue(stream.withColumn("attributes", attributes)), checkpoint, replay_router("queue", f"{tmp_path}/target"))

    for name in ("a", "b"):
        land(spark, [(f"{name}1", "r", "x", None, START)], MESSAGES, tmp_path / name, 0)
        go(f"{tmp_path}/{name}", f"{tmp_path}/{name}-checkpoint")
    land(spark, [("a2", "r", "x", None, START), ("a1", "r", "x", None, START)], MESSAGES, tmp_path / "a", 1)
    old = time.time() - 30 * 24 * 3600
    for f in (tmp_path / "a" / "in").rglob("*"):
        if f.is_file():
            os.utime(f, (old, old))
    go(f"{tmp_path}/a", f"{tmp_path}/a-checkpoint")
    assert sorted(r[0] for r in spark.read.json(f"{tmp_path}/target").select("message_id").collect()) == ["a1", "a2", "b1"]


def test_latest_start_skips_what_has_landed(spark, landed):
    stream = runner.read_stream(spark, landed, MESSAGES, "json", start="latest")
    assert runner.run_available(stream.select("message_id"), "latest").count() == 0
    later = runner.read_stream(spark, landed, MESSAGES, "json", start=START + timedelta(hours=1))
    assert runner.run_available(later.select("message_id"), "later").count() == 140
    with pytest.raises(ValueError):
        runner.read_stream(spark, landed, MESSAGES, "json", start="middle")


POINTS = "region STRING, metric STRING, dims MAP<STRING,STRING>, ts TIMESTAMP, value DOUBLE"


def test_stream_rollup_equals_batch(spark, tmp_path):
    for n in range(3):
        rows = [("r", "m", {"D": f"d{i % 3}"}, START + timedelta(minutes=i + 60 * n), float(i)) for i in range(70)]
        land(spark, rows, POINTS, tmp_path, n)
    read = lambda: runner.read_stream(spark, f"{tmp_path}/in", POINTS, "json", max_files=1)
    stream = tails.metric_stat_stream(read(), "5 minutes", "Average", {"d": "D"}, "30 minutes")
    keys = ["region", "metric", "d", "bucket_start"]
    got = runner.run_latest(stream, "rollup", keys)
    batch = metrics.metric_stat(
        spark.read.schema(POINTS).json(f"{tmp_path}/in"), "5 minutes", "Average", {"d": "D"}
    )
    columns = [*keys, "value"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, batch.select(columns).collect()))
    closed = tails.metric_stat_stream(read(), "5 minutes", "Average", {"d": "D"}, "30 minutes")
    assert 0 < runner.run_available(closed, "closed").count() < batch.count()


def encode(data):
    return base64.b64encode(data).decode()


def test_records(spark, tmp_path):
    payloads = ["message 1", "message 2", '{"message":42}', '{"foo":"bar"}']
    rows = [("s0", str(i), encode(p.encode())) for i, p in enumerate(payloads)]
    rows += [("s1", str(i + 4), encode(gzip.compress(p.encode()))) for i, p in enumerate(payloads)]
    rows += [("s2", "8", encode(gzip.compress(b"cut")[:-4])), ("s2", "9", encode(b"\xff ok")), ("s2", "a", None)]
    land(spark, rows, schemas.STREAM_RECORDS, tmp_path, 0)
    stream = runner.read_stream(spark, f"{tmp_path}/in", schemas.STREAM_RECORDS, "json")
    got = {r.sequence_number: r for r in runner.run_available(tails.tail_records(stream), "records").collect()}
    assert [got[str(i)].text for i in range(8)] == payloads * 2
    assert [got[str(i)].is_json for i in range(4)] == [False, False, True, True]
    assert got["8"].text.startswith("\x1f") and got["9"].text == "� ok" and got["a"].text is None


def test_envelopes(spark):
    body = lambda o: spark.createDataFrame([(json.dumps(o),)], "body STRING")
    topic = tails.tail_topic(body({"Subject": "my test message", "Message": "message 1"})).first()
    assert (topic.subject, topic.message, topic.timestamp) == ("my test message", "message 1", None)
    event = {"region": "us-east-1", "source": "my-source", "resources": [], "detail-type": "order_placed",
             "detail": '{"orderId":"orderId"}', "time": "t"}
    got = tails.tail_events(body(event)).first()
    assert (got.detail_type, got.detail, got.resources) == ("order_placed", '{"orderId":"orderId"}', [])
    assert tails.tail_events(body({**event, "detail": {"orderId": 1}})).first().detail == '{"orderId":1}'
    assert tails.tail_events(body(event), not_source="my-source").count() == 0
    assert tails.tail_cloudwatch_events_rule(body(event), source="my-source", detail_type="other").count() == 0
    change = {"eventID": "1", "eventName": "INSERT", "dynamodb": {
        "Keys": {"id": {"S": "a"}}, "NewImage": {"id": {"S": "a"}, "n": {"N": "1"}},
        "SequenceNumber": "300000000000000499659", "SizeBytes": 41, "StreamViewType": "KEYS_ONLY"}}
    got = tails.tail_changes(body(change)).first()
    assert got.keys == {"id": "a"} and got.new_image == {"id": "a", "n": "1"} and got.old_image is None
    assert got.sequence_number == "300000000000000499659"


def test_logs(spark):
    rows = [("r", "1:/aws/lambda/a", "s", START, "old mcdonald", None), ("r", "1:/aws/lambda/b", "s", START, "farm", None)]
    logs = spark.createDataFrame(rows, schemas.LOGS)
    assert [r.message for r in tails.tail_logs(logs, "/aws/lambda/a").collect()] == ["old mcdonald"]
    assert tails.tail_logs(logs, condition="message LIKE '%farm%'").columns == ["ts", "message"]
    assert "seen_at" in tails.stamp(logs).columns


def test_shared_folder_is_the_clusters(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark, "x").startswith(base)


def test_logs_of_a_region(spark):
    rows = [(r, f"1:/aws/lambda/{n}", "s", START, n, 1) for r, n in (("eu", "f"), ("us", "f"), ("eu", "g"))]
    logs = spark.createDataFrame(rows, schemas.LOGS)
    assert tails.tail_logs(logs, region="eu").count() == 2
    assert tails.tail_logs(logs, "/aws/lambda/f", region="us").count() == 1
    assert tails.tail_logs(logs, "/aws/lambda/f", "message = 'g'").count() == 0
