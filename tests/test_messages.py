import random

import pytest
from pyspark.sql import functions as F

from opsloom import schemas
from opsloom.operators import messages
from opsloom.operators.packing import pack_batches
from opsloom.sinks import delivery
from opsloom.sources.lines import scan_lines


def greedy(sizes, max_n, max_bytes):
    batch, count, total, out = -1, max_n, 0, []
    for size in sizes:
        if count >= max_n or total + size >= max_bytes:
            batch, count, total = batch + 1, 0, 0
        count, total = count + 1, total + size
        out.append(batch)
    return out


def lines_table(spark, files):
    rows = [(f, i // 7, i, line) for f, lines in files.items() for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "file STRING, block BIGINT, pos BIGINT, line STRING")


@pytest.mark.parametrize("chunk_rows,run", [(10, 2), (13, 3), (20000, 1000)])
def test_packing_equals_one_pass_over_each_file(spark, chunk_rows, run):
    rng = random.Random(chunk_rows)
    make = lambda n: ["é" * rng.choice([1, 2, 5, 30, 60]) for _ in range(n)]
    files = {"hot": make(400), "small": make(3), "eleven": ["x"] * 11, "ten": ["x"] * 10, "one": ["y" * 500]}
    packed = pack_batches(lines_table(spark, files), max_n=10, max_bytes=200, chunk_rows=chunk_rows, chunks_per_run=run)
    got = {}
    for r in packed.orderBy("file", "pos").collect():
        got.setdefault(r.file, []).append(r.batch_id)
    for name, lines in files.items():
        assert got[name] == greedy([len(x.encode()) for x in lines], 10, 200), name
    assert packed.select("entry_id").distinct().count() == sum(len(v) for v in files.values())


def test_sixteen_physical_lines(spark, tmp_path):
    lines = [f"message {i}" for i in range(15)]
    (tmp_path / "in.txt").write_text("\n".join(lines[:7] + [""] + lines[7:]) + "\n\n")
    scanned = scan_lines(spark, str(tmp_path / "in.txt"))
    packed = pack_batches(scanned)
    sizes = sorted(r["count"] for r in packed.groupBy("batch_id").count().collect())
    assert sizes == [5, 10]
    assert sorted(r.line for r in packed.collect()) == sorted(lines)


def test_two_long_lines_do_not_share_a_batch(spark):
    files = {"f": ["a" * 200 * 1024, "b" * 200 * 1024, "c"]}
    rows = pack_batches(lines_table(spark, files)).orderBy("pos").collect()
    assert [r.batch_id for r in rows] == [0, 1, 1]


def test_partial_and_whole_failures_are_reported(spark, tmp_path):
    packed = pack_batches(lines_table(spark, {"f": [f"m{i}" for i in range(25)]}))

    def partly(entries):
        return {e["entry_id"]: "boom!" for e in entries if e["body"] == "m3"}

    results, failures = delivery.to_queue(packed, f"{tmp_path}/partly", partly)
    assert results.count() == 25
    assert [(r.body, r.error) for r in failures.collect()] == [("m3", "boom!")]

    def wholly(entries):
        if any(e["body"] == "m12" for e in entries):
            raise RuntimeError("throttled")
        return {}

    results, failures = delivery.to_queue(packed, f"{tmp_path}/wholly", wholly)
    assert sorted(r.body for r in failures.collect()) == sorted(f"m{i}" for i in range(10, 20))
    assert results.where("status = 'success'").count() == 15


def test_landing_refuses_messages_over_the_limit(spark, tmp_path):
    packed = pack_batches(lines_table(spark, {"f": ["ok", "x" * 300 * 1024]}))
    results, failures = delivery.to_queue(packed, f"{tmp_path}/q")
    assert sorted(r.status for r in results.collect()) == ["fail", "success"]
    assert len(failures.first().body) == 300 * 1024
    landed = spark.read.json(f"{tmp_path}/q/messages")
    assert [e.body for e in landed.first().entries] == ["ok"]


def test_topic_gets_one_publish_per_line(spark, tmp_path):
    (tmp_path / "in.txt").write_text("a\nb\n\nc\nd\ne\n")
    scanned = scan_lines(spark, str(tmp_path / "in.txt"))
    seen = f"{tmp_path}/seen"

    def publish(entries):
        with open(seen, "a") as f:
            f.write(f"{len(entries)}\n")

    results, failures = delivery.to_topic(scanned, f"{tmp_path}/out", publish, concurrency=1)
    assert results.count() == 5 and failures.count() == 0
    assert open(seen).read().split() == ["1"] * 5


@pytest.fixture()
def dlq(spark):
    string = lambda v: ("String", v, None)
    attributes = {"kind": string("k"), "n": ("Number", "1", None), "b": ("Binary", None, bytearray(b"x"))}
    rows = [(f"m{i}", f"r{i}", f"body {i}", attributes, None) for i in (1, 2)]
    return spark.createDataFrame(rows, schemas.MESSAGES)


def test_replay_targets(spark, dlq, tmp_path):
    queue = messages.replay_rows(dlq, "queue").orderBy("message_id").collect()
    assert [r.message_id for r in queue] == ["m1", "m2"]
    assert {k: tuple(v) for k, v in queue[0].attributes.items()} == {"kind": ("String", "k")}
    assert messages.replay_rows(dlq, "topic").columns == ["body", "attributes"]
    stream = messages.replay_rows(dlq, "stream").orderBy("partition_key").first()
    assert tuple(stream) == ("body 1", "m1")
    with pytest.raises(ValueError):
        messages.replay_rows(dlq, "file")
    for target in messages.TARGETS:
        assert delivery.replay(dlq, target, f"{tmp_path}/{target}").count() == 0
        assert spark.read.json(f"{tmp_path}/{target}").count() == 2
        assert delivery.replay(dlq, target, f"{tmp_path}/{target}-k", keep=True).count() == 2


def test_redelivered_messages_are_replayed_once(dlq):
    assert messages.first_deliveries(dlq.unionAll(dlq)).count() == 2


def test_remaining(dlq):
    assert [r.message_id for r in messages.remaining(dlq, dlq.where("message_id = 'm1'")).collect()] == ["m2"]


def test_sent_count_is_printed(spark, tmp_path, capsys):
    delivery.to_queue(pack_batches(lines_table(spark, {"f": ["a", "b"]})), f"{tmp_path}/q", lambda entries: {})
    assert "sent 2 messages" in capsys.readouterr().out
    assert spark.read.parquet(f"{tmp_path}/q/results").select(F.count("*")).first()[0] == 2


@pytest.mark.parametrize("target, most", [("queue", 10), ("topic", 1), ("stream", 10)])
def test_replay_through_a_sender(spark, tmp_path, target, most):
    rows = [(f"m{i}", None, f"b{i}", {"a": ("String", "x", None)}, None) for i in range(25)]
    dlq = spark.createDataFrame(rows, schemas.MESSAGES)

    def sender(entries):
        assert len(entries) <= most
        if any(e["entry_id"] == "m9" for e in entries):
            return {"m9": "boom!"}

    left = delivery.replay(dlq, target, f"{tmp_path}/{target}", sender=sender)
    assert [r.message_id for r in left.collect()] == ["m9"]
    route = delivery.replay_router(target, f"{tmp_path}/{target}-r", sender, replay="one")
    route(dlq, 0)
    route(dlq, 0)
    assert spark.read.json(f"{tmp_path}/{target}-r").where("status = 'success'").count() == 24
