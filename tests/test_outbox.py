"""The sink with results per message: requests, refusals, epochs that run twice."""

import os

import pytest
from pyspark.sql import functions as F

from opsloom.sinks import outbox

ENTRIES = "entry_id STRING, body STRING"


def rows(n, prefix="m"):
    return [(f"{prefix}{i}", f"body {i}") for i in range(n)]


def found(spark, path):
    return sorted((r["entry_id"], r["status"], r["error"]) for r in outbox.results(spark, path).collect())


def senders():
    """Local functions travel to the tasks by value, as those of a module that tasks cannot import."""

    def refuse_sevens(batch):
        assert 1 <= len(batch) <= 10
        if any(e["entry_id"] == "m13" for e in batch):
            raise RuntimeError("service is down")
        return {e["entry_id"]: "no sevens" for e in batch if e["entry_id"].endswith("7")}

    def record_requests(batch):
        return {e["entry_id"]: ",".join(x["entry_id"] for x in batch) for e in batch}

    def break_the_task(batch):
        if any(e["entry_id"] == "m3" for e in batch):
            raise SystemExit  # not an error of the service: the task fails
        return {}

    return refuse_sevens, record_requests, break_the_task


refuse_sevens, record_requests, break_the_task = senders()


def test_results_of_a_sender(spark, tmp_path):
    table = spark.createDataFrame(rows(30), ENTRIES).coalesce(1)
    outbox.send(table, str(tmp_path), sender=refuse_sevens)
    got = {e: (s, x) for e, s, x in found(spark, str(tmp_path))}
    assert len(got) == 30
    assert got["m7"] == got["m27"] == ("fail", "no sevens")
    assert {got[f"m{i}"] for i in range(10, 20)} == {("fail", "service is down")}
    assert got["m0"] == ("success", None)
    (line,) = outbox.manifests(spark, str(tmp_path)).collect()
    assert (line["accepted"], line["refused"]) == (18, 12)


def test_requests_hold_what_belongs_together(spark, tmp_path):
    table = spark.createDataFrame([(f"m{i:02d}", "b", f"r{i // 4}") for i in range(10)], f"{ENTRIES}, request STRING").coalesce(1)
    outbox.send(table, str(tmp_path), sender=record_requests, request_size=3)
    assert sorted({e for _, _, e in found(spark, str(tmp_path))}) == ["m00,m01,m02", "m03", "m04,m05,m06", "m07", "m08,m09"]


def test_landing_refuses_by_size_and_appends(spark, tmp_path):
    table = spark.createDataFrame([("a", "é" * 5), ("b", "é" * 4), ("c", None), ("d", "")], ENTRIES)
    outbox.send(table, str(tmp_path), max_bytes=10)
    outbox.send(spark.createDataFrame([("a", "x")], ENTRIES), str(tmp_path), max_bytes=10)
    assert found(spark, str(tmp_path)) == [
        ("a", "fail", "message is too long"), ("a", "success", None), ("b", "success", None), ("c", "success", None), ("d", "success", None),
    ]
    outbox.send(table.limit(0), str(tmp_path))
    assert len(found(spark, str(tmp_path))) == 5
    with pytest.raises(Exception, match="cannot be overwritten"):
        table.write.format(outbox.FORMAT).mode("overwrite").option("path", str(tmp_path)).save()
    with pytest.raises(Exception, match="an entry has body"):
        table.drop("body").write.format(outbox.FORMAT).mode("append").option("path", str(tmp_path)).save()


def test_nothing_sent_is_nothing_found(spark, tmp_path):
    assert found(spark, f"{tmp_path}/none") == []


def test_a_write_that_fails_shows_nothing(spark, tmp_path):
    table = spark.createDataFrame(rows(40), ENTRIES).repartition(4)
    with pytest.raises(Exception):
        outbox.send(table, str(tmp_path), sender=break_the_task)
    assert found(spark, str(tmp_path)) == []


def land(spark, folder, prefix):
    spark.createDataFrame(rows(20, prefix), ENTRIES).repartition(2).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(ENTRIES).option("maxFilesPerTrigger", 1).parquet(folder)


def test_an_epoch_that_runs_twice_shows_once(spark, tmp_path):
    queue, out, checkpoint = f"{tmp_path}/queue", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    land(spark, queue, "a")
    outbox.send_stream(stream(spark, queue), out, checkpoint, sender=refuse_sevens)
    expected = found(spark, out)
    assert len(expected) == 20 and sum(s == "fail" for _, s, _ in expected) == 2
    parts = {p for p in os.listdir(f"{out}/parts") if p.endswith(".parquet")}
    # As after a crash between the sink's commit and that of the query: the last epoch runs again.
    epochs = [int(f) for f in os.listdir(f"{checkpoint}/commits") if f.isdigit()]
    for f in os.listdir(f"{checkpoint}/commits"):
        if f.lstrip(".").startswith(str(max(epochs))):
            os.remove(f"{checkpoint}/commits/{f}")
    outbox.send_stream(stream(spark, queue), out, checkpoint, sender=refuse_sevens)
    assert found(spark, out) == expected
    assert {p for p in os.listdir(f"{out}/parts") if p.endswith(".parquet")} == parts
    # What is new goes on in epochs of its own.
    land(spark, queue, "b")
    outbox.send_stream(stream(spark, queue), out, checkpoint, sender=refuse_sevens)
    assert len(found(spark, out)) == 40
    assert outbox.manifests(spark, out).select("epoch").distinct().count() == 4


def test_another_checkpoint_is_another_stream(spark, tmp_path):
    queue, out = f"{tmp_path}/queue", f"{tmp_path}/out"
    land(spark, queue, "a")
    for name in ("one", "two"):
        outbox.send_stream(stream(spark, queue), out, f"{tmp_path}/{name}")
    assert outbox.results(spark, out).groupBy("entry_id").count().where(F.col("count") != 2).count() == 0


def test_parts_without_a_manifest_are_not_read(spark, tmp_path):
    outbox.send(spark.createDataFrame(rows(3), ENTRIES), str(tmp_path))
    spark.createDataFrame([("x", "b", "success", None)], "entry_id STRING, body STRING, status STRING, error STRING").write.mode(
        "append"
    ).parquet(f"{tmp_path}/parts")
    assert [e for e, _, _ in found(spark, str(tmp_path))] == ["m0", "m1", "m2"]
