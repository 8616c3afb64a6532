from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opsloom import schemas
from opsloom.functions import text
from opsloom.operators import metrics, tuning
from opsloom.sources import tables
from opsloom.sources.metrics import series_to_points

AS_OF = datetime(2024, 1, 31)
RECENT = AS_OF - timedelta(minutes=3)


def points(spark, *rows):
    return spark.createDataFrame([("us-east-1", *r) for r in rows], schemas.METRICS)


@pytest.fixture(scope="module")
def functions(spark):
    rows = [("us-east-1", n, "nodejs10.x", 128, 1024, AS_OF, 6) for n in ("function", "idle")]
    return spark.createDataFrame(rows, schemas.FUNCTIONS)


def test_cost(spark, functions):
    dims = {"FunctionName": "function"}
    table = points(
        spark,
        ("AWS/Lambda", "Invocations", dims, RECENT, 400000.0),
        ("AWS/Lambda", "Invocations", dims, AS_OF - timedelta(days=29), 600000.0),
        ("AWS/Lambda", "Invocations", dims, AS_OF - timedelta(days=31), 5.0),
        ("AWS/Lambda", "Duration", dims, RECENT, 100000000.0),
    )
    rows = metrics.order_cost(metrics.lambda_cost(functions, table, AS_OF)).collect()
    assert [r.function_name for r in rows] == ["function", "idle"]
    assert rows[0].invocation_count == 1000000
    assert rows[0].total_cost == pytest.approx(0.408) and rows[0].average_cost == pytest.approx(0.000000408)
    assert (rows[1].total_cost, rows[1].invocation_count, rows[1].average_cost) == (0.0, 0.0, 0.0)
    shown = metrics.order_cost(metrics.lambda_cost(functions, table, AS_OF)).select(
        text.cost_text(F.col("total_cost")), text.cost_text(F.col("average_cost"))
    )
    assert [tuple(r) for r in shown.collect()] == [("0.4080000000", "0.0000004080"), ("-", "-")]


def test_activity(spark, functions):
    table = points(
        spark,
        ("AWS/Lambda", "Invocations", {"FunctionName": "function"}, datetime(2024, 1, 30, 10, 42), 1.0),
        ("AWS/Lambda", "Invocations", {"FunctionName": "idle"}, datetime(2023, 12, 1), 1.0),
    )
    rows = {r.function_name: r for r in metrics.lambda_activity(functions, table, AS_OF).collect()}
    assert rows["function"].last_used == datetime(2024, 1, 30, 10) and not rows["function"].is_inactive
    assert rows["idle"].is_inactive
    only = metrics.lambda_activity(functions, table, AS_OF, inactive_only=True).collect()
    assert [r.function_name for r in only] == ["idle"]


def test_stream_utilisation_at_half_a_mebibyte(spark):
    streams = spark.createDataFrame(
        [("us-east-1", n, "arn", "ACTIVE", [("shardId-0",)], ["ALL"]) for n in ("stream-a", "quiet")], schemas.STREAMS
    )
    dims = {"StreamName": "stream-a"}
    table = points(
        spark,
        ("AWS/Kinesis", "IncomingBytes", dims, RECENT, 1024.0 * 512 * 60 * 5),
        ("AWS/Kinesis", "IncomingRecords", dims, RECENT, 2.0),
        ("AWS/Kinesis", "GetRecords.Bytes", dims, RECENT, 42.0),
        ("AWS/Kinesis", "GetRecords.Records", dims, RECENT, 2.0),
        ("AWS/Kinesis", "IncomingBytes", dims, AS_OF - timedelta(hours=1), 1e12),
    )
    report = metrics.stream_utilisation(tables.scan_streams(streams), metrics.stream_usage(table, AS_OF))
    rows = {r.stream_name: r for r in report.collect()}
    assert rows["stream-a"].write_mb_pct == 50.0 and rows["stream-a"].shards == 1
    assert rows["quiet"].write_mb_pct == 0.0
    assert report.select(text.percent_text(F.col("write_mb_pct"))).orderBy("stream_name").collect()[1][0] == "50.00"


def test_shards(spark):
    rows = [
        ("us-east-1", "s", "arn", "ACTIVE", [("shardId-1",), ("shardId-2",)], ["ALL"]),
        ("us-east-1", "off", "arn", "ACTIVE", [("shardId-1",)], []),
    ]
    streams = spark.createDataFrame(rows, schemas.STREAMS)
    dims = {"StreamName": "s", "ShardId": "shardId-1"}
    table = points(
        spark,
        ("AWS/Kinesis", "IncomingBytes", dims, RECENT, 42.0),
        ("AWS/Kinesis", "IteratorAgeMilliseconds", dims, RECENT, 60.0),
        ("AWS/Kinesis", "ReadProvisionedThroughputExceeded", dims, RECENT, 1.0),
        ("AWS/Kinesis", "IncomingBytes", {"StreamName": "off", "ShardId": "shardId-1"}, RECENT, 9.0),
    )
    report = metrics.shard_report(tables.scan_shards(streams), metrics.shard_usage(table, AS_OF))
    got = {(r.stream_name, r.shard_id): r for r in report.collect()}
    first = got["s", "shardId-1"]
    assert first.IncomingBytesPerSecond == pytest.approx(0.7) and first.iterator_age_ms == 60.0
    assert first.ReadProvisionedThroughputExceededCount == 1.0
    assert got["s", "shardId-2"].IncomingBytesPerSecond == 0.0
    assert got["off", "shardId-1"].IncomingBytesPerSecond is None
    details = report.select(text.details_json("status", "IncomingBytesPerSecond").alias("d"))
    assert '{"status":"ACTIVE","IncomingBytesPerSecond":0.7}' in [r.d for r in details.collect()]


def test_labelled_values(spark):
    labelled = spark.createDataFrame(
        [("shard-00001:IncomingBytes:Average", 42.0), ("shard-00001:ReadProvisionedThroughputExceeded:Sum", 1.0),
         ("shard-00001:OutgoingBytes:Average", None)], "label STRING, value DOUBLE")
    rows = {r.metric: r.value for r in metrics.renamed_shard_values(labelled).collect()}
    assert rows == {
        "IncomingBytesPerSecond": pytest.approx(0.7),
        "ReadProvisionedThroughputExceededCount": 1.0,
        "OutgoingBytesPerSecond": 0.0,
    }


def test_series_and_newest_value(spark):
    series = spark.createDataFrame(
        [("a", [AS_OF, AS_OF - timedelta(hours=1)], [1.0, 9.0]), ("b", [], [])], schemas.SERIES
    )
    flat = series_to_points(series)
    assert flat.count() == 2
    assert metrics.latest_value(flat, ["label"], "ts").first().value == 1.0


def test_table_capacity(spark):
    dims = {"TableName": "t"}
    day = datetime(2024, 1, 10, 5)
    table = points(
        spark,
        ("AWS/DynamoDB", "ConsumedReadCapacityUnits", dims, day, 3.0),
        ("AWS/DynamoDB", "ConsumedReadCapacityUnits", dims, day + timedelta(hours=2), 4.0),
        ("AWS/DynamoDB", "ProvisionedReadCapacityUnits", dims, day, 10.0),
        ("AWS/DynamoDB", "ProvisionedReadCapacityUnits", dims, day + timedelta(hours=2), 20.0),
    )
    row = metrics.table_capacity(table, AS_OF).first()
    assert (row.day, row.consumed_read, row.provisioned_read) == (datetime(2024, 1, 10), 7.0, 15.0)
    assert row.consumed_write is None


def test_power_selection(spark):
    rows = [("r", "f", 128, 1000.0), ("r", "f", 256, 400.0), ("r", "f", 1024, 390.0), ("r", "f", 1024, 390.0)]
    df = spark.createDataFrame(rows, "region STRING, function_name STRING, memory_mb INT, duration_ms DOUBLE")
    pick = lambda **kw: tuning.power_select(df, **kw).first()
    assert pick(strategy="speed").power == 1024 and pick(strategy="speed").invocations == 2
    assert pick(strategy="cost").power == 256
    assert pick(strategy="balanced").power == 256
    assert pick(strategy="balanced", weight=0.0).power == 1024
    assert pick(strategy="cost", power_values=[128, 1024]).power == 128
    with pytest.raises(ValueError):
        pick(strategy="fast")


def test_text(spark):
    sizes = spark.createDataFrame([(0,), (34,), (1024,), (1023 * 1024,), (5 * 1024**3,)], "n BIGINT")
    assert [r[0] for r in sizes.select(text.human_size(F.col("n"))).collect()] == [
        "0 bytes", "34 bytes", "1.00 KB", "1,023.00 KB", "5.00 GB",
    ]
    ages = [(3, "a few seconds ago"), (50, "a minute ago"), (600, "10 minutes ago"), (3600, "an hour ago"),
            (86400, "a day ago"), (86400 * 40, "a month ago"), (86400 * 200, "7 months ago"), (86400 * 365, "a year ago"),
            (-7200, "in 2 hours")]
    df = spark.createDataFrame([(AS_OF - timedelta(seconds=s),) for s, _ in ages], "t TIMESTAMP")
    got = [r[0] for r in df.select(text.age_text(F.col("t"), F.lit(AS_OF))).collect()]
    assert got == [a for _, a in ages]
    names = spark.createDataFrame([("abc",), ("abcdef",), ("My-Fn_1 x",)], "n STRING")
    assert [r[0] for r in names.select(text.trunc_name(F.col("n"), 3)).collect()] == ["abc", "abc…", "My-…"]
    assert names.select(text.metric_id(F.col("n"))).collect()[2][0] == "myfn_1x"
    values = spark.createDataFrame([(None,), (0.0,), (0.5,), (0.9,)], "v DOUBLE")
    assert [r[0] for r in values.select(text.util_band(F.col("v"))).collect()] == ["-", "-", "good", "warn"]
    assert [r[0] for r in values.select(text.util_text(F.col("v"))).collect()] == ["-", "-", "50%", "90%"]
    init = spark.createDataFrame([(99.9,), (100.0,), (500.0,), (1000.0,), (None,)], "v DOUBLE")
    assert [r[0] for r in init.select(text.init_band(F.col("v"))).collect()] == ["good", "plain", "warn", "bad", "none"]
    arn = spark.createDataFrame([("arn:aws:lambda:us-east-1:123:function:hello:live",)], "a STRING")
    parts = arn.select(text.arn_parts(F.col("a")).alias("p")).first().p
    assert (parts.region, parts.account, parts.qualifier) == ("us-east-1", "123", "live")
    label = arn.select(text.split_label(F.lit("a:b:c")).alias("p")).first().p
    assert tuple(label) == ("a", "b", "c")
    numbers = spark.createDataFrame([("1.5",), ("2fast",)], "v STRING")
    assert [r[0] for r in numbers.select(text.number_or_null(F.col("v"))).collect()] == [1.5, None]
    tags = spark.createDataFrame([([("a", "1"), ("b", "2"), ("a", "3")],)], "t ARRAY<STRUCT<key: STRING, value: STRING>>")
    assert tags.select(text.tags_map(F.col("t"))).first()[0] == {"a": "3", "b": "2"}
