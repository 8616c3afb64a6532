import json
from datetime import datetime

import pytest

from opsloom import schemas
from opsloom.commands import COMMANDS, parser, run
from opsloom.plans import registry, views

FOLDER = "/root/testdata/sf0.001"
AS_OF = ["--as-of", "2024-01-31"]


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """The views written out as landed tables."""
    folder = str(tmp_path_factory.mktemp("tables"))
    ev = views.events(spark, FOLDER)
    points = views.lambda_metrics(ev).unionByName(views.pc_metrics(ev)).unionByName(views.table_metrics(ev))
    points = points.unionByName(views.stream_metrics(ev)).unionByName(views.shard_metrics(ev))
    queues = views.queues(spark, FOLDER)
    stacks, owned = views.stacks(spark, FOLDER)
    functions = views.functions(spark, FOLDER)
    tags = functions.selectExpr("region", "function_name", "'k' AS key", "runtime AS value", "0 AS pos")
    dynamo = views.table_metrics(ev).selectExpr("region", "dims['TableName'] AS table_name").distinct()
    tables = {
        "functions": functions,
        "logs": views.logs(ev).withColumn("ts", ev.ts.cast("timestamp")),
        "metrics": points.selectExpr("region", "namespace", "metric", "dims", "CAST(ts AS TIMESTAMP) AS ts", "value"),
        "pc_configs": views.pc_configs(spark, FOLDER),
        "streams": views.streams(ev),
        "resources": views.resources(spark, FOLDER),
        "versions": views.versions(spark, FOLDER).select("app", "version"),
        "app_stacks": views.app_stacks(spark, FOLDER),
        "measurements": views.measurements(ev),
        "stacks": stacks.selectExpr("region", "CAST(stack AS STRING) AS stack", "CAST(NULL AS STRING) AS status",
                                    "CAST(NULL AS MAP<STRING,STRING>) AS tags", "outputs"),
        "stack_resources": owned.withColumn("stack", owned.stack.cast("string")),
        "function_tags": tags,
        "event_source_mappings": functions.selectExpr("region", "function_name", "'u' AS uuid"),
        "tables": dynamo.selectExpr("region", "table_name", "'ACTIVE' AS table_status"),
        "table_tags": dynamo.selectExpr("region", "table_name", "'k' AS key", "'v' AS value", "0 AS pos"),
        "topics": views.topics(spark, FOLDER),
        "topic_tags": views.topic_tags(spark, FOLDER),
        "subscriptions": views.subscriptions(spark, FOLDER),
        "queues": queues,
        "queue_tags": views.queue_tags(spark, FOLDER),
    }
    for name, table in tables.items():
        table.write.parquet(f"{folder}/{name}")
    return ["--tables", folder]


def test_every_tail_and_report_has_a_command():
    assert len(COMMANDS) == 24
    for name in COMMANDS:
        with pytest.raises(SystemExit):
            parser().parse_args([name, "--help"])


def test_cold_starts(spark, landed):
    table = run(spark, ["analyze-lambda-cold-starts", "-d", "30", *landed, *AS_OF])
    expected = registry.QUERIES["cold_start_report"](spark, FOLDER)
    assert table.count() == expected.count()
    assert table.where("count <> '-'").count() == expected.where("cold_starts > 0").count()
    one = run(spark, ["analyze-lambda-cold-starts", "-d", "30", "-r", "ASIA", "-n", "Customer#000000007", *landed, *AS_OF])
    assert {r.name for r in one.collect()} == {"Customer#000000007"}
    with pytest.raises(ValueError):
        run(spark, ["analyze-lambda-cold-starts", "-n", "x", *landed, *AS_OF])


@pytest.mark.parametrize(
    "argv, rows",
    [
        (["analyze-lambda-cost"], 150),
        (["list-lambda"], 150),
        (["list-lambda", "-i", "-r", "ASIA"], 27),
        (["list-kinesis-streams"], 25),
        (["list-kinesis-shards", "-r", "ASIA", "-n", "click"], 5),
        (["powertune-lambda", "-s", "balanced", "-v", "128,256"], 15),
        (["measure-lambda-cold-starts", "-d", "30"], 30),
        (["list-versions"], 25),
    ],
)
def test_reports(spark, landed, argv, rows):
    assert run(spark, [*argv, *landed, *AS_OF]).count() == rows


def test_plans(spark, landed):
    plan = run(spark, ["clear-account", *landed])
    assert plan.count() == registry.QUERIES["cleanup_plan"](spark, FOLDER).count()
    buckets = run(spark, ["sls-remove", *landed])
    assert buckets.count() == registry.QUERIES["other_buckets"](spark, FOLDER).count()
    assert {r.type for r in run(spark, ["scanner", *landed, *AS_OF]).select("type").distinct().collect()} == {
        "lambda", "dynamodb", "sns", "sqs",
    }


def test_failures_of_attempts(spark, tmp_path):
    rows = [("role", "a", "eu", "fail", "first", 1), ("role", "a", "eu", "fail", "again", 2), ("role", "b", "eu", "fail", "x", 1),
            ("role", "b", "eu", "success", None, 2), ("policy", "p", None, "fail", "held", 1)]
    spark.createDataFrame(rows, schemas.RESULTS).write.parquet(f"{tmp_path}/results")
    found = run(spark, ["clear-account", "--results", f"{tmp_path}/results"]).collect()
    assert [tuple(r) for r in found] == [("policy", "p", "held", 1), ("role", "a [eu]", "again", 1)]


def test_a_scan_goes_on_without_a_table(spark, tmp_path, capsys):
    folder = f"{tmp_path}/tables"
    spark.createDataFrame([("eu", "f"), ("us", "g")], "region STRING, function_name STRING").write.parquet(f"{folder}/functions")
    spark.createDataFrame([("eu", "f", 2)], "region STRING, function_name STRING, retries INT").write.parquet(f"{folder}/invoke_configs")
    spark.createDataFrame([("eu", "t")], "region STRING, topic_arn STRING").write.parquet(f"{folder}/topics")
    found = run(spark, ["scanner", "--tables", folder, "-r", "eu", *AS_OF]).collect()
    documents = {r.type: json.loads(r.document) for r in found}
    assert len(found) == 2 and documents["lambda"]["event_invoke_config"] == {"retries": 2}
    assert documents["sns"]["topic_arn"] == "t"
    said = capsys.readouterr().out
    assert "not read: queues" in said and "not read: policies" in said
    assert run(spark, ["scanner", "--tables", f"{tmp_path}/none", *AS_OF]) is None


def test_messages_go_to_what_a_name_stands_for(spark, tmp_path):
    folder = f"{tmp_path}/tables"
    url = "https://sqs.eu.amazonaws.com/1/"
    queues = [("eu", f"{url}{n}", f"{tmp_path}/{n}") for n in ("dlq", "jobs")] + [("eu", f"{url}lost", None), ("us", f"{url}jobs-2", "/x")]
    spark.createDataFrame(queues, "region STRING, queue_url STRING, landed STRING").write.parquet(f"{folder}/queues")
    spark.createDataFrame([("eu", "arn:1:news", f"{tmp_path}/news")], "region STRING, topic_arn STRING, landed STRING").write.parquet(f"{folder}/topics")
    spark.createDataFrame([("eu", "clicks")], "region STRING, stream_name STRING").write.parquet(f"{folder}/streams")
    rows = [(f"m{i}", None, "b", None, datetime(2024, 1, 1)) for i in (1, 2, 1)]
    spark.createDataFrame(rows, schemas.MESSAGES).write.json(f"{tmp_path}/dlq")
    base = ["replay-sqs-dlq", "--tables", folder, "-n", "dlq", "-r", "eu", "--checkpoint", f"{tmp_path}/c"]
    progress = run(spark, [*base, "--target-name", "jobs"])
    assert [r.messages for r in progress.collect() if r.messages] == [2]
    assert spark.read.json(f"{tmp_path}/jobs").count() == 2
    (tmp_path / "in.txt").write_text("one\n\ntwo\n")
    assert run(spark, ["send-to-sns", "--tables", folder, "-n", "news", "-f", f"{tmp_path}/in.txt"]).count() == 0
    assert spark.read.json(f"{tmp_path}/news/messages").count() == 2
    assert run(spark, ["send-to-sqs", "--tables", folder, "-n", "lost", "-f", f"{tmp_path}/in.txt", "--target", f"{tmp_path}/own"]).count() == 0
    for bad in (["-n", "lost"], ["-n", "none"], ["-n", "job"]):
        with pytest.raises(LookupError):
            run(spark, ["send-to-sqs", "--tables", folder, "-f", f"{tmp_path}/in.txt", *bad])
    with pytest.raises(LookupError):
        run(spark, [*base, "-t", "stream", "--target-name", "clicks"])
    for missing in (["replay-sqs-dlq", "--target", "/x"], ["replay-sqs-dlq", "--stream", "/x"], ["send-to-sns", "-f", "x"]):
        with pytest.raises(ValueError):
            run(spark, missing)


def test_select(spark, tmp_path, capsys):
    for name in ("a", "b"):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.json").write_text(json.dumps([{"id": 1}, {"id": 2}]))
    base = ["s3-select-batch", "-x", f"{tmp_path}/in/", "-f", "JSON"]
    assert run(spark, [*base, "--limit", "1", "--columns", "id"]).count() == 2
    assert "2 objects of together" in capsys.readouterr().out
    assert run(spark, [*base, "--aggs", "count(*) AS n; max(id) AS m"]).collect()[0].n == 2
    assert run(spark, [*base, "-e", "SELECT count(*) AS n FROM s3object", "--dataset"]).first().n == 4
    assert run(spark, [*base, "-e", "select * from s3object limit 1"]).count() == 2
    assert run(spark, [*base, "-o", f"{tmp_path}/out"]) is None
    assert spark.read.json(f"{tmp_path}/out").count() == 4
    assert run(spark, ["s3-select-batch", "-x", f"{tmp_path}/none/", "-f", "CSV"]) is None


def test_messages(spark, tmp_path):
    (tmp_path / "in.txt").write_text("\n".join(f"m{i}" for i in range(15)))
    assert run(spark, ["send-to-sqs", "-f", f"{tmp_path}/in.txt", "--target", f"{tmp_path}/q"]).count() == 0
    assert spark.read.json(f"{tmp_path}/q/messages").count() == 2
    assert run(spark, ["send-to-sns", "-f", f"{tmp_path}/in.txt", "--target", f"{tmp_path}/t"]).count() == 0
    assert spark.read.json(f"{tmp_path}/t/messages").count() == 15
    rows = [(f"m{i}", None, "b", None, datetime(2024, 1, 1)) for i in (1, 2, 1)]
    spark.createDataFrame(rows, schemas.MESSAGES).write.json(f"{tmp_path}/dlq")
    replay = ["replay-sqs-dlq", "--stream", f"{tmp_path}/dlq", "--target", f"{tmp_path}/r", "--checkpoint", f"{tmp_path}/c"]
    run(spark, replay)
    run(spark, replay)
    assert spark.read.json(f"{tmp_path}/r").count() == 2
