from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import __spark_entry__ as contract
from opsloom import schemas
from opsloom.constants import SCAN_REGIONS
from opsloom.operators import inventory, resolve
from opsloom.operators.versions import latest_version, sorted_versions, version_drift
from opsloom.plans import views
from opsloom.plans.views import SCHEMAS
from opsloom.sources import tables
from opsloom.sources.regions import read_regions, region_paths


def test_one_grain_at_any_number_of_children(spark):
    parents = spark.createDataFrame([("r", "hot", 1), ("r", "small", 2), (None, "none", 3)], "region STRING, name STRING, v INT")
    rows = [("r", "hot", i) for i in range(3000)] + [("r", "small", i) for i in range(3)] + [("r", "orphan", 1)]
    children = spark.createDataFrame([*rows, (None, "none", 5)], "region STRING, name STRING, child INT")
    other = spark.createDataFrame([("r", "hot", "t"), ("r", "hot", "t"), ("x", "hot", "u")], "region STRING, name STRING, b STRING")
    first = spark.createDataFrame([("r", "hot", 8), ("r", "hot", 7), ("r", "gone", 1)], "region STRING, name STRING, n INT")
    got = inventory.nest(parents, ["region", "name"], {"children": children, "others": other}, {"first": first}).collect()
    assert sorted(str((r.region, r.name, r.v, r.first and r.first.n)) for r in got if r.kind == "resource") == sorted(
        str(x) for x in [("r", "hot", 1, 7), ("r", "small", 2, None), (None, "none", 3, None)]
    )
    found = sorted((str(r.region), r.name, r.children.child) for r in got if r.kind == "children")
    assert found == sorted((str(a), b, c) for a, b, c in [*rows, (None, "none", 5)] if b != "orphan")
    assert [(r.name, r.others.b) for r in got if r.kind == "others"] == [("hot", "t")] * 2
    assert all(r.v is None and r.first is None for r in got if r.kind != "resource")
    assert {r.kind for r in inventory.nest(parents, ["region", "name"], {}).collect()} == {"resource"}


def test_queues_and_tags(spark):
    target = '{"deadLetterTargetArn":"arn:dlq","maxReceiveCount":5}'
    queues = spark.createDataFrame(
        [("r", "arn:a", "url/a", target), ("r", "arn:b", "url/b", target), ("r", "arn:dlq", "url/dlq", None)],
        "region STRING, queue_arn STRING, queue_url STRING, redrive_policy STRING",
    )
    tags = spark.createDataFrame(
        [("r", "arn:a", 0, "team", "x"), ("r", "arn:a", 1, "team", "y")],
        "region STRING, queue_arn STRING, pos INT, key STRING, value STRING",
    )
    rows = inventory.inventory_queues(queues, tags)
    got = {r.queue_arn: r.tags for r in rows.where("kind = 'resource'").collect()}
    assert got == {"arn:a": {"team": "y"}, "arn:b": {}, "arn:dlq": {}}
    sources = rows.where("kind = 'source_queues'").collect()
    assert sorted((r.queue_arn, r.source_queues.source_queue_url) for r in sources) == [("arn:dlq", "url/a"), ("arn:dlq", "url/b")]
    report = inventory.inventory_report({"sqs": rows})
    assert report.count() == 5 and report.first().type == "sqs"


def test_functions_and_topics(spark):
    fn = "region STRING, function_name STRING"
    functions = spark.createDataFrame([("r", "f"), ("r", "g")], fn)
    got = inventory.inventory_functions(
        functions,
        spark.createDataFrame([("r", "f", 0, "k", "v")], f"{fn}, pos INT, key STRING, value STRING"),
        spark.createDataFrame([("r", "f", "u1"), ("r", "f", "u2")], f"{fn}, uuid STRING"),
        spark.createDataFrame([("r", "f", "live", 3)], f"{fn}, qualifier STRING, allocated INT"),
        invoke_configs=spark.createDataFrame([("r", "f", 2)], f"{fn}, retries INT"),
        policies=spark.createDataFrame([("r", "g", "{}")], f"{fn}, document STRING"),
    ).collect()
    rows = {r.function_name: r for r in got if r.kind == "resource"}
    assert rows["f"].tags == {"k": "v"} and rows["g"].tags == {}
    assert sorted(r.event_source_mappings.uuid for r in got if r.kind == "event_source_mappings") == ["u1", "u2"]
    assert [tuple(r.provisioned_concurrency_configs) for r in got if r.kind == "provisioned_concurrency_configs"] == [("live", 3)]
    assert rows["f"].event_invoke_config.retries == 2 and rows["f"].policy is None
    assert rows["g"].event_invoke_config is None and rows["g"].policy.document == "{}"
    topic = "region STRING, topic_arn STRING"
    topics = inventory.inventory_topics(
        spark.createDataFrame([("r", "t", {"DisplayName": "x"})], f"{topic}, attributes MAP<STRING,STRING>"),
        spark.createDataFrame([], f"{topic}, pos INT, key STRING, value STRING"),
        spark.createDataFrame([("r", "t", "s2", {"Raw": "1"}), ("r", "t", "s1", {"Raw": "0"})],
                              f"{topic}, subscription STRING, attributes MAP<STRING,STRING>"),
    ).collect()
    children = sorted((r.subscriptions.subscription, r.subscriptions.attributes["Raw"]) for r in topics if r.kind != "resource")
    assert children == [("s1", "0"), ("s2", "1")]
    (one,) = [r for r in topics if r.kind == "resource"]
    assert one.attributes == {"DisplayName": "x"} and one.tags == {}


@pytest.fixture(scope="module")
def resources(spark):
    rows = []

    def add(kind, name, region="us-east-1", **more):
        rows.append((kind, region, name, name, None, more.get("status"), None, more.get("path"), None))

    for region in ("us-east-1", "eu-west-1"):
        add("http_api", "httpApi", region)
        add("rest_api", "restApi", region)
    add("role", "service", path="/aws-service-role/x")
    add("role", "mine", path="/my-roles/")
    add("stack", "MyStack", status="CREATE_COMPLETE")
    add("stack", "going", status="DELETE_IN_PROGRESS")
    add("event_bus", "default")
    add("event_bus", "event1")
    add("policy", "own", status="Local")
    add("policy", "managed", status="AWS")
    add("queue", "untouched")
    return spark.createDataFrame(rows, schemas.RESOURCES)


def test_cleanup_plan(resources):
    plan = inventory.cleanup_plan(resources).orderBy("step", "name").collect()
    assert [(r.step, r.name) for r in plan] == [
        (2, "event1"), (3, "MyStack"), (4, "httpApi"), (4, "httpApi"), (4, "restApi"), (4, "restApi"), (5, "mine"), (9, "own"),
    ]


def test_counts(resources):
    counts = {r.type: r.resources for r in inventory.resource_counts(resources).collect()}
    assert counts["http_api"] + counts["rest_api"] == 4
    rolled = inventory.resource_counts(resources, by_region=True)
    assert rolled.where("type = 'http_api'").count() == 3
    picked = tables.scan_resources(resources, ["http_api"], ["eu-west-1"])
    assert picked.count() == 1


def test_attempts_and_failures(spark):
    rows = [
        ("bucket", "b1", None, "fail", "e1", 1), ("bucket", "b1", None, "fail", "e2", 2), ("bucket", "b1", None, "fail", "e3", 3),
        ("bucket", "b2", None, "fail", "e1", 1), ("bucket", "b2", None, "success", None, 2),
    ]
    results = spark.createDataFrame(rows, schemas.RESULTS)
    last = inventory.last_attempt(results)
    assert {r.name: (r.attempt, r.status) for r in last.collect()} == {"b1": (3, "fail"), "b2": (2, "success")}
    summary = inventory.failure_summary(last, has_region=False).collect()
    assert [tuple(r) for r in summary] == [("bucket", "b1", "e3", 1)]
    regional = results.withColumn("region", F.lit("us-east-1"))
    assert inventory.failure_summary(regional).orderBy("key").first().key == "b1 [us-east-1]"


def test_stack_buckets(spark):
    stacks = spark.createDataFrame(
        [("r", "s", "CREATE_COMPLETE", {}, {"ServerlessDeploymentBucketName": "deploy"}), ("r", "t", "X", {}, {})],
        schemas.STACKS,
    )
    owned = [("r", "s", "AWS::S3::Bucket", "deploy"), ("r", "s", "AWS::S3::Bucket", "data"),
             ("r", "s", "AWS::SNS::Topic", "topic"), ("r", "t", "AWS::S3::Bucket", "foreign")]
    resources = spark.createDataFrame(owned, schemas.STACK_RESOURCES)
    assert [r.bucket for r in tables.other_buckets(stacks, resources).collect()] == ["data"]
    assert tables.stack_resources(stacks, resources, "r", "s").count() == 3


def test_trees_keep_empty_parents(spark):
    buses = spark.createDataFrame([("r", "b1"), ("r", "b2")], "region STRING, bus STRING")
    rules = spark.createDataFrame([("r", "b1", "r1"), ("r", "b1", "r2")], "region STRING, bus STRING, rule STRING")
    targets = spark.createDataFrame([("r", "b1", "r1", "t")], "region STRING, bus STRING, rule STRING, target STRING")
    got = inventory.bus_targets(buses, rules, targets).orderBy("bus", "rule").collect()
    assert [(r.bus, r.rule, r.target) for r in got] == [("b1", "r1", "t"), ("b1", "r2", None), ("b2", None, None)]
    roles = spark.createDataFrame([("a",), ("b",)], "role STRING")
    attached = spark.createDataFrame([("a", "p")], "role STRING, policy STRING")
    got = inventory.role_policies(roles, attached, attached).orderBy("role", "kind").collect()
    assert [(r.role, r.kind) for r in got] == [("a", "attached"), ("a", "inline"), ("b", None)]


def test_resolve(spark):
    queues = spark.createDataFrame([("https://q/1/queue-dev-dlq",), ("https://q/1/queue-dev",)], "queue_url STRING")
    assert resolve.resolve_queue(queues, "queue-dev") == "https://q/1/queue-dev"
    topics = spark.createDataFrame([("arn:aws:sns:r:1:my-topic",)], "topic_arn STRING")
    assert resolve.resolve_topic(topics, "my-topic").endswith(":my-topic")
    with pytest.raises(LookupError):
        resolve.resolve_topic(topics, "topic")
    groups = spark.createDataFrame([("/aws/lambda/function-a",), ("/aws/lambda/function-b",)], "log_group STRING")
    assert resolve.resolve_group(groups, "/aws/lambda/function-a") == "/aws/lambda/function-a"
    with pytest.raises(LookupError, match="function-a, .*function-b"):
        resolve.resolve_group(groups, "/aws/lambda/")
    with pytest.raises(LookupError, match="more than 1 "):
        resolve.resolve_group(groups, "/aws/lambda/", shown=1)
    with pytest.raises(LookupError, match="no log group"):
        resolve.resolve_group(groups, "/x")
    rules = spark.createDataFrame([("a", "ENABLED"), ("b", "DISABLED")], "rule STRING, state STRING")
    assert [r.rule for r in resolve.disabled_rules(rules).collect()] == ["b"]


def test_versions(spark):
    versions = [("app", v) for v in ("0.0.1", "0.1.0", "1.0.0", "1.0.1")]
    versions += [("ten", v) for v in ("1.9.0", "1.10.0", "1.10.0-rc.1")]
    versions += [("pre", v) for v in ("1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-2", "1.0.0-10")]
    df = spark.createDataFrame(versions, schemas.VERSIONS)
    latest = {r.app: r.latest_version for r in latest_version(df).collect()}
    assert latest == {"app": "1.0.1", "ten": "1.10.0", "pre": "1.0.0-alpha.beta"}
    order = [r.version for r in sorted_versions(df.where("app = 'pre'")).collect()]
    assert order == ["1.0.0-alpha.beta", "1.0.0-alpha.1", "1.0.0-alpha", "1.0.0-10", "1.0.0-2"]
    bad = spark.createDataFrame([("app", "latest"), ("app", "1.0.0")], schemas.VERSIONS)
    with pytest.raises(PySparkException, match="not a semantic version"):
        latest_version(bad).collect()
    assert latest_version(bad, on_invalid="skip").first().latest_version == "1.0.0"


def test_drift(spark):
    latest = spark.createDataFrame([(a, "1.0.1") for a in ("new", "old", "gone", "odd")], "app STRING, latest_version STRING")
    tag = "serverlessrepo:semanticVersion"
    stacks = spark.createDataFrame(
        [("new", {tag: "1.0.1"}, {"StateMachineARN": "arn"}), ("old", {tag: "1.0.0"}, {}), ("odd", {}, {})],
        "app STRING, tags MAP<STRING,STRING>, outputs MAP<STRING,STRING>",
    )
    got = {r.app: (r.status, r.state_machine_arn) for r in version_drift(latest, stacks).collect()}
    assert got == {"new": ("active", "arn"), "old": ("outdated", None), "gone": ("not found", None), "odd": ("not found", None)}


def test_failed_region_is_reported(spark, tmp_path):
    spark.createDataFrame([("f",)], "function_name STRING").write.parquet(str(tmp_path / "a"))
    table, errors = read_regions(
        spark, {"us-east-1": f"{tmp_path}/a", "eu-west-1": f"{tmp_path}/none"}, "function_name STRING"
    )
    assert [(r.region, r.function_name) for r in table.collect()] == [("us-east-1", "f")]
    assert [r.region for r in errors.collect()] == ["eu-west-1"]
    assert region_paths("/t", SCAN_REGIONS)["us-east-1"] == "/t/region=us-east-1" and len(region_paths("/t")) == 16
    with pytest.raises(PySparkException):
        read_regions(spark, {"x": f"{tmp_path}/none"}, "function_name STRING", on_error="fail")


def test_recent_streams(spark):
    rows = [("r", "g", f"s{i}", f"2024-01-01 00:00:{i:02d}") for i in range(8)]
    logs = spark.createDataFrame(rows, "region STRING, log STRING, log_stream STRING, t STRING")
    df = inventory.recent_log_streams(logs.withColumn("ts", F.col("t").cast("timestamp")), 3)
    assert [r.log_stream for r in df.orderBy("position").collect()] == ["s7", "s6", "s5"]
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()


def test_recent_streams_of_a_silent_group(spark, tmp_path):
    for name, rows in {
        "region": [(i, f"R{i}") for i in range(5)],
        "events": [(i, datetime(2024, 1, day), user, "view", 1.0, "{}") for i, (user, day) in enumerate([(1, 2), (1, 3), (2, 20)])],
    }.items():
        spark.createDataFrame(rows, SCHEMAS[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    got = contract.queries()["recent_log_streams"](spark, str(tmp_path)).collect()
    assert sorted((r.region, r.log_stream, r.position) for r in got) == [("R1", "stream-0", 2), ("R1", "stream-1", 1), ("R2", "stream-2", 1)]
    logs = views.logs(views.events(spark, str(tmp_path)))
    assert [r.log_stream for r in inventory.recent_log_streams(logs, 50, "2024-01-08").collect()] == ["stream-2"]


def test_queues_have_the_totals_of_their_sources(spark):
    target = '{"deadLetterTargetArn":"arn:dlq"}'
    rows = [("r", "arn:a", "url/a", target), ("r", "arn:b", "url/bb", target), ("r", "arn:dlq", "url/dlq", None)]
    odd = [(None, "arn:c", "url/c", target), (None, "arn:dlq", "url/d", None), ("r", "arn:e", "url/e", '{"deadLetterTargetArn":"arn:gone"}')]
    queues = spark.createDataFrame([*rows, *odd], "region STRING, queue_arn STRING, queue_url STRING, redrive_policy STRING")
    tags = spark.createDataFrame([], "region STRING, queue_arn STRING, pos INT, key STRING, value STRING")
    got = inventory.inventory_queues(queues, tags).collect()
    totals = {(r.region, r.queue_arn): tuple(r.source_totals) for r in got if r.source_totals}
    assert totals == {("r", "arn:dlq"): (2, 11), (None, "arn:dlq"): (1, 5)}
    assert sorted(r.kind for r in got) == ["resource"] * 6 + ["source_queues"] * 3
