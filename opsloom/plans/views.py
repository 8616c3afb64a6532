"""The operators' input tables as views over the given tables.

Each row of a given table becomes a row of a view; nothing is sampled. The only join is
with ``region``, which has five rows at every scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.functions.payload import gzip_bytes
from opsloom.session import shared_dir, use_utc
from opsloom.sources.tables import union_resources

AS_OF = "2024-01-31 00:00:00"

# Known schemas spare the job that would read them from the files.
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": (
        "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"
    ),
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": (
        "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE"
    ),
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
        "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
        "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
        "l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"
    ),
    "events": (
        "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
    ),
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return use_utc(spark).read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def in_region(df: DataFrame, spark: SparkSession, folder: str, key: str) -> DataFrame:
    regions = table(spark, folder, "region").select("r_regionkey", F.col("r_name").alias("region"))
    return df.join(regions, (F.col(key) % 5).cast("int") == F.col("r_regionkey")).drop("r_regionkey")


def function_name(key: str) -> Column:
    return F.format_string("Customer#%09d", F.col(key))


def text(*parts: Column | str) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def functions(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    return in_region(table(spark, folder, "customer"), spark, folder, "c_custkey").select(
        "region",
        F.col("c_name").alias("function_name"),
        F.col("c_mktsegment").alias("runtime"),
        (128 * (1 + key % 8)).cast("int").alias("memory_size"),
        F.round(F.abs("c_acctbal") * 1024).cast("bigint").alias("code_size"),
        F.timestamp_seconds(1672531200 + key * 3600).alias("last_modified"),
        (3 + key % 897).cast("int").alias("timeout"),
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with region and function name."""
    rows = in_region(table(spark, folder, "events"), spark, folder, "user_id")
    return rows.withColumn("function_name", function_name("user_id"))


#: Turns in which the events of a stream land, and files of each.
TURNS, FILES = 4, 2


def event_stream(spark: SparkSession, folder: str, in_time: bool = False) -> DataFrame:
    """The events as a stream, with times as instants, that lands in turns; a turn is a micro-batch.

    The turns hold events of all times, or with ``in_time`` those of one stretch of days after the other.
    """
    rows = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    landed = shared_dir(spark, "events")
    turn = F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(TURNS - 1)) if in_time else F.pmod(F.xxhash64("event_id"), F.lit(TURNS))
    for n in range(TURNS):
        rows.where(turn == n).repartition(FILES).write.mode("append").parquet(landed)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES).parquet(landed)
    stream = stream.withColumn("landed_at", F.col("_metadata.file_modification_time"))
    return in_region(stream, spark, folder, "user_id").withColumn("function_name", function_name("user_id"))


def logs(ev: DataFrame) -> DataFrame:
    """One line per event: signups report an init duration, errors report it in lower case."""
    memory = 128 * (1 + (F.col("user_id") + F.col("event_id") % 2) % 8)
    report = text(
        "REPORT RequestId: ", F.col("event_id"), " Duration: ", F.col("event_id") % 1000,
        " ms Billed Duration: ", F.col("event_id") % 1000, " ms Memory Size: ", memory,
        " MB Max Memory Used: 64 MB",
    )
    init = (
        F.when(F.col("event_type") == "signup", text(" Init Duration: ", F.col("value"), " ms"))
        .when(F.col("event_type") == "error", text(" init duration: ", F.col("value"), " ms"))
        .otherwise("")
    )
    return ev.select(
        "region",
        text("1234567890:/aws/lambda/", F.col("function_name")).alias("log"),
        text("stream-", F.col("event_id") % 9973).alias("log_stream"),
        "ts",
        F.concat(report, init).alias("message"),
        (memory * 1000000).alias("memory_bytes"),
    )


def _points(ev: DataFrame, namespace: str, dims: dict[str, Column], values: dict[str, Column]) -> DataFrame:
    """Datapoints of several metrics per event, in one pass over the events."""
    pairs = [F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in values.items()]
    dim_map = F.create_map(*[x for k, v in dims.items() for x in (F.lit(k), v)])
    named = ev.select("region", "ts", dim_map.alias("dims"), F.inline(F.array(*pairs)))
    return named.select("region", F.lit(namespace).alias("namespace"), "metric", "dims", "ts", "value")


def lambda_metrics(ev: DataFrame, *names: str) -> DataFrame:
    """Invocations and durations per function: the named metrics, or both."""
    values = {"Invocations": F.lit(1), "Duration": F.col("value")}
    return _points(
        ev,
        "AWS/Lambda",
        {"FunctionName": F.col("function_name")},
        {name: values[name] for name in names or values},
    )


def pc_metrics(ev: DataFrame) -> DataFrame:
    """Utilisation per function and qualifier."""
    name = F.col("function_name")
    return _points(
        ev,
        "AWS/Lambda",
        {"FunctionName": name, "Resource": text(name, ":alias-", F.col("event_id") % 4)},
        {"ProvisionedConcurrencyUtilization": F.col("value") / 500},
    )


def pc_configs(spark: SparkSession, folder: str) -> DataFrame:
    orders = in_region(table(spark, folder, "orders"), spark, folder, "o_custkey")
    name = function_name("o_custkey")
    return orders.select(
        "region",
        name.alias("function_name"),
        text(
            "arn:aws:lambda:", F.col("region"), ":1234567890:function:", name, ":alias-", F.col("o_orderkey") % 6
        ).alias("function_arn"),
        (1 + F.col("o_orderkey") % 50).cast("bigint").alias("allocated"),
    )


def streams(ev: DataFrame) -> DataFrame:
    """A stream per region and event type; streams of views have no shard metrics."""
    count = 1 + 2 * (F.length("event_type") % 3)
    shard = lambda i: F.struct(text("shardId-00000000000", i).alias("shard_id"))
    monitored = F.when(F.col("event_type") == "view", F.array().cast("array<string>")).otherwise(
        F.array(F.lit("ALL"))
    )
    return ev.select("region", "event_type").distinct().select(
        "region",
        F.col("event_type").alias("stream_name"),
        text("arn:aws:kinesis:", F.col("region"), ":1234567890:stream/", F.col("event_type")).alias("arn"),
        F.lit("ACTIVE").alias("status"),
        F.transform(F.sequence(F.lit(0), count - 1), shard).alias("shards"),
        monitored.alias("shard_level_metrics"),
    )


def stream_metrics(ev: DataFrame) -> DataFrame:
    size, value = F.length("props"), F.col("value")
    return _points(
        ev,
        "AWS/Kinesis",
        {"StreamName": F.col("event_type")},
        {
            "IncomingBytes": size * 10000000.0,
            "IncomingRecords": value * 1000,
            "GetRecords.Bytes": size * 20000000.0,
            "GetRecords.Records": value * 2000,
        },
    )


def shard_metrics(ev: DataFrame) -> DataFrame:
    value = F.col("value")
    return _points(
        ev,
        "AWS/Kinesis",
        {"StreamName": F.col("event_type"), "ShardId": text("shardId-00000000000", F.col("event_id") % 5)},
        {
            "IncomingBytes": value,
            "IncomingRecords": value / 2,
            "OutgoingRecords": value * 2,
            "OutgoingBytes": value * 3,
            "ReadProvisionedThroughputExceeded": F.when(value > 50, 1).otherwise(0),
            "WriteProvisionedThroughputExceeded": F.when(value > 100, 1).otherwise(0),
            "IteratorAgeMilliseconds": value * 10,
        },
    )


def table_metrics(ev: DataFrame) -> DataFrame:
    return _points(
        ev,
        "AWS/DynamoDB",
        {"TableName": text("table-", F.col("user_id") % 10)},
        {
            "ConsumedReadCapacityUnits": F.col("value"),
            "ConsumedWriteCapacityUnits": F.col("value") / 2,
            "ProvisionedReadCapacityUnits": 5 + F.col("user_id") % 3,
            "ProvisionedWriteCapacityUnits": F.lit(5),
        },
    )


def messages(ev: DataFrame) -> DataFrame:
    """A message per event, in the dead-letter queue of its event type."""

    def attribute(kind: str, string: Column, binary: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("data_type"),
            string.cast("string").alias("string_value"),
            binary.cast("binary").alias("binary_value"),
        )

    none = F.lit(None)
    return ev.select(
        text("msg-", F.col("event_id")).alias("message_id"),
        text("receipt-", F.col("event_id")).alias("receipt_handle"),
        F.to_json(F.struct("event_id", "user_id", "event_type", "value")).alias("body"),
        F.create_map(
            F.lit("event_type"), attribute("String", F.col("event_type"), none),
            F.lit("user_id"), attribute("Number", F.col("user_id"), none),
            F.lit("raw"), attribute("Binary", none, F.col("props")),
        ).alias("attributes"),
        (F.col("landed_at") if "landed_at" in ev.columns else F.col("ts")).alias("received_at"),
        F.concat("event_type", F.lit("-dlq")).alias("queue"),
    )


def deliveries(ev: DataFrame) -> DataFrame:
    """Messages of all events; those of errors are delivered twice."""
    times = F.when(F.col("event_type") == "error", 2).otherwise(1)
    twice = ev.withColumn("_n", F.explode(F.sequence(F.lit(1), times))).drop("_n")
    return messages(twice)


def topic_messages(ev: DataFrame) -> DataFrame:
    body = F.to_json(
        F.struct(
            F.col("event_type").alias("Subject"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("Timestamp"),
            F.col("props").alias("Message"),
            F.create_map(
                F.lit("user"),
                F.struct(F.lit("String").alias("Type"), F.col("user_id").cast("string").alias("Value")),
            ).alias("MessageAttributes"),
        )
    )
    return ev.select("event_id", body.alias("body"))


def event_messages(ev: DataFrame) -> DataFrame:
    body = text(
        '{"region":"', F.col("region"), '","source":"', F.col("event_type"), '","time":"',
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), '","resources":["', F.col("function_name"),
        '"],"detail-type":"', F.when(F.col("value") > 50, "large").otherwise("small"), '","detail":',
        F.col("props"), "}",
    )
    return ev.select("event_id", body.alias("body"))


def change_messages(ev: DataFrame) -> DataFrame:
    def tagged(tag: str, value: Column) -> Column:
        return F.create_map(F.lit(tag), value.cast("string"))

    image = F.create_map(
        F.lit("user"), tagged("N", F.col("user_id")), F.lit("kind"), tagged("S", F.col("event_type"))
    )
    body = F.to_json(
        F.struct(
            text("change-", F.col("event_id")).alias("eventID"),
            F.when(F.col("event_type") == "signup", "INSERT").otherwise("MODIFY").alias("eventName"),
            F.lit("aws:dynamodb").alias("eventSource"),
            F.struct(
                F.create_map(F.lit("id"), tagged("S", F.col("event_id"))).alias("Keys"),
                image.alias("NewImage"),
                text("49590338271490256608559692538361", F.col("event_id")).alias("SequenceNumber"),
                F.length("props").cast("bigint").alias("SizeBytes"),
                F.lit("NEW_IMAGE").alias("StreamViewType"),
            ).alias("dynamodb"),
        )
    )
    return ev.select("event_id", body.alias("body"))


def stream_records(ev: DataFrame) -> DataFrame:
    """Views and clicks are zipped JSON, purchases plain JSON, the others plain text."""
    plain = (
        F.when(F.col("event_type").isin("view", "click", "purchase"), F.col("props"))
        .otherwise(text("message ", F.col("event_id")))
        .cast("binary")
    )
    zipped = F.when(F.col("event_type").isin("view", "click"), plain)
    return ev.select(
        "event_id",
        text("shardId-00000000000", F.col("event_id") % 5).alias("shard_id"),
        F.lpad(F.col("event_id").cast("string"), 20, "0").alias("sequence_number"),
        F.base64(F.coalesce(gzip_bytes(zipped), plain)).alias("data"),
    )


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as the records of objects: a source is an object."""
    return table(spark, folder, "documents").withColumnRenamed("source", "object")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of all documents, a source being a file. Every document ends with a blank line."""
    split = F.split(F.concat("text", F.lit("\n")), "\n")
    return (
        table(spark, folder, "documents")
        .select(F.col("source").alias("file"), "doc_id", F.posexplode(split).alias("line_no", "line"))
        .where(F.length("line") > 0)
        .select("file", F.floor(F.col("doc_id") / 1000).alias("block"), "doc_id", "line_no", "line")
    )


LINE_ORDER = ["doc_id", "line_no"]


def resources(spark: SparkSession, folder: str) -> DataFrame:
    """Account resources of all types; their states and paths follow from the given columns."""
    customer, supplier, part = (table(spark, folder, t) for t in ("customer", "supplier", "part"))
    orders, nation = table(spark, folder, "orders"), table(spark, folder, "nation")

    def kind(df: DataFrame, key: str, prefix: str, place: str | None = None, **more: Column) -> DataFrame:
        """``place`` is the column that gives the region; without it a resource is global."""
        columns = {"id": F.col(key), "name": text(f"{prefix}-", F.col(key)), **more}
        if place:
            columns["region"] = F.col(place) % 5
        return df.select(*[c.alias(n) for n, c in columns.items()])

    status = (
        F.when(F.col("o_orderstatus") == "F", "CREATE_COMPLETE")
        .when(F.col("o_orderstatus") == "O", "UPDATE_COMPLETE")
        .otherwise("DELETE_IN_PROGRESS")
    )
    bus = F.when(F.col("c_mktsegment") == "BUILDING", "default").otherwise(text("bus-", F.col("c_custkey")))
    path = F.when(F.col("s_nationkey") < 5, "/aws-service-role/x/").otherwise("/my-roles/")
    local = F.when(F.col("p_size") < 25, "Local").otherwise("AWS")
    group = text("/aws/lambda/", F.col("c_name"))
    stored = F.round(F.abs("c_acctbal"))
    vpc = text("vpc-", F.col("s_nationkey"))
    united = union_resources(
        {
            "bucket": kind(part, "p_partkey", "bucket"),
            "event_bus": kind(customer, "c_custkey", "bus", "c_custkey", name=bus),
            "stack": kind(orders, "o_orderkey", "stack", "o_custkey", status=status),
            "http_api": kind(supplier, "s_suppkey", "http", "s_suppkey"),
            "rest_api": kind(nation, "n_nationkey", "rest", "n_nationkey"),
            "role": kind(supplier, "s_suppkey", "role", "s_suppkey", path=path),
            "function": kind(customer, "c_custkey", "fn", "c_custkey", name=F.col("c_name")),
            "log_group": kind(customer, "c_custkey", "log", "c_custkey", name=group, bytes=stored),
            "nat_gateway": kind(supplier, "s_suppkey", "nat", "s_suppkey", parent=vpc),
            "policy": kind(part, "p_partkey", "policy", status=local),
        }
    )
    names = table(spark, folder, "region").select(F.col("r_regionkey").cast("string"), F.col("r_name"))
    located = united.join(names, F.col("region") == F.col("r_regionkey"), "left")
    return located.withColumn("region", F.col("r_name")).drop("r_regionkey", "r_name")


def results(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes of clearing attempts: an order is an attempt on its customer's resource."""
    orders = in_region(table(spark, folder, "orders"), spark, folder, "o_custkey")
    failed = F.col("o_orderstatus") == "F"
    return orders.select(
        F.col("o_orderpriority").alias("type"),
        text("res-", F.col("o_custkey")).alias("name"),
        "region",
        F.when(failed, "fail").when(F.col("o_orderstatus") == "O", "success").otherwise("skip").alias("status"),
        F.when(failed, text("error ", F.col("o_orderkey"))).alias("reason"),
        F.col("o_orderkey").alias("attempt"),
    )


def versions(spark: SparkSession, folder: str) -> DataFrame:
    pre = F.when(F.col("p_type") == "ECONOMY", text("-beta.", F.col("p_size"))).otherwise("")
    size, key = F.col("p_size"), F.col("p_partkey")
    return table(spark, folder, "part").select(
        F.col("p_brand").alias("app"),
        text(size % 5, ".", size % 13, ".", key % 17, pre).alias("version"),
        "p_partkey",
        "p_type",
    )


def log_groups(spark: SparkSession, folder: str) -> DataFrame:
    """An inventory of log groups: the functions have one but for every seventh."""
    customer = in_region(table(spark, folder, "customer"), spark, folder, "c_custkey").where(F.col("c_custkey") % 7 != 3)
    return customer.select("region", F.lit("log_group").alias("type"), text("/aws/lambda/", F.col("c_name")).alias("name"))


def app_stacks(spark: SparkSession, folder: str) -> DataFrame:
    """The first version of a brand is deployed, unless its first part is of the economy type."""
    first = versions(spark, folder).groupBy("app").agg(
        F.min_by(F.struct("version", "p_type"), "p_partkey").alias("f")
    )
    return first.where(F.col("f.p_type") != "ECONOMY").select(
        "app",
        F.create_map(F.lit("serverlessrepo:semanticVersion"), F.col("f.version")).alias("tags"),
        F.create_map(
            F.lit("StateMachineARN"), text("arn:aws:states:us-east-1:1:stateMachine:", F.col("app"))
        ).alias("outputs"),
    )


def measurements(ev: DataFrame) -> DataFrame:
    return ev.select(
        "region",
        "function_name",
        (128 * (1 + F.col("event_id") % 4)).cast("int").alias("memory_mb"),
        F.round(F.col("value") * 20).alias("duration_ms"),
    )


def queues(spark: SparkSession, folder: str) -> DataFrame:
    """A queue per part, with the queue of its brand as dead-letter target, and those queues."""
    part = table(spark, folder, "part")
    arn = "arn:aws:sqs:us-east-1:1234567890:"
    url = "https://sqs.us-east-1.amazonaws.com/1234567890/"
    main = part.select(
        F.lit("us-east-1").alias("region"),
        text(arn, "queue-", F.col("p_partkey")).alias("queue_arn"),
        text(url, "queue-", F.col("p_partkey")).alias("queue_url"),
        text('{"deadLetterTargetArn":"', arn, "dlq-", F.col("p_brand"), '","maxReceiveCount":5}').alias(
            "redrive_policy"
        ),
    )
    dead = part.select("p_brand").distinct().select(
        F.lit("us-east-1").alias("region"),
        text(arn, "dlq-", F.col("p_brand")).alias("queue_arn"),
        text(url, "dlq-", F.col("p_brand")).alias("queue_url"),
        F.lit(None).cast("string").alias("redrive_policy"),
    )
    return main.unionByName(dead)


def queue_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Two tags of a queue have the same key; the later one counts."""
    part = table(spark, folder, "part")
    tags = F.array(
        F.struct(F.lit(0).alias("pos"), F.lit("team").alias("key"), F.col("p_type").alias("value")),
        F.struct(F.lit(1).alias("pos"), F.lit("team").alias("key"), F.col("p_brand").alias("value")),
        F.struct(F.lit(2).alias("pos"), F.lit("stage").alias("key"), F.lit("dev").alias("value")),
    )
    return part.select(
        F.lit("us-east-1").alias("region"),
        text("arn:aws:sqs:us-east-1:1234567890:queue-", F.col("p_partkey")).alias("queue_arn"),
        F.inline(tags),
    )


def topics(spark: SparkSession, folder: str) -> DataFrame:
    customer = in_region(table(spark, folder, "customer"), spark, folder, "c_custkey")
    return customer.select(
        "region",
        text("arn:aws:sns:topic-", F.col("c_custkey")).alias("topic_arn"),
        F.col("c_mktsegment").alias("owner"),
    )


def topic_tags(spark: SparkSession, folder: str) -> DataFrame:
    customer = in_region(table(spark, folder, "customer"), spark, folder, "c_custkey")
    return customer.select(
        "region",
        text("arn:aws:sns:topic-", F.col("c_custkey")).alias("topic_arn"),
        F.lit("segment").alias("key"),
        F.col("c_mktsegment").alias("value"),
        F.lit(0).alias("pos"),
    )


def subscriptions(spark: SparkSession, folder: str) -> DataFrame:
    orders = in_region(table(spark, folder, "orders"), spark, folder, "o_custkey")
    return orders.select(
        "region",
        text("arn:aws:sns:topic-", F.col("o_custkey")).alias("topic_arn"),
        F.col("o_orderkey").alias("subscription_id"),
        F.col("o_orderpriority").alias("protocol"),
    )


def buses(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers as buses, their orders as rules, the suppliers of an order as targets."""
    customer = in_region(table(spark, folder, "customer"), spark, folder, "c_custkey")
    orders = in_region(table(spark, folder, "orders"), spark, folder, "o_custkey")
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    rules = orders.select(
        "region", F.col("o_custkey").alias("bus"), F.col("o_orderkey").alias("rule"), "o_orderstatus"
    )
    targets = items.join(rules, F.col("l_orderkey") == F.col("rule")).select(
        "region", "bus", "rule", text(F.col("l_suppkey"), "/", F.col("l_linenumber")).alias("target")
    )
    return customer.select("region", F.col("c_custkey").alias("bus")), rules, targets


def roles(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Suppliers as roles; parts they had returned are attached policies, the others inline ones."""
    supplier = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("role"))
    used = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("role"), F.col("l_partkey").alias("policy"), "l_returnflag"
    )
    attached = used.where(F.col("l_returnflag") == "R").select("role", "policy").distinct()
    inline = used.where(F.col("l_returnflag") != "R").select("role", "policy").distinct()
    return supplier, attached, inline


def stacks(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """A stack per customer: its orders are its resources, the first one the deployment bucket."""
    orders = in_region(table(spark, folder, "orders"), spark, folder, "o_custkey")
    kind = F.when(F.col("o_orderstatus") == "P", "AWS::Lambda::Function").otherwise("AWS::S3::Bucket")
    resources = orders.select(
        "region",
        F.col("o_custkey").alias("stack"),
        kind.alias("resource_type"),
        text("res-", F.col("o_orderkey")).alias("physical_id"),
    )
    owners = orders.groupBy("region", F.col("o_custkey").alias("stack")).agg(F.min("o_orderkey").alias("first"))
    outputs = F.create_map(F.lit("ServerlessDeploymentBucketName"), text("res-", F.col("first")))
    return owners.select("region", "stack", outputs.alias("outputs")), resources
