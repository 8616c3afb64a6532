"""The registered queries: every operator over the views of the given tables.

Doubles are rounded and times printed, so that results compare as values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.constants import STREAM_METRICS
from opsloom.functions import envelopes, text
from opsloom.operators import cold_starts, inventory, messages, metrics, objects, packing, resolve, tuning
from opsloom.operators import versions as version_ops
from opsloom.plans import landing, views
from opsloom.plans.views import AS_OF
from opsloom.session import shared_dir, shuffles_dropped
from opsloom.sinks import delivery, outbox, writers
from opsloom.sources import files, filters, shards, tables
from opsloom.sources.lines import scan_lines
from opsloom.sources.logs import group_names, listed_groups, missing_groups, scan_logs
from opsloom.sources.metrics import scan_metrics
from opsloom.sources.objects import object_totals as totals_of
from opsloom.sources.regions import read_regions
from opsloom.streaming import remembered, rollups, runner, tails

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
START = "2024-01-01 00:00:00"
MONTH = 30 * 24 * 60
REGION = "ASIA"
FUNCTION = "Customer#000000007"
FUNCTION_REGION = "ASIA"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """Rounds double columns and prints times."""

    def shown(name: str, kind: str) -> Column:
        if kind == "double":
            return F.round(name, other.get(name, digits)).alias(name)
        if kind.startswith("timestamp"):
            return text.time_text(F.col(name)).alias(name)
        return F.col(name)

    return df.select(*[shown(name, kind) for name, kind in df.dtypes])


def padded(number: Column, width: int) -> Column:
    """A number with leading zeros; one that is longer stays whole."""
    return F.when(F.length(number) < width, F.lpad(number, width, "0")).otherwise(number)


def pairs(column: str) -> Column:
    """A map of plain values as text ordered by key."""
    entries = F.array_sort(F.map_entries(column))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def attribute_text(column: str) -> Column:
    entries = F.array_sort(F.map_entries(column))
    shown = lambda e: F.concat(
        e["key"], F.lit("="), e["value"]["data_type"], F.lit(":"), e["value"]["string_value"]
    )
    return F.array_join(F.transform(entries, shown), ",")


def attribute_kinds(column: str) -> Column:
    shown = F.transform(F.map_entries(column), lambda e: F.concat_ws("=", e["key"], e["value"]["data_type"]))
    return F.array_join(F.array_sort(shown), ",")


def month_logs(spark: SparkSession, folder: str) -> DataFrame:
    return filters.lookback(views.logs(views.events(spark, folder)), AS_OF, days=30)


# --- cold starts


@query
def cold_start_stats(spark, folder):
    return rounded(cold_starts.cold_start_stats(month_logs(spark, folder)))


def _report(spark: SparkSession, folder: str, region: str | None = None, name: str | None = None) -> DataFrame:
    ev = filters.scope(views.events(spark, folder), region, name)
    logs = filters.lookback(views.logs(ev), AS_OF, days=30)
    functions = tables.scan_functions(views.functions(spark, folder), region, name)
    configs = tables.scan_pc_configs(views.pc_configs(spark, folder), region, name)
    used = cold_starts.qualifier_utilisation(views.pc_metrics(ev), AS_OF, MONTH)
    pc = cold_starts.pc_report(configs, used)
    report = cold_starts.cold_start_report(functions, cold_starts.cold_start_stats(logs), pc)
    counted = report.withColumn("cold_starts", F.col("cold_starts").cast("double"))
    return cold_starts.order_report(rounded(counted))


@query
def cold_start_report(spark, folder):
    return _report(spark, folder)


@query
def cold_start_report_one_region(spark, folder):
    return _report(spark, folder, REGION)


@query
def cold_start_single_function(spark, folder):
    return _report(spark, folder, FUNCTION_REGION, FUNCTION)


@query
def cold_start_total(spark, folder):
    return rounded(cold_starts.cold_start_total(month_logs(spark, folder)))


@query
def missing_log_groups(spark, folder):
    """Functions without a log group in the logs; all of them are read."""
    wanted = views.functions(spark, folder).select(
        "region", text.log_group(F.col("function_name")).alias("log_group")
    )
    return missing_groups(wanted, group_names(views.logs(views.events(spark, folder))))


@query
def unlisted_log_groups(spark, folder):
    """Functions whose log group is not in the inventory."""
    wanted = views.functions(spark, folder).select(
        "region", text.log_group(F.col("function_name")).alias("log_group")
    )
    return missing_groups(wanted, listed_groups(views.log_groups(spark, folder)))


@query
def log_groups_scanned(spark, folder):
    """Log lines per requested group; groups that do not exist are skipped."""
    wanted = views.functions(spark, folder).select(
        "region", text.log_group(F.col("function_name")).alias("log_group")
    )
    found = scan_logs(views.logs(views.events(spark, folder)), START, AS_OF, wanted)
    return found.groupBy("region", "log").agg(F.count("*").alias("lines"))


@query
def init_bands(spark, folder):
    """Cold starts per rating of their init duration."""
    parsed = cold_starts.parse_cold_starts(month_logs(spark, folder))
    return parsed.groupBy(text.init_band(F.col("init_ms")).alias("band")).agg(F.count("*").alias("cold_starts"))


@query
def pc_totals(spark, folder):
    return cold_starts.pc_totals(tables.scan_pc_configs(views.pc_configs(spark, folder)))


@query
def pc_utilisation(spark, folder):
    ev = views.events(spark, folder)
    configs = tables.scan_pc_configs(views.pc_configs(spark, folder))
    used = cold_starts.qualifier_utilisation(views.pc_metrics(ev), AS_OF, MONTH)
    report = rounded(cold_starts.pc_report(configs, used))
    return report.withColumn("band", text.util_band(F.col("pc_utilisation")))


# --- metrics


def _stat(spark: SparkSession, folder: str, metric: str, period: str, stat: str) -> DataFrame:
    ev = views.events(spark, folder)
    table = views.lambda_metrics(ev, metric) if metric == "Duration" else views.pc_metrics(ev)
    points = scan_metrics(table, "AWS/Lambda", [metric], START, AS_OF)
    return rounded(metrics.metric_stat(points, period, stat, {"function_name": "FunctionName"}), 8)


@query
def metric_stat_sum_daily(spark, folder):
    return _stat(spark, folder, "Duration", "1 day", "Sum")


@query
def metric_stat_avg_hourly(spark, folder):
    return _stat(spark, folder, "Duration", "1 hour", "Average")


@query
def metric_stat_max_hourly(spark, folder):
    return _stat(spark, folder, "ProvisionedConcurrencyUtilization", "1 hour", "Maximum")


def _cost(spark: SparkSession, folder: str, region: str | None = None, name: str | None = None) -> DataFrame:
    ev = filters.scope(views.events(spark, folder), region, name)
    functions = tables.scan_functions(views.functions(spark, folder), region, name)
    return metrics.order_cost(rounded(metrics.lambda_cost(functions, views.lambda_metrics(ev), AS_OF), 10))


@query
def lambda_cost(spark, folder):
    return _cost(spark, folder)


@query
def lambda_cost_single(spark, folder):
    return _cost(spark, folder, FUNCTION_REGION, FUNCTION)


@query
def lambda_cost_text(spark, folder):
    """The printed form of the cost report."""
    report = _cost(spark, folder)
    return report.select(
        "region",
        text.trunc_name(F.col("function_name"), 12).alias("name"),
        text.cost_text(F.col("total_cost")).alias("cost"),
        F.col("invocation_count").cast("bigint").alias("invocations"),
    )


def _activity(spark: SparkSession, folder: str, inactive_only: bool) -> DataFrame:
    functions = tables.scan_functions(views.functions(spark, folder))
    points = views.lambda_metrics(views.events(spark, folder), "Invocations")
    return rounded(metrics.lambda_activity(functions, points, AS_OF, inactive_only))


@query
def lambda_activity(spark, folder):
    return _activity(spark, folder, False)


@query
def lambda_inactive(spark, folder):
    return _activity(spark, folder, True)


@query
def lambda_list_text(spark, folder):
    """The printed form of the function list: size, age and runtime notice."""
    functions = tables.scan_functions(views.functions(spark, folder))
    # The runtimes with a notice are a handful of rows.
    notices = spark.createDataFrame([("BUILDING", "end of life")], "runtime STRING, notice STRING")
    return metrics.flag_runtimes(functions, notices).select(
        "region",
        "function_name",
        text.human_size(F.col("code_size")).alias("code_size"),
        text.age_text(F.col("last_modified"), F.lit(AS_OF).cast("timestamp")).alias("last_modified"),
        "is_deprecated",
    )


@query
def table_capacity(spark, folder):
    return rounded(metrics.table_capacity(views.table_metrics(views.events(spark, folder)), AS_OF), 8)


@query
def stream_utilisation(spark, folder):
    ev = views.events(spark, folder)
    usage = metrics.stream_usage(views.stream_metrics(ev), AS_OF, minutes=MONTH)
    return metrics.stream_utilisation(tables.scan_streams(views.streams(ev)), usage)


@query
def shard_report(spark, folder):
    ev = views.events(spark, folder)
    usage = metrics.shard_usage(views.shard_metrics(ev), AS_OF, minutes=MONTH)
    report = metrics.shard_report(tables.scan_shards(views.streams(ev)), usage)
    return rounded(report.withColumn("shard_id", text.strip_shard_prefix(F.col("shard_id"))), 8)


@query
def shard_details(spark, folder):
    """Number of datapoints per shard and metric, as the details of a row; metrics are known by their ids."""
    points = views.shard_metrics(views.events(spark, folder))
    shard = F.col("dims")["ShardId"]
    label = F.concat_ws(":", shard, "metric", F.when(F.col("metric").startswith("Outgoing"), "Average").otherwise("Sum"))
    labelled = points.select("region", F.col("dims")["StreamName"].alias("stream_name"), label.alias("label"), "value")
    values = metrics.renamed_shard_values(labelled, keep=("region", "stream_name"))
    counted = values.groupBy("region", "stream_name", "shard_id", "metric").agg(F.count("*").alias("datapoints"))
    named = counted.withColumn("metric_id", text.metric_id(F.concat_ws("-", "shard_id", "metric")))
    return named.select("region", "stream_name", text.details_json("shard_id", "metric_id", "datapoints").alias("details"))


@query
def latest_value(spark, folder):
    """Newest hourly duration sum per function."""
    durations = views.lambda_metrics(views.events(spark, folder), "Duration")
    points = scan_metrics(durations, "AWS/Lambda", ["Duration"], START, AS_OF)
    hourly = metrics.metric_stat(points, "1 hour", "Sum", {"function_name": "FunctionName"})
    return rounded(metrics.latest_value(hourly, ["region", "function_name"]))


# --- objects


@query
def select_objects_dataset(spark, folder):
    return objects.query_objects(
        spark,
        views.records(spark, folder),
        "SELECT lang, count(*) AS n, sum(n_chars) AS chars FROM s3object WHERE n_chars > 100 GROUP BY lang",
        scope="dataset",
    )


@query
def select_objects_sql_per_object(spark, folder):
    """The longest English document of every object, as SQL text."""
    return objects.query_objects(
        spark,
        views.records(spark, folder),
        "SELECT s.doc_id, s.n_chars FROM s3object s WHERE s.lang = 'en' ORDER BY s.n_chars DESC, s.doc_id LIMIT 1",
    )


@query
def select_objects_sql_totals(spark, folder):
    """Totals of every object, as SQL text; objects without a match answer too."""
    return objects.query_objects(
        spark,
        views.records(spark, folder),
        "SELECT count(*) AS n, CAST(sum(n_chars) AS DOUBLE) AS chars FROM s3object WHERE lang = 'en' AND n_chars > 20000",
    )


@query
def select_objects_limit_per_object(spark, folder):
    return objects.select_objects(
        views.records(spark, folder),
        columns=["object", "doc_id", "n_chars"],
        where="lang = 'en'",
        limit=1,
        order=["doc_id"],
    )


@query
def select_objects_agg_per_object(spark, folder):
    return objects.select_objects(
        views.records(spark, folder),
        where="lang = 'en' AND n_chars > 30000",
        aggs=["count(*) AS n", "CAST(max(n_chars) AS DOUBLE) AS longest"],
    )


@query
def object_totals(spark, folder):
    files = views.records(spark, folder).select(
        F.col("doc_id").alias("path"), F.octet_length("text").cast("bigint").alias("size")
    )
    return totals_of(files)


def _objects(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Documents landed as files, listed."""
    base = shared_dir(spark, "objects")
    landing.land_objects(views.table(spark, folder, "documents"), f"{base}/objects")
    found, errors = files.list_files(spark, f"{base}/objects/")
    return landing.landed(found), errors


@query
def object_listing(spark, folder):
    """Number and size of the files of every folder: hidden, empty and oddly named ones are files."""
    found, _ = _objects(spark, folder)
    name = F.regexp_replace(landing.part_name("path"), r"/\d+$", "")
    return found.groupBy(name.alias("folder")).agg(
        F.count("*").alias("files"), F.sum("size").cast("bigint").alias("bytes"), F.min("size").cast("bigint").alias("least")
    )


@query
def object_records(spark, folder):
    """Records of all files that can be read, with the file they are from."""
    found, _ = _objects(spark, folder)
    schema = "doc_id BIGINT, lang STRING, n_chars BIGINT"
    records, _ = files.read_records(spark, found, "JSON", {"Type": "LINES"}, schema=schema, split_bytes=2048)
    return records.select("doc_id", "lang", "n_chars", landing.part_name("object").alias("object"))


@query
def object_errors(spark, folder):
    """What could not be read: lines that are broken off, and a file that is not what its name says."""
    found, _ = _objects(spark, folder)
    _, errors = files.read_records(spark, found, "JSON", {"Type": "LINES"}, schema="doc_id BIGINT", split_bytes=4096)
    kind = F.when(F.col("error") == "malformed JSON", F.col("error")).otherwise("unreadable")
    return errors.groupBy(landing.part_name("object").alias("object"), kind.alias("error")).agg(F.count("*").alias("n"))


@query
def object_answers(spark, folder):
    """A SQL text with a table of its own, answered for every listed object, those without records too."""
    found, _ = _objects(spark, folder)
    records, _ = files.read_records(spark, found, "JSON", {"Type": "LINES"})
    text = """WITH longer AS (SELECT * FROM s3object WHERE n_chars > 1000)
              SELECT count(*) AS n, max(n_chars) AS longest FROM longer"""
    answers = objects.query_objects(
        spark, records.drop("object_row"), text, objects=found.select(F.col("path").alias("object"))
    )
    return answers.withColumn("object", landing.part_name("object"))


@query
def written_results(spark, folder):
    """A selection written as CSV with quotes and bars, and read back from the files."""
    base = shared_dir(spark, "written")
    chosen = objects.select_objects(
        views.records(spark, folder), ["doc_id", "lang", "substring(text, 1, 40) AS head"], "n_chars > 200"
    )
    chosen = chosen.withColumn("head", F.regexp_replace("head", r"\s", " "))
    writers.write_result(chosen, f"{base}/csv", "csv", {"FieldDelimiter": "|", "QuoteFields": "ALWAYS"})
    found, _ = files.list_files(spark, f"{base}/csv/part-")
    records, _ = files.read_records(
        spark, found, "CSV", {"FieldDelimiter": "|", "QuoteEscapeCharacter": "\\"}, schema="doc_id BIGINT, lang STRING, head STRING"
    )
    return records.drop("object", "object_row")


@query
def written_inventory(spark, folder):
    """Inventory documents written by type and read back."""
    base = shared_dir(spark, "inventory")
    topics = inventory.inventory_topics(
        views.topics(spark, folder), views.topic_tags(spark, folder), views.subscriptions(spark, folder)
    )
    queues = inventory.inventory_queues(views.queues(spark, folder), views.queue_tags(spark, folder))
    writers.write_inventory(inventory.inventory_report({"sns": topics, "sqs": queues}), f"{base}/report")
    found = spark.read.schema("value STRING, type STRING").text(f"{base}/report")
    return found.select(
        "type",
        F.get_json_object("value", "$.kind").alias("kind"),
        F.coalesce(F.get_json_object("value", "$.topic_arn"), F.get_json_object("value", "$.queue_arn")).alias("name"),
        F.get_json_object("value", "$.subscriptions.subscription_id").cast("bigint").alias("subscription_id"),
    )


# --- messages


@query
def scan_lines_pack(spark, folder):
    """Lines of real files in batches; ``same`` tells that ids and batches do not depend on how files are cut."""
    base = shared_dir(spark, "texts")
    landing.land_texts(views.table(spark, folder, "documents"), f"{base}/texts")

    def packed(split_bytes: int) -> DataFrame:
        """Stored without the shuffles of the packing; ids as bytes and short names of files are half as large."""
        rows = packing.pack_batches(scan_lines(spark, f"{base}/texts/", split_bytes), max_bytes=16 * 1024)
        name = landing.part_name("file").alias("file")
        rows = rows.select(F.unhex("entry_id").alias("_id"), name, "pos", "n_bytes", "batch_id")
        kept = shared_dir(spark, "packed")
        with shuffles_dropped(spark):
            rows.write.option("compression", "zstd").parquet(kept)
        return spark.read.schema(rows.schema).parquet(kept)

    one = packed(1 << 15)
    other = packed(1 << 20).select("_id", F.col("batch_id").alias("_batch"))
    both = one.join(other, "_id", "left").withColumn("same", F.col("batch_id").eqNullSafe(F.col("_batch")))
    return both.select("file", "pos", "n_bytes", "batch_id", "same")


@query
def lines_nonblank(spark, folder):
    return (
        views.lines(spark, folder)
        .groupBy("file")
        .agg(F.count("*").alias("messages"), F.sum(F.octet_length("line")).cast("bigint").alias("bytes"))
    )


def _packed(spark: SparkSession, folder: str, max_bytes: int) -> DataFrame:
    return packing.pack_batches(views.lines(spark, folder), views.LINE_ORDER, max_bytes=max_bytes)


@query
def pack_batches(spark, folder):
    return _packed(spark, folder, 16 * 1024).select("file", "doc_id", "line_no", "n_bytes", "batch_id")


@query
def batch_totals(spark, folder):
    """Number of batches per file under the queue's own limits."""
    packed = _packed(spark, folder, 256 * 1024)
    return packed.groupBy("file").agg(
        (F.max("batch_id") + 1).alias("batches"), F.count("*").alias("messages")
    )


@query
def send_failures(spark, folder):
    """Lines that are too long for the queue, with their text."""
    lines = views.lines(spark, folder)
    entries = lines.withColumn("n_bytes", F.octet_length("line")).withColumn(
        "entry_id", F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in ("file", "doc_id", "line_no")]), 256)
    )
    return messages.failed_entries(delivery.landing_results(entries, 4096), entries)


@query
def send_results(spark, folder):
    """Outcome of every line, sent in its batches and read back from what the sink committed."""
    base = shared_dir(spark, "outbox")
    packed = _packed(spark, folder, 16 * 1024)
    request = F.concat_ws(":", "file", "batch_id")
    entries = packed.select("entry_id", F.col("line").alias("body"), request.alias("request"))
    outbox.send(entries.repartition("request").sortWithinPartitions("request"), base, max_bytes=4096)
    return outbox.results(spark, base).select("entry_id", "status", "error", F.octet_length("body").alias("n_bytes"))


@query
def drain_queue(spark, folder):
    """A queue drained in reads of 2 files, with a restart in between: every delivery once, those of errors refused.

    ``accepted`` and ``refused`` are what the manifests count.
    """
    ev = views.events(spark, folder)
    base = shared_dir(spark, "drain")
    rows = views.messages(ev).drop("queue")
    turn = F.pmod(F.xxhash64("message_id"), F.lit(6))
    for n in (0, 1):
        rows.where(turn % 2 == n).repartition(3).write.mode("append").parquet(f"{base}/queue")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/queue")
        entries = stream.select(F.col("message_id").alias("entry_id"), "body")
        outbox.send_stream(entries, f"{base}/out", f"{base}/checkpoint", sender=_refuse_errors)
    counted = outbox.manifests(spark, f"{base}/out")
    found = outbox.results(spark, f"{base}/out").select("entry_id", "status", "error")
    return found.withColumns({c: counted.agg(F.sum(c)).scalar() for c in ("accepted", "refused")})


def _refuse_errors(batch: list[dict]) -> dict[str, str]:
    return {e["entry_id"]: "refused" for e in batch if '"event_type":"error"' in e["body"]}


def _replayed(spark: SparkSession, folder: str, target: str) -> DataFrame:
    delivered = messages.first_deliveries(views.deliveries(views.events(spark, folder)))
    return messages.replay_rows(delivered, target)


@query
def replay_queue(spark, folder):
    return _replayed(spark, folder, "queue").withColumn("attributes", attribute_text("attributes"))


@query
def replay_topic(spark, folder):
    return _replayed(spark, folder, "topic").withColumn("attributes", attribute_text("attributes"))


@query
def replay_stream(spark, folder):
    return _replayed(spark, folder, "stream")


@query
def replay_remaining(spark, folder):
    """What stays in all queues after one of them was replayed."""
    every = views.messages(views.events(spark, folder))
    one = every.where(F.col("queue") == "error-dlq")
    return messages.remaining(every, one).select("message_id", "queue")


@query
def replay_keep(spark, folder):
    every = views.messages(views.events(spark, folder))
    return messages.remaining(every, every, keep=True).select("message_id", "queue")


@query
def decode_topic(spark, folder):
    decoded = envelopes.decode_topic(views.topic_messages(views.events(spark, folder)), keep=("event_id",))
    return decoded.withColumn("message_attributes", F.col("message_attributes")["user"]["Value"])


@query
def decode_event(spark, folder):
    decoded = envelopes.decode_event(views.event_messages(views.events(spark, folder)), keep=("event_id",))
    return decoded.withColumn("resources", F.array_join("resources", ","))


@query
def decode_change(spark, folder):
    decoded = envelopes.decode_change(
        views.change_messages(views.events(spark, folder)).withColumnRenamed("event_id", "source_id"),
        keep=("source_id",),
    )
    return _change_text(decoded)


def _change_text(decoded: DataFrame) -> DataFrame:
    return decoded.withColumns({"keys": pairs("keys"), "new_image": pairs("new_image")}).drop("old_image")


@query
def decode_record(spark, folder):
    return envelopes.decode_record(views.stream_records(views.events(spark, folder)))


# --- streams


@query
def tail_queue_dedup(spark, folder):
    stream = tails.tail_queue(views.deliveries(views.event_stream(spark, folder)))
    found = runner.run_available(stream, "tail-queue")
    return found.withColumn("attributes", attribute_kinds("attributes"))


@query
def tail_logs(spark, folder):
    logs = views.logs(views.event_stream(spark, folder))
    stream = tails.tail_logs(logs, condition="message LIKE '%Init Duration%'")
    return rounded(runner.run_available(stream, "tail-logs"))


@query
def tail_events_bus(spark, folder):
    bodies = views.event_messages(views.event_stream(spark, folder))
    stream = tails.tail_events(bodies, not_source="view", keep=("event_id",))
    return runner.run_available(stream, "tail-bus").withColumn("resources", F.array_join("resources", ","))


@query
def tail_events_rule(spark, folder):
    bodies = views.event_messages(views.event_stream(spark, folder))
    stream = tails.tail_events(bodies, source="purchase", detail_type="large", keep=("event_id",))
    return runner.run_available(stream, "tail-rule").withColumn("resources", F.array_join("resources", ","))


@query
def tail_events_stamped(spark, folder):
    """The tail of a rule under its older name, every event stamped when it is seen."""
    bodies = views.event_messages(views.event_stream(spark, folder))
    stream = tails.stamp(tails.tail_cloudwatch_events_rule(bodies, source="error", keep=("event_id",)))
    found = runner.run_available(stream, "tail-stamped")
    seen = F.col("seen_at").between(F.current_timestamp() - F.expr("INTERVAL 1 DAY"), F.current_timestamp())
    return found.select("event_id", "time", "detail_type", seen.alias("seen"))


@query
def tail_topic(spark, folder):
    stream = tails.tail_topic(views.topic_messages(views.event_stream(spark, folder)), keep=("event_id",))
    found = runner.run_available(stream, "tail-topic")
    return found.withColumn("message_attributes", F.col("message_attributes")["user"]["Value"])


@query
def tail_changes(spark, folder):
    bodies = views.change_messages(views.event_stream(spark, folder))
    renamed = bodies.withColumnRenamed("event_id", "source_id")
    return _change_text(runner.run_available(tails.tail_changes(renamed, keep=("source_id",)), "tail-changes"))


@query
def tail_records(spark, folder):
    stream = tails.tail_records(views.stream_records(views.event_stream(spark, folder)))
    return runner.run_available(stream, "tail-records")


@query
def tail_shards(spark, folder):
    """Records shard by shard over several reads, with a restart after the first; the last shard's parent is the first.

    ``read_no`` tells in which read a record came: a tenth of all records per shard and read, parents before children.
    """
    records = views.stream_records(views.events(spark, folder))
    base = shared_dir(spark, "shards")
    names = [f"shardId-00000000000{i}" for i in range(5)]
    described = [{"shard_id": name, "closed": name == names[0]} for name in names]
    described[-1]["parent_shard_id"] = names[0]
    landing.land_shards(records, f"{base}/stream", described)
    per_read = records.count() // 10 + 1
    for batches in (1, None):
        stream = shards.read_shards(spark, f"{base}/stream", f"{base}/checkpoint", records_per_read=per_read)
        tail = tails.tail_records(stream, keep=("position",))
        runner.run_batches(tail, f"{base}/checkpoint", f"{base}/table", batches)
    found = runner.batch_table(spark, f"{base}/table", tail.schema)
    return found.withColumnRenamed("batch", "read_no")


@query
def tail_queue_bounded(spark, folder):
    """First sightings over 20 files in 5 reads; the memory holds 7 in 10 of the ids, so the oldest are forgotten.

    The second copy of a message lands a read after the first, which the memory covers.
    """
    ev = views.events(spark, folder)
    base = shared_dir(spark, "bounded")
    copy = F.explode(F.when(F.col("event_type") == "error", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    ev = ev.withColumn("copy", copy)
    turn = (F.pmod(F.xxhash64("event_id"), F.lit(4)) + F.col("copy")).cast("int")
    rows = views.messages(ev.withColumn("landed_at", F.timestamp_seconds(turn.cast("bigint"))))
    schema = rows.drop("queue").schema
    for n in range(5):
        landed = rows.where(F.col("received_at") == F.timestamp_seconds(F.lit(n))).drop("queue")
        landed.repartition(4).write.mode("append").parquet(f"{base}/queue")
    n_ids = views.table(spark, folder, "events").count()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{base}/queue")
    memory = max(4, n_ids * 7 // 10)
    tail = remembered.tail_queue_bounded(stream, "received_at", remembered=memory, buckets=4)
    found = runner.run_available(tail, "tail-bounded", remembered.SETTINGS)
    within = F.col("held") <= memory // 4
    return found.select("message_id", "body", attribute_kinds("attributes").alias("attributes"), within.alias("within_bound"))


@query
def metric_stat_stream(spark, folder):
    points = views.lambda_metrics(views.event_stream(spark, folder, in_time=True), "Duration")
    stream = tails.metric_stat_stream(points, "1 hour", "Sum", {"function_name": "FunctionName"})
    keys = ["region", "metric", "function_name", "bucket_start"]
    return rounded(runner.run_latest(stream, "metric-stat", keys))


@query
def metric_stat_closed(spark, folder):
    """The same rollup in append mode: only periods that can no longer change."""
    points = views.lambda_metrics(views.event_stream(spark, folder, in_time=True), "Duration")
    stream = tails.metric_stat_stream(points, "1 hour", "Sum", {"function_name": "FunctionName"})
    return rounded(runner.run_available(stream, "metric-stat-closed"))


def _rolled_up(spark: SparkSession, folder: str, points: DataFrame, period: str, dims: dict[str, str]) -> DataFrame:
    """Points landed in four turns that each hold points of all days, two files each, rolled up in two runs.

    The days before the last turn's points are long closed when it comes; a compaction falls between.
    """
    base = shared_dir(spark, "rollup")
    points = points.withColumn("ts", F.col("ts").cast("timestamp"))
    turn = F.pmod(F.xxhash64("ts", "value", "metric"), F.lit(4))
    for n in range(4):
        points.where(turn == n).repartition(2).write.mode("append").parquet(f"{base}/points")
        if n % 2:
            stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/points")
            rollups.rollup_stream(stream, f"{base}/rollup", f"{base}/checkpoint", period, dims, compact_every=3)
    return rollups.rollup(spark, f"{base}/rollup", list(dims))


@query
def metric_rollup_late(spark, folder):
    """Daily durations per function from points that come in any order."""
    points = views.lambda_metrics(views.events(spark, folder), "Duration")
    states = _rolled_up(spark, folder, points, "1 day", {"function_name": "FunctionName"})
    total, average = F.col("total"), F.col("total") / F.col("n")
    return rounded(
        states.select(
            "region", "metric", "function_name", "bucket_start", "n",
            total.alias("total"), average.alias("average"), "least", "greatest",
        ), 9
    )


@query
def stream_utilisation_live(spark, folder):
    """Utilisation of every 5-minute period, by the shards that the stream had then: twice as many from the 16th on."""
    ev = views.events(spark, folder)
    states = _rolled_up(spark, folder, views.stream_metrics(ev), "5 minutes", {"stream_name": "StreamName"})
    usage = metrics.pivot_metrics(
        rollups.stat(states, "Sum"), ["region", "stream_name", "bucket_start"], {m: f"{m}Sum" for m in STREAM_METRICS}
    )
    streams = tables.scan_streams(views.streams(ev))
    first = streams.withColumn("valid_from", F.lit(START).cast("timestamp"))
    grown = streams.withColumn("shards", F.col("shards") * 2).withColumn("valid_from", F.lit("2024-01-16").cast("timestamp"))
    return rounded(metrics.utilisation_by_period(usage, first.unionByName(grown), digits=8), 8)


@query
def drain_progress(spark, folder):
    """Messages per read of a drain and so far, over a restart: four reads of two files, as they landed."""
    ev = views.events(spark, folder)
    base = shared_dir(spark, "progress")
    rows = views.messages(ev).drop("queue")
    for n in range(4):
        rows.where(F.regexp_extract("message_id", r"(\d+)$", 1).cast("bigint") % 4 == n).repartition(2).write.mode("append").parquet(
            f"{base}/queue"
        )
        if n % 2:
            stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/queue")
            runner.drain(stream, f"{base}/checkpoint", delivery.replay_router("stream", f"{base}/target"))
    delivered = spark.read.schema("data STRING, partition_key STRING").json(f"{base}/target").agg(F.count("*")).scalar()
    return runner.progress(spark, f"{base}/checkpoint").withColumn("delivered", delivered)


# --- inventory


@query
def inventory_functions(spark, folder):
    """A row per function with what is single-valued, and a row per mapping and configuration."""
    known = tables.scan_functions(views.functions(spark, folder))
    functions = known.select("region", "function_name", "runtime")
    orders = views.pc_configs(spark, folder)
    configs = tables.scan_pc_configs(orders).select("region", "function_name", "qualifier", "allocated")
    mappings = views.subscriptions(spark, folder).select(
        "region",
        F.concat(F.lit("Customer#"), padded(F.element_at(F.split("topic_arn", "-"), -1), 9)).alias(
            "function_name"
        ),
        F.col("subscription_id").alias("uuid"),
    )
    tags = functions.select(
        "region", "function_name", F.lit("segment").alias("key"), F.col("runtime").alias("value"), F.lit(0).alias("pos")
    )
    # Two configurations, of which the first counts, for large functions; a policy for those of one runtime.
    invoke = known.where("memory_size > 512").select(
        "region", "function_name", F.explode(F.array((F.col("memory_size") / 128).cast("int"), F.lit(9))).alias("retries")
    )
    policies = functions.where("runtime = 'BUILDING'").select(
        "region", "function_name", F.concat(F.lit("allow "), F.col("function_name")).alias("document")
    )
    rows = inventory.inventory_functions(functions, tags, mappings, configs, invoke, policies)
    config = F.col("provisioned_concurrency_configs")
    return rows.select(
        "region",
        "function_name",
        "kind",
        "runtime",
        pairs("tags").alias("tags"),
        F.col("event_invoke_config.retries").alias("retries"),
        F.col("policy.document").alias("policy"),
        F.coalesce(
            F.col("event_source_mappings.uuid").cast("string"),
            F.concat(config["qualifier"], F.lit(":"), config["allocated"].cast("string")),
        ).alias("child"),
    )


@query
def inventory_tables(spark, folder):
    """A row per table and a row per day of its capacity."""
    capacity = metrics.table_capacity(views.table_metrics(views.events(spark, folder)), AS_OF)
    named = capacity.select("region", "table_name").distinct().withColumn("table_status", F.lit("ACTIVE"))
    tags = named.select(
        "region", "table_name", F.lit("name").alias("key"), F.col("table_name").alias("value"), F.lit(0).alias("pos")
    )
    rows = inventory.inventory_tables(named, tags, capacity)
    day = F.col("metrics")
    return rounded(
        rows.select(
            "region",
            "table_name",
            "kind",
            "table_status",
            pairs("tags").alias("tags"),
            day["day"].alias("day"),
            day["consumed_read"].alias("consumed_read"),
            day["provisioned_write"].alias("provisioned_write"),
        ),
        8,
    )


@query
def inventory_topics(spark, folder):
    """A row per topic and a row per subscription."""
    rows = inventory.inventory_topics(
        views.topics(spark, folder), views.topic_tags(spark, folder), views.subscriptions(spark, folder)
    )
    return rows.select(
        "region",
        "topic_arn",
        "kind",
        "owner",
        pairs("tags").alias("tags"),
        F.col("subscriptions.subscription_id").alias("subscription_id"),
        F.col("subscriptions.protocol").alias("protocol"),
    )


@query
def inventory_queues(spark, folder):
    """A row per queue, with the totals of those that have it as dead-letter target, and a row for each of them."""
    rows = inventory.inventory_queues(views.queues(spark, folder), views.queue_tags(spark, folder))
    total = lambda name: F.when(F.col("kind") == inventory.RESOURCE, F.coalesce(F.col("source_totals")[name], F.lit(0))).alias(name)
    return rows.select(
        "queue_arn",
        "kind",
        "queue_url",
        pairs("tags").alias("tags"),
        F.col("source_queues.source_queue_url").alias("source_queue_url"),
        total("sources"),
        total("url_chars"),
    )


@query
def inventory_report(spark, folder):
    topics = views.topics(spark, folder)
    functions = tables.scan_functions(views.functions(spark, folder)).select("region", "function_name", "memory_size")
    return inventory.inventory_report({"lambda": functions, "sns": topics})


@query
def queue_sources(spark, folder):
    return inventory.queue_sources(views.queues(spark, folder))


@query
def resource_scan(spark, folder):
    """The regional resources of three kinds in two regions."""
    found = tables.scan_resources(
        views.resources(spark, folder), ["role", "nat_gateway", "log_group"], [REGION, "EUROPE"]
    )
    stored = F.col("bytes").cast("double").alias("bytes")
    return found.select("type", "region", "id", "name", "path", "parent", stored)


@query
def resource_counts(spark, folder):
    counts = inventory.resource_counts(views.resources(spark, folder))
    return counts


@query
def resource_counts_by_region(spark, folder):
    """Counts per region; resources without region count under none."""
    resources = views.resources(spark, folder).withColumn("region", F.coalesce("region", F.lit("global")))
    counts = inventory.resource_counts(resources, by_region=True)
    return counts.withColumn("region", F.coalesce("region", F.lit("all")))


@query
def cleanup_plan(spark, folder):
    return inventory.cleanup_plan(views.resources(spark, folder))


@query
def last_attempt(spark, folder):
    return inventory.last_attempt(views.results(spark, folder))


@query
def failure_summary(spark, folder):
    return inventory.failure_summary(inventory.last_attempt(views.results(spark, folder)))


@query
def failure_summary_global(spark, folder):
    """Resources of one type have no region."""
    results = views.results(spark, folder)
    results = results.withColumn("region", F.when(F.col("type") != "1-URGENT", F.col("region")))
    return inventory.failure_summary(inventory.last_attempt(results))


@query
def other_buckets(spark, folder):
    stacks, resources = views.stacks(spark, folder)
    return tables.other_buckets(stacks, resources)


@query
def bus_targets(spark, folder):
    tree = inventory.bus_targets(*views.buses(spark, folder))
    return tree.withColumn("rule", F.col("rule").cast("string"))


@query
def role_policies(spark, folder):
    policies = inventory.role_policies(*views.roles(spark, folder))
    return policies.withColumn("policy", F.col("policy").cast("string"))


@query
def disabled_rules(spark, folder):
    _, rules, _ = views.buses(spark, folder)
    state = F.when(F.col("o_orderstatus") == "P", "DISABLED").otherwise("ENABLED")
    return resolve.disabled_rules(rules.withColumn("state", state)).select("region", "bus", "rule")


@query
def recent_log_streams(spark, folder):
    """The 50 newest streams of every group, of all events: a group that has been silent for long has its streams too."""
    return rounded(inventory.recent_log_streams(views.logs(views.events(spark, folder)), 50))


def _regions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Functions landed by region; one region cannot be read and one is not there."""
    functions = views.functions(spark, folder).select("region", "function_name", "memory_size")
    folders = landing.land_regions(functions, f"{shared_dir(spark, 'regions')}/functions", "EUROPE")
    return read_regions(spark, folders, "function_name STRING, memory_size INT")


@query
def regions_read(spark, folder):
    """Functions of all regions that can be read."""
    return _regions(spark, folder)[0]


@query
def region_errors(spark, folder):
    """Regions that cannot be read, each with an error."""
    return _regions(spark, folder)[1].select("region", (F.length("error") > 0).alias("has_error"))


@query
def resolve_topic(spark, folder):
    topics = views.topics(spark, folder).withColumn("topic_arn", F.regexp_replace("topic_arn", ":topic", ":1234567890:topic"))
    return resolve.topics_named(topics, "topic-7").select("region", "topic_arn")


@query
def resolve_group(spark, folder):
    """Log groups that begin with a name."""
    return resolve.groups_named(listed_groups(views.log_groups(spark, folder)), "/aws/lambda/Customer#00000001")


@query
def resolve_queue(spark, folder):
    return resolve.exact_queues(views.queues(spark, folder), "queue-1").select("queue_url")


# --- versions and tuning


@query
def latest_version(spark, folder):
    return version_ops.latest_version(tables.scan_versions(views.versions(spark, folder)))


@query
def version_places(spark, folder):
    """Versions of every application in order, the highest first."""
    return version_ops.version_places(tables.scan_versions(views.versions(spark, folder)))


@query
def version_drift(spark, folder):
    latest = version_ops.latest_version(tables.scan_versions(views.versions(spark, folder)))
    return version_ops.version_drift(latest, views.app_stacks(spark, folder))


def _power(spark: SparkSession, folder: str, strategy: str) -> DataFrame:
    chosen = tuning.power_select(views.measurements(views.events(spark, folder)), strategy)
    return rounded(chosen, 6, average_cost=10)


@query
def power_select_cost(spark, folder):
    return _power(spark, folder, "cost")


@query
def power_select_speed(spark, folder):
    return _power(spark, folder, "speed")


@query
def power_select_balanced(spark, folder):
    return _power(spark, folder, "balanced")
