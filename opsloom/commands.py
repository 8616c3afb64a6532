"""Command line over landed tables: ``python -m opsloom <command> --tables <folder> ...``.

Tables are Parquet folders named as in ``schemas`` (functions, logs, metrics, ...). Streams
are folders of JSON files. Commands that would change an account list what they would do.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom import schemas
from opsloom.functions.text import human_size
from opsloom.operators import cold_starts, inventory, metrics, objects, reports, resolve, tuning, versions
from opsloom.operators.packing import pack_batches
from opsloom.session import shared_dir
from opsloom.sinks import delivery, writers
from opsloom.sources import filters, shards, tables
from opsloom.sources.files import list_files, read_records
from opsloom.sources.lines import scan_lines
from opsloom.sources.logs import listed_groups
from opsloom.sources.objects import COMPRESSION_SUFFIX, object_totals
from opsloom.sources.remote import listed
from opsloom.streaming import runner, tails

Command = Callable[[SparkSession, argparse.Namespace], "DataFrame | None"]
COMMANDS: dict[str, tuple[Command, list[str]]] = {}

# Options by name: each command lists those it takes.
OPTIONS: dict[str, dict] = {
    "name": {"flags": ["-n", "--name"]},
    "region": {"flags": ["-r", "--region"]},
    "minutes": {"flags": ["-m", "--minutes"], "type": int, "default": 60},
    "hours": {"flags": ["--hours"], "type": int},
    "days": {"flags": ["-d", "--days"], "type": int},
    "approx": {"flags": ["--approx"], "action": "store_true"},
    "inactive": {"flags": ["-i", "--inactive"], "action": "store_true"},
    "prefix": {"flags": ["-x", "--prefix"], "required": True},
    "expression": {"flags": ["-e", "--expression"], "help": "SQL over the table s3object, for each object"},
    "dataset": {"flags": ["--dataset"], "action": "store_true", "help": "all objects are one table"},
    "columns": {"flags": ["--columns"], "default": "*", "help": "columns selected from each object"},
    "where": {"flags": ["--where"]},
    "aggs": {"flags": ["--aggs"], "help": "aggregates per object, separated by semicolons"},
    "limit": {"flags": ["--limit"], "type": int, "help": "rows per object"},
    "file_type": {"flags": ["-f", "--file-type"], "choices": ["CSV", "JSON", "Parquet"], "required": True},
    "csv_config": {"flags": ["--csv-config"], "type": json.loads, "default": {}},
    "json_config": {"flags": ["--json-config"], "type": json.loads, "default": {"Type": "DOCUMENT"}},
    "output_file": {"flags": ["-o", "--output-file"]},
    "output_config": {"flags": ["--output-config"], "type": json.loads, "default": {}},
    "compression": {"flags": ["--compression-type"], "choices": ["NONE", "GZIP", "BZIP2"], "default": "NONE"},
    "stream": {"flags": ["--stream"], "required": True, "help": "folder of landed JSON files"},
    "stream_folder": {"flags": ["--stream"], "help": "folder of landed JSON files"},
    "shards": {"flags": ["--shards"], "action": "store_true", "help": "the folder has descriptions and records of shards"},
    "from_start": {"flags": ["--from-start"], "action": "store_true"},
    "checkpoint": {"flags": ["--checkpoint"]},
    "interval": {"flags": ["--interval"], "type": int, "default": 1000},
    "filter": {"flags": ["--filter"], "help": "SQL condition on the log events"},
    "detail_type": {"flags": ["--detail-type"]},
    "not_source": {"flags": ["--not-source"]},
    "target_type": {"flags": ["-t", "--target-type"], "choices": ["queue", "topic", "stream"], "default": "queue"},
    "target_folder": {"flags": ["--target"], "help": "folder of the target"},
    "target_name": {"flags": ["--target-name"], "help": "name of the target in the inventory"},
    "until_empty": {"flags": ["--until-empty"], "action": "store_true", "help": "go on until ten reads find nothing"},
    "results": {"flags": ["--results"], "help": "table of attempts"},
    "keep": {"flags": ["-k", "--keep"], "action": "store_true"},
    "file_path": {"flags": ["-f", "--file-path"], "required": True},
    "concurrency": {"flags": ["-c", "--concurrency"], "type": int, "help": "tasks that send at a time"},
    "strategy": {"flags": ["-s", "--strategy"], "choices": ["cost", "speed", "balanced"], "required": True},
    "weight": {"flags": ["-w", "--balanced-weight"], "type": float, "default": 0.5},
    "power_values": {"flags": ["-v", "--power-values"], "default": "ALL"},
}

# Options that are another form of one argument.
DEST = {"stream_folder": "stream", "target_folder": "target"}


def command(name: str, *options: str):
    def register(fn: Command) -> Command:
        COMMANDS[name] = (fn, list(options))
        return fn

    return register


def _table(spark: SparkSession, args: argparse.Namespace, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{args.tables}/{name}")


def _functions(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    name = getattr(args, "name", None)
    return tables.scan_functions(_table(spark, args, "functions", schemas.FUNCTIONS), args.region, name)


def _metrics(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    return filters.scope(_table(spark, args, "metrics", schemas.METRICS), args.region)


@command("analyze-lambda-cold-starts", "name", "region", "minutes", "hours", "days", "approx")
def analyze_cold_starts(spark, args):
    minutes = filters.window_minutes(args.minutes, args.hours, args.days)
    logs = filters.scope(_table(spark, args, "logs", schemas.LOGS), args.region)
    stats = cold_starts.cold_start_stats(filters.lookback(logs, args.as_of, minutes), exact=not args.approx)
    configs = tables.scan_pc_configs(_table(spark, args, "pc_configs", schemas.PC_CONFIGS), args.region, args.name)
    used = cold_starts.qualifier_utilisation(_metrics(spark, args), args.as_of, minutes)
    pc = cold_starts.pc_report(configs, used)
    report = cold_starts.cold_start_report(_functions(spark, args), stats, pc)
    return reports.cold_start_table(cold_starts.order_report(report))


@command("analyze-lambda-cost", "name", "region", "days")
def analyze_cost(spark, args):
    days = args.days or 30
    cost = metrics.lambda_cost(_functions(spark, args), _metrics(spark, args), args.as_of, days)
    return reports.cost_table(metrics.order_cost(cost), days)


@command("list-lambda", "region", "inactive")
def list_lambda(spark, args):
    activity = metrics.lambda_activity(_functions(spark, args), _metrics(spark, args), args.as_of, args.inactive)
    return reports.activity_table(activity, args.as_of)


@command("list-kinesis-streams", "region")
def list_streams(spark, args):
    streams = tables.scan_streams(_table(spark, args, "streams", schemas.STREAMS), args.region)
    usage = metrics.stream_usage(_metrics(spark, args), args.as_of)
    return reports.stream_table(metrics.stream_utilisation(streams, usage))


@command("list-kinesis-shards", "name", "region")
def list_shards(spark, args):
    shards = tables.scan_shards(_table(spark, args, "streams", schemas.STREAMS), args.region, args.name)
    return reports.shard_table(metrics.shard_report(shards, metrics.shard_usage(_metrics(spark, args), args.as_of)))


def _print_errors(errors: DataFrame, most: int = 20) -> None:
    """What could not be read, said before the answer; the answer is of the rest."""
    rows = errors.take(most + 1)
    for row in rows[:most]:
        print(f"not read: {row['object']}: {row['error']}")
    if len(rows) > most:
        print(f"not read: these are the first {most}; there are more")


@command(
    "s3-select-batch", "prefix", "expression", "dataset", "columns", "where", "aggs", "limit", "file_type", "csv_config",
    "json_config", "output_file", "output_config", "compression",
)
def select_batch(spark, args):
    listing, unlisted = list_files(spark, args.prefix)
    suffix = COMPRESSION_SUFFIX[args.compression]
    listing = listing.where(F.col("path").endswith(suffix))
    found = object_totals(listing).withColumn("size", human_size(F.col("total_size"))).first()
    _print_errors(unlisted.withColumnRenamed("path", "object"))
    if not found["objects"]:
        print("nothing lies below that prefix")
        return None
    print(f"{found['objects']} objects of together {found['size']}")
    config = {"CSV": args.csv_config, "JSON": args.json_config}.get(args.file_type)
    records, errors = read_records(spark, listing, args.file_type, config, args.compression)
    _print_errors(errors)
    name = "_object" if "_object" in records.columns else "object"
    answering = listing.select(F.col("path").alias(name))
    one_table = "dataset" if args.dataset else "object"
    if args.expression:
        records = records.drop("object_row")
        result = objects.query_objects(spark, records, args.expression, one_table, answering, name)
    else:
        aggs = [a.strip() for a in args.aggs.split(";")] if args.aggs else None
        result = objects.select_objects(
            records, [args.columns], args.where, aggs, args.limit, ["object_row"], one_table, name, answering
        ).drop("object_row")
    if args.output_file:
        writers.write_result(result, args.output_file, writers.output_format(args.file_type), args.output_config)
        return None
    return result


def _tail(spark: SparkSession, args: argparse.Namespace, schema: str, decode: Callable[[DataFrame], DataFrame], **read):
    start = "earliest" if args.from_start else "latest"
    stream = runner.read_stream(spark, args.stream, schema, "json", start, **read)
    folder = args.checkpoint or shared_dir(spark, "tail")
    query = runner.tail_to_console(tails.stamp(decode(stream)), folder, f"{args.interval} milliseconds")
    query.awaitTermination()


def _tail_shards(spark: SparkSession, args: argparse.Namespace, path: str, decode: Callable[[DataFrame], DataFrame]):
    start = "earliest" if args.from_start else "latest"
    folder = args.checkpoint or shared_dir(spark, "tail")
    stream = shards.read_shards(spark, path, folder, start)
    query = runner.tail_to_console(tails.stamp(decode(stream)), folder, f"{args.interval} milliseconds")
    query.awaitTermination()


TAIL = ("stream", "from_start", "checkpoint", "interval")
BODY = "body STRING"


@command("tail-cloudwatch-logs", "name", "region", "filter", *TAIL)
def tail_logs(spark, args):
    group = None
    if args.name:
        known = filters.scope(_table(spark, args, "resources", schemas.RESOURCES), args.region)
        group = resolve.resolve_group(listed_groups(known), args.name)
    _tail(spark, args, schemas.LOGS, lambda s: tails.tail_logs(s, group, args.filter, args.region))


@command("tail-dynamodb", "name", "region", "stream_folder", "from_start", "checkpoint", "interval")
def tail_dynamodb(spark, args):
    """Changes of a table by its name, shard by shard, or of a folder of JSON files."""
    if args.name:
        known = filters.scope(spark.read.parquet(f"{args.tables}/tables"), args.region)
        path = shards.table_stream(known, args.name)
        _tail_shards(spark, args, path, lambda s: tails.tail_changes(s, "data"))
    elif args.stream:
        _tail(spark, args, BODY, tails.tail_changes)
    else:
        raise ValueError("give the name of a table or a folder")


@command("tail-kinesis", "shards", *TAIL)
def tail_kinesis(spark, args):
    if args.shards:
        _tail_shards(spark, args, args.stream, tails.tail_records)
        return
    _tail(spark, args, schemas.STREAM_RECORDS, tails.tail_records)


@command("tail-sns", *TAIL)
def tail_sns(spark, args):
    _tail(spark, args, BODY, tails.tail_topic)


@command("tail-sqs", *TAIL)
def tail_sqs(spark, args):
    schema = f"message_id STRING, body STRING, attributes {schemas.ATTRIBUTES}"
    _tail(spark, args, schema, tails.tail_queue, arrival="received_at")


def _tail_rule(spark, args):
    _tail(spark, args, BODY, lambda s: tails.tail_events(s, args.name, args.detail_type))


def _tail_bus(spark, args):
    _tail(spark, args, BODY, lambda s: tails.tail_events(s, not_source=args.not_source))


for _alias in ("tail-eventbridge-rule", "tail-cloudwatch-events-rule"):
    command(_alias, "name", "detail_type", *TAIL)(_tail_rule)
for _alias in ("tail-eventbridge-bus", "tail-cloudwatch-events-bus"):
    command(_alias, "not_source", *TAIL)(_tail_bus)


def _named(spark: SparkSession, args: argparse.Namespace, kind: str, name: str) -> str:
    """Where the queue, topic or stream of a name lands, from the inventory of its kind."""
    known = filters.scope(spark.read.parquet(f"{args.tables}/{kind}s"), args.region)
    return {"queue": resolve.queue_place, "topic": resolve.topic_place, "stream": resolve.stream_place}[kind](known, name)


def _target(spark: SparkSession, args: argparse.Namespace, kind: str, name: str | None) -> str:
    if args.target:
        return args.target
    if not name:
        raise ValueError("give the name or the folder of the target")
    return _named(spark, args, kind, name)


@command(
    "replay-sqs-dlq", "name", "region", "stream_folder", "checkpoint", "target_folder", "target_name", "target_type", "keep",
    "until_empty",
)
def replay_dlq(spark, args):
    """Messages stay in the landed folder; without ``--keep`` the checkpoint marks them as taken.

    Queue and target are given by name, as the inventory has them, or as folders.
    """
    if not (args.stream or args.name):
        raise ValueError("give the name or the folder of the queue")
    source = args.stream or _named(spark, args, "queue", args.name)
    target = _target(spark, args, args.target_type, args.target_name)
    schema = f"message_id STRING, body STRING, attributes {schemas.ATTRIBUTES}"
    if args.keep or not args.checkpoint:
        checkpoint = shared_dir(spark, "replay")
    else:
        checkpoint = args.checkpoint

    def read() -> DataFrame:
        return tails.tail_queue(runner.read_stream(spark, source, schema, "json", arrival="received_at"))

    route = delivery.replay_router(args.target_type, target)
    if args.until_empty:
        runner.drain_until_empty(read, checkpoint, route)
    else:
        runner.drain(read(), checkpoint, route)
    return runner.progress(spark, checkpoint) if listed(f"{checkpoint}/progress") else None


@command("send-to-sqs", "name", "region", "file_path", "target_folder")
def send_to_queue(spark, args):
    target = _target(spark, args, "queue", args.name)
    _, failures = delivery.to_queue(pack_batches(scan_lines(spark, args.file_path)), target)
    return failures


@command("send-to-sns", "name", "region", "file_path", "target_folder", "concurrency")
def send_to_topic(spark, args):
    target = _target(spark, args, "topic", args.name)
    _, failures = delivery.to_topic(scan_lines(spark, args.file_path), target, concurrency=args.concurrency)
    return failures


# Key columns of the tables of children, for those that are not there.
CHILDREN = {
    "function_tags": "region STRING, function_name STRING, key STRING, value STRING, pos INT",
    "event_source_mappings": "region STRING, function_name STRING",
    "invoke_configs": "region STRING, function_name STRING",
    "policies": "region STRING, function_name STRING",
    "table_tags": "region STRING, table_name STRING, key STRING, value STRING, pos INT",
    "topic_tags": "region STRING, topic_arn STRING, key STRING, value STRING, pos INT",
    "subscriptions": "region STRING, topic_arn STRING",
    "queue_tags": "region STRING, queue_arn STRING, key STRING, value STRING, pos INT",
    "pc_configs": schemas.PC_CONFIGS,
    "metrics": schemas.METRICS,
}


@command("scanner", "region", "output_file")
def scan_account(spark, args):
    """Documents of functions, tables, topics and queues. A table that cannot be read is said, and the others are scanned."""

    def read(name: str) -> DataFrame | None:
        try:
            table = spark.read.parquet(f"{args.tables}/{name}")
        except AnalysisException as error:
            print(f"not read: {name}: {error.getCondition()}")
            return spark.createDataFrame([], CHILDREN[name]) if name in CHILDREN else None
        return filters.scope(table, args.region)

    def functions(parents: DataFrame) -> DataFrame:
        configs = tables.scan_pc_configs(read("pc_configs"), args.region)
        return inventory.inventory_functions(
            parents, read("function_tags"), read("event_source_mappings"), configs, read("invoke_configs"), read("policies")
        )

    def dynamo(parents: DataFrame) -> DataFrame:
        return inventory.inventory_tables(parents, read("table_tags"), metrics.table_capacity(read("metrics"), args.as_of))

    scans = {
        "lambda": ("functions", functions),
        "dynamodb": ("tables", dynamo),
        "sns": ("topics", lambda parents: inventory.inventory_topics(parents, read("topic_tags"), read("subscriptions"))),
        "sqs": ("queues", lambda parents: inventory.inventory_queues(parents, read("queue_tags"))),
    }
    documents = {}
    for kind, (name, scan) in scans.items():
        parents = read(name)
        if parents is not None:
            documents[kind] = scan(parents)
    if not documents:
        return None
    report = inventory.inventory_report(documents)
    if args.output_file:
        writers.write_inventory(report, args.output_file)
        return None
    return report


@command("clear-account", "results")
def clear_account(spark, args):
    """What would be removed; with the results of attempts, what failed in the last attempt and why."""
    if args.results:
        attempts = spark.read.schema(schemas.RESULTS).parquet(args.results)
        return inventory.failure_summary(inventory.last_attempt(attempts)).orderBy("type", "key")
    resources = _table(spark, args, "resources", schemas.RESOURCES)
    return inventory.cleanup_plan(resources).orderBy("step", "type", "region", "name")


@command("sls-remove", "name", "region")
def remove_stack(spark, args):
    stacks = _table(spark, args, "stacks", schemas.STACKS)
    owned = _table(spark, args, "stack_resources", schemas.STACK_RESOURCES)
    return tables.other_buckets(stacks, owned, args.region, args.name)


@command("powertune-lambda", "name", "region", "strategy", "weight", "power_values", "output_file")
def powertune(spark, args):
    schema = "region STRING, function_name STRING, memory_mb INT, duration_ms DOUBLE"
    measured = filters.scope(_table(spark, args, "measurements", schema), args.region, args.name)
    powers = None if args.power_values == "ALL" else [int(v) for v in args.power_values.split(",")]
    chosen = tuning.power_select(measured, args.strategy, args.weight, powers)
    if args.output_file:
        writers.write_result(chosen, args.output_file, "json")
    return chosen


@command("measure-lambda-cold-starts", "name", "region", "minutes", "hours", "days")
def measure_cold_starts(spark, args):
    logs = filters.scope(_table(spark, args, "logs", schemas.LOGS), args.region)
    recent = filters.lookback(logs, args.as_of, args.minutes, args.hours, args.days)
    total = cold_starts.cold_start_total(recent)
    return total if args.name is None else total.where(F.col("function_name") == args.name)


@command("list-versions")
def list_versions(spark, args):
    latest = versions.latest_version(_table(spark, args, "versions", schemas.VERSIONS))
    schema = "app STRING, tags MAP<STRING,STRING>, outputs MAP<STRING,STRING>"
    return versions.version_drift(latest, _table(spark, args, "app_stacks", schema))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="opsloom")
    commands = top.add_subparsers(dest="command", required=True)
    for name, (_, options) in COMMANDS.items():
        sub = commands.add_parser(name)
        sub.add_argument("--tables", default=".", help="folder of the landed tables")
        sub.add_argument("--as-of", type=datetime.fromisoformat, help="end of the time range, default now (UTC)")
        sub.add_argument("--rows", type=int, default=100, help="rows printed")
        for option in options:
            settings = dict(OPTIONS[option])
            sub.add_argument(*settings.pop("flags"), dest=DEST.get(option, option), **settings)
    return top


def run(spark: SparkSession, argv: list[str]) -> DataFrame | None:
    args = parser().parse_args(argv)
    args.as_of = args.as_of or datetime.now(timezone.utc).replace(tzinfo=None)
    return COMMANDS[args.command][0](spark, args)


def main(spark: SparkSession, argv: list[str]) -> None:
    result = run(spark, argv)
    if result is not None:
        writers.show_table(result, parser().parse_args(argv).rows)
