import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from opsloom import schemas
from opsloom.operators import cold_starts, distribution
from opsloom.operators.distribution import distribution_stats
from opsloom.plans.views import SCHEMAS
from opsloom.sources import filters
from opsloom.sources.logs import group_names, missing_groups, scan_logs

AS_OF = datetime(2024, 1, 31)
REPORT = (
    "REPORT RequestId: r1 Duration: 2.40 ms Billed Duration: 3 ms Memory Size: 128 MB "
    "Max Memory Used: 64 MB Init Duration: {} ms"
)


def log(name, message, minute=0, memory=128000000, region="us-east-1"):
    return (region, f"123:/aws/lambda/{name}", "s", datetime(2024, 1, 30, 23, minute), message, memory)


@pytest.fixture(scope="module")
def logs(spark):
    rows = [
        log("hello", REPORT.format(142.0)),
        log("hello", REPORT.format(251.0), 30),
        log("hello", REPORT.format(10.0), memory=256000000),
        log("hello", REPORT.format("9").replace("Init Duration", "init duration")),
        log("hello", "START RequestId: r1"),
        log("other", REPORT.format(7), region="eu-west-1"),
    ]
    return spark.createDataFrame(rows, schemas.LOGS)


def test_stats_count_lines_without_a_parsed_duration(spark, logs):
    rows = cold_starts.cold_start_stats(logs).where("function_name = 'hello'").orderBy("memory_mb").collect()
    assert [(r.memory_mb, r.cold_starts, r.median_init_ms, r.max_init_ms) for r in rows] == [
        (128.0, 3, 196.5, 251.0),
        (256.0, 1, 10.0, 10.0),
    ]
    assert rows[0].stddev_init_ms == pytest.approx(np.std([142, 251], ddof=1))
    assert rows[1].stddev_init_ms is None


def test_group_without_any_value_keeps_its_count(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1.0)], "k STRING, v DOUBLE")
    rows = {r.k: r for r in distribution_stats(df, ["k"], "v", "v").collect()}
    assert rows["a"].n == 2 and rows["a"].median_v is None and rows["a"].max_v is None
    assert rows["b"].n == 1 and rows["b"].p95_v == 1.0


@pytest.mark.parametrize("most_rows", [3, 1000, 1_000_000])
def test_percentiles_equal_brute_force_with_a_hot_group(spark, most_rows):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(40)}", round(rng.expovariate(0.02), 2)) for _ in range(6000)]
    df = spark.createDataFrame(rows, "k STRING, v DOUBLE")
    got = {r.k: r for r in distribution_stats(df, ["k"], "v", "v", most_rows=most_rows).collect()}
    assert len(got) == len({k for k, _ in rows})
    for key, r in got.items():
        values = np.array([v for k, v in rows if k == key])
        assert r.n == len(values)
        expected = np.percentile(values, [50, 75, 95])
        assert [r.median_v, r.p75_v, r.p95_v] == pytest.approx(list(expected))
        assert r.max_v == values.max()
        assert r.stddev_v == (pytest.approx(values.std(ddof=1)) if len(values) > 1 else None)


def test_deviation_of_large_close_values(spark):
    values = [1e7 + x / 1000 for x in range(50)]
    df = spark.createDataFrame([("k", v) for v in values], "k STRING, v DOUBLE")
    got = distribution_stats(df, ["k"], "v", "v").first().stddev_v
    assert got == pytest.approx(np.std(values, ddof=1), rel=1e-6)


def test_text_that_is_no_number_is_no_duration(spark):
    rows = [log("f", REPORT.format(x)) for x in ("NaN", "Infinity", "x", "5.5")]
    row = cold_starts.cold_start_stats(spark.createDataFrame(rows, schemas.LOGS)).first()
    assert (row.cold_starts, row.median_init_ms, row.max_init_ms) == (4, 5.5, 5.5)


def test_percentiles_of_close_values(spark):
    """One group, all values inside one unit, and windows of a thousand rows."""
    df = spark.range(300_000).select(F.lit("k").alias("k"), F.rand(3).alias("v"))
    values = np.array([r.v for r in df.collect()])
    got = distribution_stats(df, ["k"], "v", "v", most_rows=1000).first()
    assert [got.median_v, got.p75_v, got.p95_v] == pytest.approx(list(np.percentile(values, [50, 75, 95])), rel=1e-15)
    assert (got.n, got.max_v) == (300_000, values.max())
    assert got.stddev_v == pytest.approx(values.std(ddof=1))


ODD = {
    "far": [-1e300, 1e300, 5e-324, 0.0, -0.0, 1e-200, -1e-200, 3.0, 1e17, 1e17 + 16],
    "ends": [float("inf"), float("-inf"), 1.0, 2.0, 1.7e308, -1.7e308],
    "same": [4.25] * 40 + [4.250000000000001, 4.25, 4.24],
    "nan": [float("nan"), 1.0, 2.0, 3.0],
    "null": [None, None, 7.5],
    "two": [1.0, 1.0000000000000002],
    None: [1.0, 2.0],
}


@pytest.mark.parametrize("most_rows", [1, 5, 1000])
def test_percentiles_of_odd_values(spark, most_rows):
    rows = [(k, v) for k, values in ODD.items() for v in values]
    df = spark.createDataFrame(rows, "k STRING, v DOUBLE").repartition(3)
    got = {r.k: r for r in distribution_stats(df, ["k"], "v", "v", most_rows=most_rows).collect()}
    assert set(got) == set(ODD)
    for key, values in ODD.items():
        known = sorted((v for v in values if v is not None), key=lambda v: (v != v, v))
        assert got[key].n == len(values)
        for p, name in ((0.5, "median_v"), (0.75, "p75_v"), (0.95, "p95_v")):
            place = p * (len(known) - 1)
            lo, hi = known[int(np.floor(place))], known[int(np.ceil(place))]
            expected = lo if lo == hi else lo + (hi - lo) * (place - np.floor(place))
            assert got[key][name] == pytest.approx(expected, nan_ok=True, rel=1e-15)


def test_first_ranges_grow_with_the_value_and_are_few(spark):
    rng = random.Random(1)
    values = sorted(rng.choice([-1, 1]) * rng.random() * 10 ** rng.uniform(-320, 308) for _ in range(20_000))
    df = spark.createDataFrame([(v,) for v in [float("-inf"), *values, float("inf"), float("nan")]], "v DOUBLE").coalesce(1)
    codes = [r[0] for r in df.select(distribution._first_range("v")).collect()]
    assert codes == sorted(codes)
    assert codes[-1] - codes[0] < distribution.FIRST_RANGES


def test_approximate_statistics(spark, logs):
    row = cold_starts.cold_start_stats(logs, exact=False).where("memory_mb = 256").first()
    assert row.cold_starts == 1 and row.median_init_ms == 10.0


def test_total_adds_run_and_init_duration(spark, logs):
    row = cold_starts.cold_start_total(logs).where("memory_mb = 256").first()
    assert row.median_total_ms == pytest.approx(12.4)


def test_report_keeps_unmatched_functions(spark, logs):
    functions = spark.createDataFrame(
        [("us-east-1", n, "nodejs10.x", 512, 1024, AS_OF, 6) for n in ("hello", "idle")], schemas.FUNCTIONS
    )
    configs = spark.createDataFrame([("us-east-1", "hello", "live", 5), ("us-east-1", "hello", "beta", 2)],
                                    "region STRING, function_name STRING, qualifier STRING, allocated BIGINT")
    points = [
        ("us-east-1", "AWS/Lambda", "ProvisionedConcurrencyUtilization",
         {"FunctionName": "hello", "Resource": f"hello:{q}"}, datetime(2024, 1, 30, 23, 30), v)
        for q, v in (("live", 0.4), ("live", 0.6), ("gone", 0.9))
    ]
    metrics = spark.createDataFrame(points, schemas.METRICS)
    assert cold_starts.pc_totals(configs).first().provisioned_concurrency == 7
    pc = cold_starts.pc_report(configs, cold_starts.qualifier_utilisation(metrics, AS_OF))
    report = cold_starts.cold_start_report(functions, cold_starts.cold_start_stats(logs), pc)
    rows = cold_starts.order_report(report).collect()
    assert [(r.function_name, r.memory_size, r.cold_starts) for r in rows] == [
        ("hello", 128.0, 3),
        ("hello", 256.0, 1),
        ("idle", 512.0, None),
    ]
    assert (rows[0].provisioned_concurrency, rows[0].pc_utilisation) == (7, 0.6)
    assert (rows[2].provisioned_concurrency, rows[2].pc_utilisation) == (0, 0.0)


def test_missing_group_is_named_and_the_rest_is_read(spark, logs):
    groups = spark.createDataFrame(
        [("us-east-1", "/aws/lambda/hello"), ("us-east-1", "/aws/lambda/example")], "region STRING, log_group STRING"
    )
    assert [r.log_group for r in missing_groups(groups, group_names(logs)).collect()] == ["/aws/lambda/example"]
    assert scan_logs(logs, "2024-01-01", "2024-01-31", groups).count() == 5


def test_windows():
    assert filters.window_minutes(days=6) == 8640
    assert filters.window_minutes(hours=2) == 120
    assert filters.window_minutes() == 60
    with pytest.raises(ValueError):
        filters.window_minutes(hours=1, days=1)


def test_lookback_and_scope(spark, logs):
    assert filters.lookback(logs, AS_OF).count() == 6
    assert filters.lookback(logs, AS_OF, minutes=40).count() == 1
    assert filters.scope(logs, "eu-west-1").count() == 1
    with pytest.raises(ValueError):
        filters.scope(logs, name="hello")


def test_time_range_reaches_the_scan(spark, logs, tmp_path):
    logs.write.parquet(str(tmp_path / "logs"))
    df = filters.lookback(spark.read.parquet(str(tmp_path / "logs")), AS_OF).select(F.col("message"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "ReadSchema: struct<ts:timestamp,message:string>" in plan


def test_only_the_days_and_region_of_the_range_are_read(spark, logs, tmp_path):
    path = str(tmp_path / "logs")
    days = logs.unionByName(logs.withColumn("ts", F.col("ts") - F.expr("INTERVAL 5 DAYS")))
    days.withColumn("date", F.to_date("ts")).write.partitionBy("region", "date").parquet(path)
    table = spark.read.schema(schemas.LOGS).parquet(path)
    df = filters.scope(filters.lookback(table, AS_OF), "us-east-1")
    assert df.count() == 5
    plan = df._jdf.queryExecution().executedPlan().toString()
    filters_shown = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "date" in filters_shown and "region" in filters_shown


def test_missing_groups_follow_from_the_logs(spark, tmp_path):
    """Every third function has a line in the logs, the others are missing, whatever their keys are."""
    for name, rows in {
        "region": [(i, f"R{i}") for i in range(5)],
        "customer": [(i, f"Customer#{i:09d}", 0, 1.0, "BUILDING") for i in range(21)],
        "events": [(i, datetime(2024, 1, 1 + i), i, "view", 1.0, "{}") for i in range(0, 21, 3)],
    }.items():
        spark.createDataFrame(rows, SCHEMAS[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    got = contract.queries()["missing_log_groups"](spark, str(tmp_path)).collect()
    wanted = [(f"R{i % 5}", f"/aws/lambda/Customer#{i:09d}") for i in range(21) if i % 3]
    assert sorted((r.region, r.log_group) for r in got) == sorted(wanted)
