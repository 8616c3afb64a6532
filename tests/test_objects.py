import bz2
import gzip
import json

import pytest

from opsloom.operators.objects import query_objects, select_objects
from opsloom.sinks.writers import output_format, write_inventory, write_result
from opsloom.sources.objects import object_totals, read_objects, scan_objects

RECORDS = [{"id": 1}, {"id": 2}, {"id": 3}]


def write(folder, name, data, opener=open):
    folder.mkdir(parents=True, exist_ok=True)
    with opener(str(folder / name), "wb") as f:
        f.write(data.encode())


@pytest.fixture()
def prefix(tmp_path):
    for name in ("object1", "object2"):
        write(tmp_path / "my-folder", f"{name}.json", json.dumps(RECORDS))
    return f"{tmp_path}/my-folder/"


def test_limit_counts_per_object(spark, prefix):
    records = read_objects(spark, prefix, "JSON", numbered=True)
    assert records.count() == 6
    one = select_objects(records, columns=["id", "object"], limit=1, order=["object_row"])
    assert [r.id for r in one.collect()] == [1, 1]
    assert select_objects(records, columns=["id"], limit=1, scope="dataset").count() == 1


def test_aggregates_per_object(spark, prefix):
    records = read_objects(spark, prefix, "JSON")
    rows = select_objects(records, aggs=["count(*) AS n", "sum(id) AS s"]).collect()
    assert [(r.n, r.s) for r in rows] == [(3, 6), (3, 6)]
    none = select_objects(records, where="id > 5", aggs=["count(*) AS n", "max(id) AS m"]).collect()
    assert [(r.n, r.m) for r in none] == [(0, None), (0, None)]
    assert select_objects(records, aggs=["count(*) AS n"], scope="dataset").first().n == 6


def test_sql_over_all_objects(spark, prefix):
    records = read_objects(spark, prefix, "JSON")
    text = "SELECT s.id FROM s3object s WHERE s.id > 1 LIMIT 3"
    assert query_objects(spark, records, text, scope="dataset").count() == 3


@pytest.mark.parametrize(
    "text, expected",
    [
        ("select * from s3object limit 1", 2),
        ("SELECT s.id FROM s3object s WHERE s.id > 1 ORDER BY s.id LIMIT 1", 2),
        ("SELECT id FROM s3object WHERE id > 1", 4),
        ("SELECT count(*) AS n FROM s3object WHERE id > 7", 2),
    ],
)
def test_sql_for_each_object(spark, prefix, text, expected):
    rows = query_objects(spark, read_objects(spark, prefix, "JSON"), text).collect()
    assert len(rows) == expected and len({r.object for r in rows}) == 2
    if "count" in text:
        assert [r.n for r in rows] == [0, 0]


def test_totals_and_partial_prefix(spark, prefix):
    assert tuple(object_totals(scan_objects(spark, prefix)).first()) == (2, 2 * len(json.dumps(RECORDS)))
    assert tuple(object_totals(scan_objects(spark, prefix + "object1")).first())[0] == 1
    assert read_objects(spark, prefix + "object2", "JSON").count() == 3


def test_no_objects(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    for path in (f"{tmp_path}/empty/", f"{tmp_path}/absent/"):
        for kind in ("JSON", "CSV", "Parquet"):
            assert read_objects(spark, path, kind).count() == 0
    assert tuple(object_totals(scan_objects(spark, f"{tmp_path}/absent/")).first()) == (0, 0)


def test_json_lines(spark, tmp_path):
    write(tmp_path / "l", "a.json", "\n".join(json.dumps(r) for r in RECORDS))
    assert read_objects(spark, f"{tmp_path}/l/", "JSON", {"Type": "LINES"}).count() == 3


def test_csv_headers_and_delimiter(spark, tmp_path):
    write(tmp_path / "c", "a.csv", "id;name\n1;x\n2;y\n")
    path = f"{tmp_path}/c/"
    used = read_objects(spark, path, "CSV", {"FileHeaderInfo": "USE", "FieldDelimiter": ";"})
    assert [r.name for r in used.orderBy("id").collect()] == ["x", "y"]
    ignored = read_objects(spark, path, "CSV", {"FileHeaderInfo": "IGNORE", "FieldDelimiter": ";"})
    assert sorted(r._2 for r in ignored.collect()) == ["x", "y"]
    assert read_objects(spark, path, "CSV", {"FieldDelimiter": ";"}).count() == 3


def test_compression(spark, tmp_path):
    text = "\n".join(json.dumps(r) for r in RECORDS)
    write(tmp_path / "z", "a.json.gz", text, gzip.open)
    write(tmp_path / "z", "b.json.bz2", text, bz2.open)
    path = f"{tmp_path}/z/"
    for kind in ("GZIP", "BZIP2"):
        assert read_objects(spark, path, "JSON", {"Type": "LINES"}, compression=kind).count() == 3
    with pytest.raises(ValueError):
        read_objects(spark, path, "JSON", compression="ZIP")


def test_unreadable_object_is_skipped(spark, tmp_path):
    spark.createDataFrame([(1,), (2,)], "id BIGINT").coalesce(1).write.parquet(str(tmp_path / "p"))
    write(tmp_path / "p", "broken.parquet", "this is no parquet file at all, but long enough")
    records = read_objects(spark, f"{tmp_path}/p/", "Parquet", schema="id BIGINT")
    assert sorted(r.id for r in records.collect()) == [1, 2]


def test_only_needed_columns_are_read(spark, tmp_path):
    spark.range(5).selectExpr("id", "id * 2 AS twice", "id * 3 AS more").write.parquet(str(tmp_path / "w"))
    records = read_objects(spark, f"{tmp_path}/w/", "Parquet", numbered=True)
    picked = select_objects(records, columns=["id"], where="twice > 2", limit=2, order=["object_row"])
    assert picked.count() >= 2
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(twice,2)" in plan and "more" not in plan


def test_output(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id BIGINT, name STRING")
    write_result(df, str(tmp_path / "j"), output_format("Parquet"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    write_result(df, str(tmp_path / "c"), "csv", {"FieldDelimiter": "|", "QuoteFields": "ALWAYS"}, single_file=True)
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "c")).collect())
    assert lines == ['"1"|"a"', '"2"|"b"']
    with pytest.raises(ValueError):
        write_result(df, str(tmp_path / "x"), "xml")
    write_inventory(
        spark.createDataFrame([("sns", "r", "{}"), ("sqs", "r", "{}")], "type STRING, region STRING, document STRING"),
        str(tmp_path / "inv"),
    )
    assert spark.read.text(str(tmp_path / "inv")).where("type = 'sns'").count() == 1
