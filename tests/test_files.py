"""Listing and reading of files as they lie, with error rows; lines known by the byte they begin at."""

import bz2
import glob
import gzip
import json
import pathlib
import random
import tempfile
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from opsloom.commands import run
from opsloom.operators.objects import query_objects, select_objects
from opsloom.operators.packing import pack_batches
from opsloom.plans.landing import land_texts, part_name
from opsloom.sources import files, lines
from opsloom.sources.files import list_files, read_lines, read_records

NAMES = ["a.json", "_hidden.json", ".dot.json", "b[1]{x}*.json", "sp ace%41.json", "deep/er/_c/d.json", "deep/é.json", "empty.json"]


@pytest.fixture()
def folder(tmp_path):
    for name in NAMES:
        file = tmp_path / "in" / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(b"" if name == "empty.json" else json.dumps({"name": name}).encode() + b"\n")
    (tmp_path / "in2").mkdir()
    (tmp_path / "in2" / "other.json").write_text("{}")
    return str(tmp_path)


def names(found, base):
    return sorted(r["path"].removeprefix(f"file://{base}/") for r in found.collect())


def test_every_file_is_listed(spark, folder):
    found, errors = list_files(spark, f"{folder}/in/")
    assert names(found, f"{folder}/in") == sorted(NAMES)
    assert errors.count() == 0
    sizes = {r["path"].rsplit("/", 1)[-1]: r["size"] for r in found.collect()}
    assert sizes["empty.json"] == 0 and sizes["a.json"] == 19
    assert found.where("modified IS NULL").count() == 0


def test_a_prefix_need_not_end_at_a_folder(spark, folder):
    assert names(list_files(spark, f"file://{folder}/in")[0], folder) == sorted([f"in/{n}" for n in NAMES] + ["in2/other.json"])
    assert names(list_files(spark, f"{folder}/in/b[")[0], f"{folder}/in") == ["b[1]{x}*.json"]
    assert names(list_files(spark, f"{folder}/in/*")[0], folder) == []
    assert names(list_files(spark, f"{folder}/none/")[0], folder) == []


def test_records_of_every_file(spark, folder):
    found, _ = list_files(spark, f"{folder}/in/")
    records, errors = read_records(spark, found, "JSON")
    assert sorted(r["name"] for r in records.collect()) == sorted(set(NAMES) - {"empty.json"})
    assert all(r["object"].endswith(r["name"]) for r in records.collect())
    assert errors.count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_lines_do_not_depend_on_the_split(spark, tmp_path, seed):
    rng = random.Random(seed)
    content = b"".join(
        rng.choice([b"", b"x", b"\xc3\xa9" * rng.randrange(30), b"a" * rng.randrange(200), b"\xff"]) + rng.choice([b"\n", b"\r\n"])
        for _ in range(300)
    )
    content += rng.choice([b"", b"last", b"\r"])
    (tmp_path / "t.txt").write_bytes(content)
    found, _ = list_files(spark, f"{tmp_path}/t.txt")
    expected, at = [], 0
    for line in content.split(b"\n"):
        if at < len(content):
            expected.append((at, line.removesuffix(b"\r").decode("utf-8", "replace")))
        at += len(line) + 1
    for split in (97, 1000, 1 << 20) if seed else (400,):
        rows = read_lines(found, split).collect()
        assert sorted((r["offset"], r["line"]) for r in rows) == expected
    local = f"{tmp_path}/t.txt"
    for split in (1, 2, 7, 64):
        parts = [x for at in range(0, len(content), split) for x in files._text_lines(local, at, at + split)]
        assert parts == expected


def test_long_lines_and_small_reads(tmp_path, monkeypatch):
    monkeypatch.setattr(files, "_READ", 10)
    (tmp_path / "t").write_bytes(b"ab\n" + b"c" * 95 + b"\nde\n\nf")
    whole = [(0, b"ab"), (3, b"c" * 95), (99, b"de"), (102, b""), (103, b"f")]
    assert list(files._range_lines(str(tmp_path / "t"), 0, None)) == whole
    for cut in range(1, 105):
        parts = [*files._range_lines(str(tmp_path / "t"), 0, cut), *files._range_lines(str(tmp_path / "t"), cut, 200)]
        assert parts == whole


def test_small_ranges_do_not_make_more_tasks(spark, tmp_path):
    content = b"".join(b"line %d\n" % i * (i % 4) + b"\n" * (i % 3) for i in range(3000))
    (tmp_path / "t.txt").write_bytes(content)
    found, _ = list_files(spark, f"{tmp_path}/t.txt")
    rows = read_lines(found, 16)
    assert rows.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism < len(content) // 16
    whole = read_lines(found, 1 << 20).collect()
    assert sorted(rows.collect(), key=lambda r: r["offset"]) == sorted(whole, key=lambda r: r["offset"])


def test_a_stretch_of_ranges_in_more_than_one_task(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "TASK_BYTES", 100)
    content = b"".join(b"%d\r\n" % i * (i % 5) for i in range(400)) + b"x" * 250 + b"\nend"
    (tmp_path / "t.txt").write_bytes(content)
    found, _ = list_files(spark, f"{tmp_path}/t.txt")
    whole = [(at, line.decode()) for at, line in files._range_lines(f"{tmp_path}/t.txt", 0, None)]
    for split in (7, 30, 100, 101):
        rows = read_lines(found, split)
        assert rows.rdd.getNumPartitions() > 1
        assert sorted((r["offset"], r["line"]) for r in rows.collect()) == whole


def test_a_range_reads_little_more_than_it_has(tmp_path, monkeypatch):
    read = []

    class Counting:
        def __init__(self, source):
            self.source = source

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.source.close()

        def seek(self, at):
            self.source.seek(at)

        def read(self, n):
            read.append(len(block := self.source.read(n)))
            return block

    class System:
        open_input_file = staticmethod(lambda path: Counting(open(path, "rb")))

    (tmp_path / "t").write_bytes(b"ab\n" * 40000 + b"c" * 600000 + b"\n" + b"de\n" * 100)
    monkeypatch.setattr(files, "opened", lambda path: (System, path))
    for start in (0, 30000, 300000):  # short lines, and inside of the long line
        read.clear()
        found = [*files._range_lines(f"{tmp_path}/t", start, start + 1000)]
        assert len(found) == (0 if start == 300000 else 334)
        assert sum(read) <= 1000 + 2 * files._BEHIND


def test_landing_leaves_no_shuffled_texts(spark, tmp_path):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.sparkContext._jvm.System.gc()
    blocks = lambda: {str(p) for d in glob.glob(f"{tempfile.gettempdir()}/blockmgr-*") for p in pathlib.Path(d).rglob("shuffle_*.data")}
    earlier = blocks()
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.repeat(F.lit("text "), 50).alias("text"))
    land_texts(docs, f"{tmp_path}/t")
    until = time.time() + 20
    while blocks() - earlier and time.time() < until:
        time.sleep(0.2)
    assert not blocks() - earlier and spark.conf.get(key) == before
    assert lines.scan_lines(spark, f"{tmp_path}/t").groupBy(part_name("file").alias("f")).count().count() == 12


def test_names_of_landed_parts(spark):
    texts = {"/t/source=a/part=1/part-0.txt": "source=a/1", "source=b/part=12/x": "source=b/12", "/t/part=1a/x": "x", "part=1/y": "y", "//part=1/f": "f", "/t/s/part=3/u/z": "z"}
    rows = spark.createDataFrame([(p,) for p in texts], "file STRING")
    assert {r["file"]: r["name"] for r in rows.select("file", part_name("file").alias("name")).collect()} == texts


def test_files_that_break_off_give_what_is_there_and_an_error(spark, tmp_path):
    good = b"".join(b'{"id": %d}\n' % i for i in range(2000))
    (tmp_path / "a.json.gz").write_bytes(gzip.compress(good))
    (tmp_path / "b.json.gz").write_bytes(gzip.compress(random.Random(1).randbytes(0) + good)[:-300])
    (tmp_path / "c.json.gz").write_bytes(b"not zipped")
    (tmp_path / "d.json.bz2").write_bytes(bz2.compress(good))
    (tmp_path / "e.json").write_bytes(b'{"id": 1}\n{"id": \n\n{"id": 3}\n')
    found, _ = list_files(spark, f"{tmp_path}/")
    records, errors = read_records(spark, found, "JSON", {"Type": "LINES"}, schema="id BIGINT")
    counts = {r["object"].rsplit("/", 1)[-1]: r["count"] for r in records.groupBy("object").count().collect()}
    assert counts["a.json.gz"] == counts["d.json.bz2"] == 2000 and counts["e.json"] == 2
    assert counts.get("b.json.gz", 0) < 2000 and "c.json.gz" not in counts
    wrong = {r["object"].rsplit("/", 1)[-1]: (r["object_row"], r["error"]) for r in errors.collect()}
    assert set(wrong) == {"b.json.gz", "c.json.gz", "e.json"}
    assert wrong["e.json"] == (10, "malformed JSON")
    only, _ = read_records(spark, found, "JSON", {"Type": "LINES"}, "BZIP2", "id BIGINT")
    assert only.count() == 2000


def test_json_documents_of_a_file(spark, tmp_path, monkeypatch):
    text = '{"a": 1, "b": {"c": [1, 2]}}\n {"a": 2}{"a": 3.5}\n[{"a": 4}, {"a": 5}]\n  {"a": "é\\n]"} [] 7'
    (tmp_path / "x.json").write_text(text)
    for size in (1, 3, 1 << 20):
        monkeypatch.setattr(files, "_READ", size)
        found = [json.loads(t) for _, t in files._json_documents(str(tmp_path / "x.json"), 0, None)]
        assert found == [{"a": 1, "b": {"c": [1, 2]}}, {"a": 2}, {"a": 3.5}, {"a": 4}, {"a": 5}, {"a": "é\n]"}, 7]
    monkeypatch.undo()
    (tmp_path / "x.json").write_text('{"a": 1}{"a": ')
    (tmp_path / "y.json").write_text('[{"a": 2, "z": null}')
    found, _ = list_files(spark, f"{tmp_path}/")
    records, errors = read_records(spark, found, "JSON")
    assert sorted((r["a"], r["object_row"]) for r in records.collect()) == [(1, 0), (2, 0)]
    assert errors.count() == 2


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id;n\n# no\n1;"x;""y"""\n2;z;more\n')
    (tmp_path / "b.csv").write_text("id;n\n3;\n")
    found, _ = list_files(spark, f"{tmp_path}/")
    config = {"FieldDelimiter": ";", "Comments": "#", "FileHeaderInfo": "USE"}
    records, errors = read_records(spark, found, "CSV", config)
    assert sorted((r["id"], r["n"]) for r in records.collect()) == [("1", 'x;"y"'), ("2", "z"), ("3", "")]
    typed, _ = read_records(spark, found, "CSV", config, schema="n STRING, id INT", split_bytes=3)
    assert sorted((r["id"], r["n"]) for r in typed.collect()) == [(1, 'x;"y"'), (2, "z"), (3, "")]
    placed, _ = read_records(spark, found, "CSV", {**config, "FileHeaderInfo": "NONE"})
    assert placed.columns == ["_1", "_2", "_3", "object", "object_row"] and placed.count() == 5
    assert errors.count() == 0
    (tmp_path / "b.csv").write_text("other;n\n")
    with pytest.raises(ValueError):
        read_records(spark, found, "CSV", config)


def test_csv_with_other_ends_of_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text('1,"two\nlines"\n3,x\n')
    found, _ = list_files(spark, f"{tmp_path}/a")
    records, _ = read_records(spark, found, "CSV", {"AllowQuotedRecordDelimiter": "TRUE"}, split_bytes=4)
    assert sorted((r["_1"], r["_2"]) for r in records.collect()) == [("1", "two\nlines"), ("3", "x")]
    (tmp_path / "b.csv").write_text("1,a|2,b|3,c")
    found, _ = list_files(spark, f"{tmp_path}/b")
    records, _ = read_records(spark, found, "CSV", {"RecordDelimiter": "|"})
    assert sorted((r["_1"], r["_2"]) for r in records.collect()) == [("1", "a"), ("2", "b"), ("3", "c")]


def test_parquet(spark, tmp_path):
    table = pa.table({"id": [1, 2, 3], "object": ["x", "y", None]})
    pq.write_table(table, tmp_path / "_a.parquet", row_group_size=2)
    pq.write_table(table.select(["id"]), tmp_path / "b.parquet")
    whole = (tmp_path / "_a.parquet").read_bytes()
    (tmp_path / "c.parquet").write_bytes(whole[:-9])
    found, _ = list_files(spark, f"{tmp_path}/")
    records, errors = read_records(spark, found, "Parquet")
    rows = sorted((r["_object"].rsplit("/", 1)[-1], r["object_row"], r["id"], r["object"]) for r in records.collect())
    assert rows == [("_a.parquet", 0, 1, "x"), ("_a.parquet", 1, 2, "y"), ("_a.parquet", 2, 3, None)] + [("b.parquet", i, i + 1, None) for i in range(3)]
    assert [r["object"].rsplit("/", 1)[-1] for r in errors.collect()] == ["c.parquet"]
    with pytest.raises(ValueError):
        read_records(spark, found, "ORC")


def test_answers_of_objects_without_records(spark, folder):
    found, _ = list_files(spark, f"{folder}/in/")
    records, _ = read_records(spark, found, "JSON")
    every = found.select(F.col("path").alias("object"))
    for text in ("SELECT count(*) AS n FROM s3object", "/* c */ -- d\nwith t AS (SELECT * FROM s3object) SELECT count(*) AS n FROM t"):
        got = query_objects(spark, records.drop("object_row"), text, objects=every).collect()
        assert sorted(r["n"] for r in got) == [0] + [1] * 7
    got = select_objects(records, aggs=["count(*) AS n", "max(name) AS m"], objects=every).collect()
    assert sorted(r["n"] for r in got) == [0] + [1] * 7
    named = records.withColumnRenamed("object", "_object").withColumn("object", F.lit("own"))
    got = query_objects(spark, named, "SELECT object FROM s3object", object_column="_object").collect()
    assert {r["object"] for r in got} == {"own"} and len({r["_object"] for r in got}) == 7


def test_command_says_what_was_not_read(spark, folder, capsys):
    with open(f"{folder}/in/bad.json", "w") as out:
        out.write('{"name": "good"} {"na')
    found = run(spark, ["s3-select-batch", "-x", f"{folder}/in/", "-f", "JSON", "--aggs", "count(*) AS n"])
    assert sorted(r["n"] for r in found.collect()) == [0] + [1] * 8
    assert "not read: file://" in capsys.readouterr().out


def test_scan_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("one\n\ntwo\n" + "".join(f"line {i}\n" for i in range(500)))
    (tmp_path / "in" / "_mark").write_text("hidden\n")
    (tmp_path / "in2").write_text("other\n")
    rows = lines.scan_lines(spark, f"{tmp_path}/in", split_bytes=50)
    assert rows.count() == 502
    assert [(r["pos"], r["line"]) for r in rows.orderBy("pos").limit(2).collect()] == [(0, "one"), (5, "two")]
    ids = {r["entry_id"]: r["batch_id"] for r in pack_batches(rows).collect()}
    again = pack_batches(lines.scan_lines(spark, f"{tmp_path}/in")).collect()
    assert ids == {r["entry_id"]: r["batch_id"] for r in again} and len(ids) == 502
    assert lines.scan_lines(spark, f"{tmp_path}/in2").count() == 1
    assert lines.scan_lines(spark, f"{tmp_path}/in/_mark").count() == 1
    with pytest.raises(FileNotFoundError):
        lines.scan_lines(spark, f"{tmp_path}/none")
    (tmp_path / "in" / "b.gz").write_bytes(b"broken")
    with pytest.raises(lines.Unreadable):
        lines.scan_lines(spark, f"{tmp_path}/in")
