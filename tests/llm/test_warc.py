import base64
import glob
import gzip
import hashlib
import random

from opsloom.llm import warc
from opsloom.llm.shared import shared_folder

PAGES = "page_id bigint, url string, html string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def made_rows():
    rng = random.Random(1)
    rows = []
    for i in range(60):
        parts = ["é\U0001f600x", "\r\n\r\nWARC/1.1\r\n", "Content-Length: 5\r\n\r\n", "\n", "plain text ", "\r"]
        rows.append((i, f"http://a/{i}", "".join(rng.choice(parts) for _ in range(rng.randrange(0, 60)))))
    rows += [(100 + i, "http://copy", rows[3][2]) for i in range(5)]
    return [*rows, (200, None, None), (201, "u\r\nX: y", ""), (202, "long", "0123456789é" * 40_000)]


def test_round_trip_with_chunks_of_a_few_bytes(spark):
    rows = made_rows()
    pages = spark.createDataFrame(rows, PAGES).repartition(4)
    path = shared_folder(spark, "warc-test")
    got = {r["page_id"]: r for r in warc.archived(pages, path, size=64, per_file=10).collect()}
    assert len(got) == len(rows)
    last = {}
    for i, _, html in rows:
        last[digest(html)] = max(i, last.get(digest(html), -1))
    for i, _, html in rows:
        first = last[digest(html)]
        expected = (len((html or "").encode()), digest(html), "response" if first == i else "revisit", None if first == i else first, True)
        assert tuple(got[i])[2:] == expected, i


def test_chunks_are_bounded_and_carry_the_digest(spark):
    rows = made_rows()
    pages = spark.createDataFrame(rows, PAGES).selectExpr("cast(page_id as string) AS record_id", "url", "cast(html as binary) AS payload")
    chunks = warc.chunk_table(pages, 64).collect()
    whole = {}
    for c in sorted(chunks, key=lambda c: (c["record_id"], c["chunk_no"])):
        assert len(c["chunk"]) <= 64
        whole[c["record_id"]] = whole.get(c["record_id"], b"") + bytes(c["chunk"])
        if c["last"]:
            assert c["digest"] == base64.b32encode(hashlib.sha1(whole[c["record_id"]]).digest()).decode()
            assert c["bytes_so_far"] == len(whole[c["record_id"]])
    assert whole == {str(i): (html or "").encode() for i, _, html in rows}


def test_files_are_warc(spark):
    path = shared_folder(spark, "warc-test")
    pages = spark.createDataFrame([(1, "http://a", "abc"), (2, "http://b", "abc")], PAGES)
    warc.archived(pages, path).count()
    raw = b"".join(gzip.open(f).read() for f in sorted(glob.glob(path.removeprefix("file://") + "/*.gz")))
    records = raw.split(b"WARC/1.1\r\n")[1:]
    assert len(records) == 2 and all(r.endswith(b"\r\n\r\n") for r in records)
    response = next(r for r in records if b"WARC-Type: response" in r)
    assert b"Content-Length: 3\r\n\r\nabc\r\n\r\n" in response
    assert f"WARC-Payload-Digest: sha1:{digest('abc')}".encode() in response
    assert any(b"WARC-Type: revisit" in r and b"WARC-Refers-To: <urn:record:2:" in r for r in records)


def test_segments_in_other_files_are_found(spark):
    path = shared_folder(spark, "warc-test")
    whole = ["ab" * 50 + "\n", "second", "third\r\n"]
    files = []
    for i, part in enumerate(whole):
        head = f"WARC/1.1\r\nWARC-Type: {'continuation' if i else 'response'}\r\nWARC-Record-ID: <urn:record:{'r' if not i else i}>\r\n"
        head += f"WARC-Segment-Number: {i + 1}\r\n" + ("WARC-Segment-Origin-ID: <urn:record:r>\r\n" if i else "")
        head += f"WARC-Segment-Total-Length: {len(''.join(whole))}\r\n" if i == 2 else ""
        files.append((i, f"{head}Content-Length: {len(part)}\r\n\r\n{part}\r\n\r"))
    spark.createDataFrame(files, "i int, value string").repartition(3, "i").sortWithinPartitions("i").select("value").write.option("compression", "gzip").text(path)
    row = warc.read_records(spark, path, 16).collect()
    assert [(r["record_id"], r["n_bytes"], r["read_digest"]) for r in row] == [("r", len("".join(whole)), digest("".join(whole)))]


def test_least_size_and_odd_rows(spark):
    rows = [(1, "a", "x"), (2, "a", "x"), (2, "a", "x"), (2, "b", "x"), (None, None, None), (None, None, "x"), (3, "a", "yyyy"), (4, "a", "yyyy")]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "'own' AS record_id", "1 AS chunk_no")
    got = warc.archived(pages, shared_folder(spark, "warc-test"), least_bytes=2).collect()
    assert len(got) == 7  # rows that repeat are one record
    kinds = sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"])) for r in got)
    assert ("3", "revisit", "4") in kinds and sum(k[1] == "revisit" for k in kinds) == 1
    empty = warc.archived(pages.limit(0), shared_folder(spark, "warc-test"))
    assert empty.count() == 0
