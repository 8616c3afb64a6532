"""WARC archives as a table of chunks: payloads are written and read in pieces of bounded size.

A payload is a run of rows (record, chunk number, chunk). The digest of a payload is carried from chunk to chunk,
so no task builds a record as a whole. Written, each chunk of a large payload is a record of its own, as the
format has it: the first one carries the headers of the record, the others are of type ``continuation`` with
``WARC-Segment-Number`` and ``WARC-Segment-Origin-ID``, the last one tells the total length. Of records with
equal payloads one is a response, the others are revisits without a payload.

Archives are written by Spark's text writer, a row per line of the archive, compressed (``.gz``), so that
a file is read by one task in order; ``per_file`` bounds how many records a file gets. The reader goes by
Content-Length, not by what a payload looks like, and passes on at most ``CHUNK`` bytes at a time.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm.shared import stored

#: Bytes of a chunk, a little less where it would end inside a character.
CHUNK = 1 << 16
PER_FILE = 2000
VERSION = "WARC/1.1"
_DATE = "1970-01-01T00:00:00Z"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def _cuts(payload: memoryview, size: int) -> Iterator[memoryview]:
    """Pieces of at most ``size`` bytes that end between characters; one empty piece for an empty payload."""
    first = 0
    while True:
        last = min(first + size, len(payload))
        while first < last < len(payload) and payload[last] & 0xC0 == 0x80:
            last -= 1
        yield payload[first:last]
        first = last
        if first >= len(payload):
            return


def _chunked(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls = batch.column("record_id").to_pylist(), batch.column("url").to_pylist()
            payloads = batch.column("payload")
            rows: list[tuple] = []
            held = 0
            for i, record in enumerate(ids):
                buffer = payloads[i].as_buffer()
                sha, total = hashlib.sha1(), 0
                pieces = _cuts(memoryview(buffer) if buffer is not None else memoryview(b""), size)
                piece = next(pieces)
                number = 0
                while piece is not None:
                    following = next(pieces, None)
                    sha.update(piece)
                    total += len(piece)
                    last = following is None
                    rows.append(
                        (record, urls[i], number, bytes(piece), last, total, base32(sha.digest()) if last else None)
                    )
                    held += len(piece)
                    number += 1
                    piece = following
                    if held >= 64 * size:
                        yield _table(rows)
                        rows, held = [], 0
            yield _table(rows)

    def _table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int32(), pa.binary(), pa.bool_(), pa.int64(), pa.string()]
        names = ["record_id", "url", "chunk_no", "chunk", "last", "bytes_so_far", "digest"]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def chunk_table(records: DataFrame, size: int = CHUNK) -> DataFrame:
    """(record_id, url, chunk_no, chunk, last, bytes_so_far, digest) of records (record_id, url, payload binary).

    The last chunk of a record carries the SHA-1 of the whole payload, in base32. A null payload is empty.
    """
    return records.select("record_id", "url", "payload").mapInArrow(
        _chunked(size),
        "record_id string, url string, chunk_no int, chunk binary, last boolean, bytes_so_far bigint, digest string",
    )


def originals(payloads: DataFrame, order: str, least_bytes: int = 0) -> DataFrame:
    """``payloads`` (record_id, digest, n_bytes and ``order``) with refers_to: the record that has the payload.

    Of equal payloads of at least ``least_bytes`` that with the largest ``order`` (then record_id) is kept, and
    its own refers_to is null. Smaller ones all stay.
    """
    large = F.col("n_bytes") >= least_bytes
    chosen = payloads.where(large).groupBy("digest", "n_bytes").agg(
        F.max(F.struct(order, "record_id"))["record_id"].alias("original")
    )
    found = payloads.join(chosen, ["digest", "n_bytes"], "left")
    other = large & (F.col("original") != F.col("record_id"))
    return found.withColumn("refers_to", F.when(other, F.col("original"))).drop("original")


def _uri(column: str):
    return F.concat(F.lit("<urn:record:"), F.col(column), F.lit(">"))


def write_archives(chunks: DataFrame, marks: DataFrame, path: str, per_file: int = PER_FILE) -> None:
    """Writes a record for each record of ``chunks``; ``marks`` is that of :func:`originals`.

    Records are dealt over files of about ``per_file`` by a hash and are sorted by record and chunk; chunks that
    repeat are written once.
    """
    files = max(1, -(-marks.count() // per_file))
    chosen = marks.select("record_id", F.col("digest").alias("payload_digest"), "n_bytes", "refers_to")
    # One shuffle of payloads: it serves the join, drops rows that repeat, and makes the files.
    rows = chunks.select("record_id", "url", "chunk_no", "chunk", "last").repartition(files, "record_id")
    rows = rows.join(chosen, "record_id").dropDuplicates(["record_id", "chunk_no"])
    rows = rows.where(F.col("refers_to").isNull() | (F.col("chunk_no") == 0))
    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.col("chunk").cast("string"))
    many = ~revisit & ~((F.col("chunk_no") == 0) & F.col("last"))
    begins = F.col("chunk_no") == 0

    def header(name: str, value, when=None):
        line = F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
        return F.coalesce(line if when is None else F.when(when, line), F.lit(""))

    part = F.when(begins, F.col("record_id")).otherwise(F.concat_ws("-", "record_id", "chunk_no"))
    kind = F.when(revisit, "revisit").when(begins, "response").otherwise("continuation")
    head = F.concat(
        F.lit(f"{VERSION}\r\n"),
        header("WARC-Type", kind),
        header("WARC-Record-ID", F.concat(F.lit("<urn:record:"), part, F.lit(">"))),
        header("WARC-Date", F.lit(_DATE)),
        header("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", " ")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest")), begins),
        header("WARC-Refers-To", _uri("refers_to"), revisit),
        header(
            "WARC-Profile",
            F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            revisit,
        ),
        header("WARC-Segment-Number", (F.col("chunk_no") + 1).cast("string"), many),
        header("WARC-Segment-Origin-ID", _uri("record_id"), many & ~begins),
        header("WARC-Segment-Total-Length", F.col("n_bytes").cast("string"), many & F.col("last")),
        header("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
    )
    # The writer ends each row with a newline; the text of a record ends with one.
    lines = F.split(F.concat(head, body, F.lit("\r\n\r")), "\n")
    rows = rows.sortWithinPartitions("record_id", "chunk_no")
    rows.select(F.explode(lines).alias("value")).write.option("compression", "gzip").text(path)


class _Reader:
    """Goes through the lines of archives and gives chunks of payloads as they come."""

    def __init__(self, size: int):
        self.size, self.head, self.left, self.fields = size, None, 0, {}
        self.buffer = bytearray()
        self.number = 0

    def feed(self, line: bytes) -> Iterator[tuple]:
        """``line`` comes without its newline."""
        if self.left:
            taken = line + b"\n"
            if len(taken) > self.left:
                taken = taken[: self.left]
            self.left -= len(taken)
            self.buffer += taken
            while len(self.buffer) >= self.size and (self.left or len(self.buffer) > self.size):
                yield self._chunk(self.size, False)
            if not self.left:
                yield self._chunk(len(self.buffer), True)
        elif self.head is None:
            if line.startswith(b"WARC/"):
                self.head, self.fields = line, {}
        elif line.rstrip(b"\r"):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            self.fields[name.strip().lower()] = value.strip()
        else:
            self.left = int(self.fields.get("content-length", 0))
            self.number = 0
            if not self.left:
                yield self._chunk(0, True)

    def _chunk(self, n: int, last: bool) -> tuple:
        chunk = bytes(self.buffer[:n])
        del self.buffer[:n]
        field = self.fields.get
        origin = _bare(field("warc-segment-origin-id")) or _bare(field("warc-record-id"))
        segment = int(field("warc-segment-number", 1))
        ends = last and ("warc-segment-total-length" in self.fields or "warc-segment-number" not in self.fields)
        row = (
            origin, field("warc-target-uri"), field("warc-type") if segment == 1 else None,
            _bare(field("warc-refers-to")), (field("warc-payload-digest") or "").removeprefix("sha1:") or None,
            (segment, self.number), chunk, ends,
        )
        self.number += 1
        if last:
            self.head = None
        return row


def _bare(uri: str | None) -> str | None:
    return uri.strip("<>").removeprefix("urn:record:") if uri else None


def _read(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(size)
        for batch in batches:
            lines, rows, held = batch.column("line"), [], 0
            for i in range(len(lines)):
                for row in reader.feed(lines[i].as_py()):
                    rows.append(row)
                    held += len(row[6])
                    if held >= 64 * size:
                        yield _batch(rows)
                        rows, held = [], 0
            yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {
            "record_id": pa.string(), "url": pa.string(), "type": pa.string(), "refers_to": pa.string(),
            "digest": pa.string(), "segment": pa.int32(), "chunk_no": pa.int32(), "chunk": pa.binary(),
            "last": pa.bool_(),
        }
        flat = [(*r[:5], r[5][0], r[5][1], r[6], r[7]) for r in rows]
        columns = list(zip(*flat, strict=True)) if flat else [[]] * len(kinds)
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=list(kinds))

    return run


def read_archives(spark: SparkSession, path: str, size: int = CHUNK) -> DataFrame:
    """Chunks of all records below ``path``: record_id, url, type, refers_to, digest, segment, chunk_no, chunk, last.

    type, digest and refers_to stand on the first segment of a record.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("line"))
    return lines.mapInArrow(
        _read(size),
        "record_id string, url string, type string, refers_to string, digest string, segment int, chunk_no int, "
        "chunk binary, last boolean",
    )


class _Digest:
    """Digests of the records whose chunks come in order; the others are named as open."""

    def __init__(self):
        self.first, self.sha, self.total, self.segment = None, None, 0, 0

    def feed(self, row: tuple) -> Iterator[tuple]:
        """``row`` is that of a reader: record, url, type, refers_to, digest, (segment, chunk), chunk, ends."""
        record, (segment, number), chunk, ends = row[0], row[5], row[6], row[7]
        if segment == 1 and number == 0:
            yield from self.close()
            self.first, self.sha, self.total, self.segment = row[:5], hashlib.sha1(), 0, 1
        elif self.first is None or self.first[0] != record or segment - self.segment not in (0, 1):
            yield from self.close()
            yield (record, None, None, None, None, None, None, True)
            return
        self.segment = segment
        self.sha.update(chunk)
        self.total += len(chunk)
        if ends:
            yield (*self.first, self.total, base32(self.sha.digest()), False)
            self.first = None

    def close(self) -> Iterator[tuple]:
        if self.first is not None:
            yield (self.first[0], None, None, None, None, None, None, True)
            self.first = None


_RECORD = (
    "record_id string, url string, type string, refers_to string, digest string, n_bytes bigint, "
    "read_digest string, open boolean"
)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.bool_()]
    names = [part.split()[0] for part in _RECORD.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _digests_of_lines(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, digest = _Reader(size), _Digest()
        for batch in batches:
            lines, rows = batch.column("line"), []
            for i in range(len(lines)):
                for row in reader.feed(lines[i].as_py()):
                    rows += digest.feed(row)
            yield _records(rows)
        yield _records(list(digest.close()))

    return run


def _digests_of_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by record, segment and chunk."""
    digest = _Digest()
    names = ("record_id", "url", "type", "refers_to", "digest", "segment", "chunk_no", "chunk", "last")
    for batch in batches:
        rows = []
        for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            rows += digest.feed((*row[:5], (row[5], row[6]), row[7], row[8]))
        yield _records(rows)
    yield _records(list(digest.close()))


def read_records(spark: SparkSession, path: str, size: int = CHUNK) -> DataFrame:
    """One row per record below ``path``: record_id, url, type, refers_to, digest (as stated), n_bytes, read_digest.

    A record whose segments follow each other in a file is digested as they pass. The chunks of the others, if
    there are any, meet by record in a shuffle, in order. A record that is not whole is left out.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("line"))
    found = stored(lines.mapInArrow(_digests_of_lines(size), _RECORD), "records")
    whole = found.where("not open").drop("open")
    open_ = found.where("open").select("record_id").distinct()
    if open_.isEmpty():
        return whole
    chunks = read_archives(spark, path, size).join(open_, "record_id")
    chunks = chunks.repartition("record_id").sortWithinPartitions("record_id", "segment", "chunk_no")
    return whole.union(chunks.mapInArrow(_digests_of_chunks, _RECORD).where("not open").drop("open"))


def archived(pages: DataFrame, path: str, size: int = CHUNK, least_bytes: int = 0, per_file: int = PER_FILE) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html) below ``path`` and reads the archives back.

    One row per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, intact (what was
    read has the digest that was stated). A null html is an empty payload, a null url has no header and comes
    back null, and so does a null page_id. Rows that are equal in all three are one record. A page_id that
    repeats with other content is another record; refers_to names the page of the response. Null ids
    count as the smallest. Columns beyond the three are not read.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html"), F.lit(""))
    key = F.md5(F.concat_ws("\x00", F.coalesce("url", F.lit("\x01")), html).cast("binary"))
    record_id = F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), key)
    records = pages.select(record_id.alias("record_id"), "page_id", "url", html.cast("binary").alias("payload"))
    chunks = chunk_table(records, size)
    page = F.when(~F.col("record_id").startswith("null:"), F.substring_index("record_id", ":", 1).cast("bigint"))
    payloads = chunks.where("last").select("record_id", "digest", F.col("bytes_so_far").alias("n_bytes")).distinct()
    marks = originals(payloads.withColumn("page_id", page), "page_id", least_bytes).drop("page_id")
    write_archives(chunks, stored(marks, "marks"), path, per_file)
    back = read_records(spark, path, size)
    full = back.where(F.col("refers_to").isNull()).select(F.col("record_id").alias("original"), F.col("n_bytes").alias("full"))
    back = back.join(full, F.col("refers_to") == F.col("original"), "left")
    revisit = F.col("type") == "revisit"
    other = F.substring_index("refers_to", ":", 1)
    return back.select(
        page.alias("page_id"),
        "url",
        F.when(revisit, F.col("full")).otherwise(F.col("n_bytes")).alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(revisit & (other != "null"), other.cast("bigint")).alias("refers_to"),
        (revisit | (F.col("digest") == F.col("read_digest"))).alias("intact"),
    )
