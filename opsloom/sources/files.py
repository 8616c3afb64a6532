"""Files as they lie below a prefix: every one of them listed, and read by tasks with an error row where one cannot be.

Spark's own readers leave out files whose names begin with ``_`` or ``.``, take ``[``, ``{``, ``*`` and ``?`` of a path for
patterns, and either stop at an unreadable file or pass over it in silence. Here names are names, and whatever goes
wrong with a file is a row that says so, next to the records that could be read.

Text is read in ranges of bytes: a range holds the lines that begin in it. A line is known by its file and the byte at
which it begins, so it is the same line however the file was cut. Compressed files are one range, and their
offsets are those of the text.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from opsloom.session import shared_dir
from opsloom.sources.objects import COMPRESSION_SUFFIX
from opsloom.sources.remote import entries, named, opened

SPLIT_BYTES = 64 << 20
#: Bytes of a file that a task reads in one range after the other, where ranges are smaller.
TASK_BYTES = 16 << 20
#: Bytes that a task reads at a time, those behind the end of a range, and bytes of text in a batch of lines.
_READ, _BEHIND, _BATCH = 1 << 20, 16 << 10, 4 << 20
LISTING = "path STRING, size BIGINT, modified TIMESTAMP"
_LEVEL = "path STRING, size BIGINT, modified TIMESTAMP, is_folder BOOLEAN, error STRING"


def _listed_folders(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Direct entries of folders. A folder that cannot be listed is an entry with an error."""
    for frame in frames:
        for path, start in zip(frame["path"], frame["start"], strict=True):
            try:
                found = [e for e in entries(path) if e.path.rstrip("/").rsplit("/", 1)[-1].startswith(start)]
                rows = [
                    (named(path, e.path), e.size, e.mtime, e.type == fs.FileType.Directory, None)
                    for e in found
                    if e.type in (fs.FileType.File, fs.FileType.Directory)
                ]
            except (OSError, pa.ArrowException) as error:
                rows = [(path, None, None, False, str(error).splitlines()[0])]
            table = pd.DataFrame(rows, columns=["path", "size", "modified", "is_folder", "error"])
            table["size"] = table["size"].astype("Int64")
            table["modified"] = pd.to_datetime(table["modified"], utc=True).dt.tz_localize(None)
            yield table


def list_files(spark: SparkSession, prefix: str) -> tuple[DataFrame, DataFrame]:
    """``(path, size, modified)`` of every file whose name begins with ``prefix``, and ``(path, error)`` of folders.

    A prefix need not end at a folder. Hidden and empty files are files, and characters stand for themselves. Folders
    are listed level by level, those of a level in parallel; the entries of one folder are held by one task. Levels
    are stored, so what a later read sees is one listing.
    """
    folder, start = prefix.rsplit("/", 1) if "/" in prefix.split("://", 1)[-1] else (".", prefix)
    if not folder and prefix.startswith("/"):
        folder = "/"
    level = spark.createDataFrame([(folder, start)], "path STRING, start STRING")
    levels = []
    while True:
        path = shared_dir(spark, "listing")
        level.mapInPandas(_listed_folders, _LEVEL).write.parquet(path)
        found = spark.read.schema(_LEVEL).parquet(path)
        levels.append(found)
        folders = found.where("is_folder")
        n = folders.count()
        if not n:
            break
        level = _spread(folders.select("path", F.lit("").alias("start")), n // 64, "path")
    everything = reduce(DataFrame.unionByName, levels)
    files = everything.where(~F.col("is_folder") & F.col("error").isNull()).select("path", "size", "modified")
    return files, everything.where(F.col("error").isNotNull()).select("path", "error")


def _codec(path: str) -> str | None:
    return "gzip" if path.endswith(".gz") else "bz2" if path.endswith(".bz2") else None


def _stream(path: str):
    """The text of a file as bytes, unpacked, read from its beginning."""
    system, inside = opened(path)
    return system.open_input_stream(inside, compression=_codec(path), buffer_size=_READ)


def _range_lines(path: str, start: int, end: int | None) -> Iterator[tuple[int, bytes]]:
    """``(offset, line)`` of the lines that begin in ``start <= offset < end``, without their ends."""
    if _codec(path):
        source, at = _stream(path), 0
    else:
        system, inside = opened(path)
        source, at = system.open_input_file(inside), start
        # The byte before tells whether a line begins right here.
        source.seek(max(start - 1, 0))
        at = max(start - 1, 0)
    skipping, reached = at < start, at
    held: list[bytes] = []  # the line so far; only what is new is searched for its end
    with source:
        # Of a range no more is read than it has, and then the rest of its last line.
        while block := source.read(_READ if end is None else min(_READ, max(end - reached, _BEHIND))):
            first, reached = 0, reached + len(block)
            while (newline := block.find(b"\n", first)) >= 0:
                held.append(block[first:newline])
                line, held, first = b"".join(held), [], newline + 1
                if not skipping:
                    if end is not None and at >= end:
                        return
                    yield at, line.removesuffix(b"\r")
                at, skipping = at + len(line) + 1, False
            held.append(block[first:])
            # Of a line that goes through a whole range nothing begins in it.
            if end is not None and (reached if skipping else at) >= end:
                return
    line = b"".join(held)
    if line and not skipping and (end is None or at < end):
        yield at, line.removesuffix(b"\r")


_LINES = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("line", pa.string()), ("error", pa.string())])


def _batched(path: str, parts: Iterable[Iterator[tuple[int, str]]]) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size with the lines of all parts, and a row with the error behind each part that ends with one."""
    offsets, lines, errors, size = [], [], [], 0

    def batch() -> pa.RecordBatch:
        columns = [[path] * len(offsets), offsets, lines, errors]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _LINES.types, strict=True)], schema=_LINES)

    def add(offset: int | None, line: str | None, error: str | None) -> int:
        offsets.append(offset)
        lines.append(line)
        errors.append(error)
        return len(line or error or "") + 64

    for part in parts:
        try:
            for offset, line in part:
                size += add(offset, line, None)
                if size >= _BATCH:
                    yield batch()
                    offsets, lines, errors, size = [], [], [], 0
        except (OSError, EOFError, ValueError, pa.ArrowException, csv.Error) as problem:
            size += add(None, None, f"{type(problem).__name__}: {str(problem).splitlines()[0] if str(problem) else 'unreadable'}")
    if offsets:
        yield batch()


def _spread(rows: DataFrame, tasks: int, *by: str) -> DataFrame:
    """Small rows that stand for work, over ``tasks`` tasks or all cores; partitions of a given number are not joined."""
    tasks = max(tasks, 2 * rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(max(1, min(rows.count(), tasks)), *by)


def _ranges(files: DataFrame, split_bytes: int, whole: bool = False) -> DataFrame:
    """``(path, start, end, step)``: stretches of bytes, each of which is read in ranges of ``step`` bytes.

    A stretch has as many ranges as ``TASK_BYTES`` hold, so the number of tasks does not grow when ranges get smaller.
    Compressed files, and all with ``whole``, are one range without end.
    """
    stretch = max(TASK_BYTES // split_bytes, 1) * split_bytes
    cut = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(stretch).cast("bigint"))
    one = F.col("path").rlike(r"\.(gz|bz2)$") | F.lit(whole)
    starts = F.when(one, F.array(F.lit(0).cast("bigint"))).otherwise(cut)
    ranges = files.where(F.col("size") > 0).select("path", "size", F.explode(starts).alias("start"), one.alias("one"))
    end = F.when(~F.col("one"), F.least(F.col("start") + stretch, "size"))
    ranges = ranges.select("path", "start", end.alias("end"), F.lit(split_bytes).cast("bigint").alias("step"))
    total = files.agg(F.sum("size")).first()[0] or 0
    return _spread(ranges, -(-total // stretch), "path", "start")


def _steps(start: int, end: int | None, step: int) -> Iterator[tuple[int, int | None]]:
    """The ranges of a stretch; the last one goes on to its full length, as a file may have grown."""
    return iter([(start, None)]) if end is None else ((at, at + step) for at in range(start, end, step))


def _read_ranges(
    ranges: DataFrame, read: Callable[[str, int, int | None], Iterator[tuple[int, str]]]
) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end, step in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from _batched(path, (read(path, *ends) for ends in _steps(start, end, step)))

    return ranges.mapInArrow(run, "path STRING, offset BIGINT, line STRING, error STRING")


def _text_lines(path: str, start: int, end: int | None) -> Iterator[tuple[int, str]]:
    return ((at, line.decode("utf-8", "replace")) for at, line in _range_lines(path, start, end))


def read_lines(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``(path, offset, line, error)``: the lines of all files, blank ones too, and a row with ``error`` per stretch
    that could not be read to its end. Bytes that are not UTF-8 become replacement characters."""
    return _read_ranges(_ranges(files, split_bytes), _text_lines)


def _csv_records(config: dict) -> Callable[[str, int, int | None], Iterator[tuple[int, str]]]:
    """Records of a CSV file as JSON arrays of text, numbered."""
    quote, escape = config.get("QuoteCharacter", '"'), config.get("QuoteEscapeCharacter", '"')
    comment, delimiter = config.get("Comments"), config.get("RecordDelimiter", "\n")
    options = {"delimiter": config.get("FieldDelimiter", ","), "quotechar": quote, "doublequote": escape == quote}
    if escape != quote:
        options["escapechar"] = escape
    multiline = str(config.get("AllowQuotedRecordDelimiter", "false")).lower() == "true"

    def pieces(path: str, start: int, end: int | None) -> Iterator[tuple[int, str]]:
        if delimiter in ("\n", "\r\n"):
            yield from _text_lines(path, start, end)
            return
        with _stream(path) as source:
            at, rest = 0, ""
            text = io.TextIOWrapper(source, "utf-8", "replace", newline="")
            while block := text.read(_READ):
                *found, rest = (rest + block).split(delimiter)
                for piece in found:
                    yield at, piece
                    at += 1
            if rest:
                yield at, rest

    def records(path: str, start: int, end: int | None) -> Iterator[tuple[int, str]]:
        lines = pieces(path, start, end)
        if not multiline:
            for at, line in lines:
                if line and not (comment and line.startswith(comment)):
                    yield at, json.dumps(next(csv.reader([line], **options), []))
            return
        at = 0

        def fed() -> Iterator[str]:
            nonlocal at
            for offset, line in lines:
                if comment and line.startswith(comment):
                    continue
                at = offset
                yield line + "\n"

        for record in csv.reader(fed(), **options):
            if record:
                yield at, json.dumps(record)

    return records


def _json_documents(path: str, start: int, end: int | None) -> Iterator[tuple[int, str]]:
    """The documents of a file one after the other, an array being its elements; at most one document is held."""
    decoder = json.JSONDecoder()
    with _stream(path) as source:
        text = io.TextIOWrapper(source, "utf-8", "replace")
        rest, number, inside = "", 0, False
        more = True
        wanted = _READ
        while True:
            rest = rest.lstrip(" \t\r\n")
            if inside:
                rest = rest.lstrip(", \t\r\n")
                if rest.startswith("]"):
                    rest, inside = rest[1:], False
                    continue
            elif rest.startswith("["):
                rest, inside = rest[1:], True
                continue
            try:
                _, last = decoder.raw_decode(rest)
                # A number or word at the end of what is read may go on behind it.
                if more and last == len(rest):
                    raise json.JSONDecodeError("more to come", rest, last)
            except json.JSONDecodeError:
                if not more:
                    if rest or inside:
                        raise
                    return
                # Twice as much each time, so a long document is parsed a few times only.
                block = text.read(wanted)
                wanted, more = 2 * wanted, bool(block)
                rest += block
                continue
            wanted = _READ
            yield number, rest[:last]
            number, rest = number + 1, rest[last:]


def _json_schema(rows: DataFrame) -> str:
    """The schema that holds all JSON texts, as Spark sees them as variants; decimals are doubles."""
    found = rows.agg(F.schema_of_variant_agg(F.try_parse_json("line")).alias("s")).first()["s"]
    if found is None or not found.startswith("OBJECT<"):
        return "value STRING"
    found = re.sub(r"DECIMAL\(\d+,\s*\d+\)", "DOUBLE", found).replace("VOID", "STRING").replace("OBJECT<", "STRUCT<")
    return found


def _parquet_ranges(files: DataFrame) -> DataFrame:
    total = files.agg(F.sum("size")).first()[0] or 0
    return _spread(files.select("path"), -(-total // SPLIT_BYTES), "path")


def _object_name(columns: list[str]) -> str:
    return "_object" if "object" in columns else "object"


def read_records(
    spark: SparkSession,
    files: DataFrame,
    file_type: str,
    config: dict | None = None,
    compression: str = "NONE",
    schema: str | None = None,
    split_bytes: int = SPLIT_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """Records of ``files`` (from :func:`list_files`), and ``(object, object_row, error)`` of what could not be read.

    Records have ``object`` (``_object`` if they have a column of that name), the path of their file, and
    ``object_row``, which orders the records of a file. ``config`` and ``compression`` are those of
    ``sources.objects.read_objects``; the codec follows from the name. A malformed JSON text is an error of its own and
    the records around it are read; a file that breaks off gives its records up to there and an error. Columns of
    CSV are text unless ``schema`` says otherwise, and named ``_1, _2, ...`` or as the first line of a file has it.
    Without a schema JSON is read once more, and of CSV files the longest record is looked for. Empty files have
    no records and no error.
    """
    config, kind = config or {}, file_type.upper()
    suffix = COMPRESSION_SUFFIX[compression]
    files = files.where(F.col("path").endswith(suffix)) if suffix else files
    if kind == "PARQUET":
        return _parquet(spark, files, schema)
    if kind == "CSV":
        whole = str(config.get("AllowQuotedRecordDelimiter", "false")).lower() == "true"
        whole = whole or config.get("RecordDelimiter", "\n") not in ("\n", "\r\n")
        rows = _read_ranges(_ranges(files, split_bytes, whole), _csv_records(config))
        return _csv_columns(rows, config, schema)
    if kind != "JSON":
        raise ValueError(f"unknown file type {file_type}")
    if config.get("Type", "DOCUMENT").upper() == "LINES":
        rows = read_lines(files, split_bytes)
        rows = rows.where(F.col("error").isNotNull() | (F.trim("line") != ""))
    else:
        rows = _read_ranges(_ranges(files, split_bytes, whole=True), _json_documents)
    broken = F.col("line").isNotNull() & F.try_parse_json("line").isNull()
    rows = rows.withColumn("error", F.when(broken, F.lit("malformed JSON")).otherwise(F.col("error")))
    good = rows.where(F.col("error").isNull())
    kinds = schema or _json_schema(good)
    parsed = good.select("path", "offset", F.from_json("line", kinds).alias("r"))
    columns = parsed.schema["r"].dataType.fieldNames()
    records = parsed.select(
        *[F.col("r")[c].alias(c) for c in columns],
        F.col("path").alias(_object_name(columns)),
        F.col("offset").alias("object_row"),
    )
    return records, _errors(rows)


def _errors(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("error").isNotNull()).select(
        F.col("path").alias("object"), F.col("offset").alias("object_row"), "error"
    )


def _csv_columns(rows: DataFrame, config: dict, schema: str | None) -> tuple[DataFrame, DataFrame]:
    fields = F.from_json("line", "ARRAY<STRING>")
    good = rows.where(F.col("error").isNull()).select("path", "offset", fields.alias("f"))
    header = config.get("FileHeaderInfo", "NONE")
    names: list[str] | None = None
    if header != "NONE":
        # The first record of every file is its header.
        first = good.groupBy("path").agg(F.min("offset").alias("offset"))
        if header == "USE":
            found = good.join(first, ["path", "offset"]).select("f").distinct().take(2)
            if len(found) > 1:
                raise ValueError("the files have different headers: read them on their own, or by position")
            names = list(found[0]["f"]) if found else []
        good = good.join(first.select("path", F.col("offset").alias("_first")), "path").where("offset > _first")
    given = None
    if schema:
        given = T.StructType.fromDDL(schema)
        positions = [names.index(f.name) if names and f.name in names else i for i, f in enumerate(given.fields)]
        columns = [F.get("f", F.lit(p)).try_cast(f.dataType).alias(f.name) for p, f in zip(positions, given.fields, strict=True)]
    else:
        if names is None:
            n = good.agg(F.max(F.size("f")).alias("n")).first()["n"] or 0
            names = [f"_{i}" for i in range(1, n + 1)]
        columns = [F.get("f", F.lit(i)).alias(c) for i, c in enumerate(names)]
    used = given.fieldNames() if given else names
    records = good.select(*columns, F.col("path").alias(_object_name(used)), F.col("offset").alias("object_row"))
    return records, _errors(rows)


def _parquet(spark: SparkSession, files: DataFrame, schema: str | None) -> tuple[DataFrame, DataFrame]:
    files = files.where(F.col("size") > 0)
    kinds = T.StructType.fromDDL(schema) if schema else _parquet_schema(files)
    names = kinds.fieldNames()
    name = _object_name(names)
    more = [T.StructField(name, T.StringType()), T.StructField("object_row", T.LongType()), T.StructField("_error", T.StringType())]
    out = T.StructType([*kinds.fields, *more])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                at = 0
                try:
                    system, inside = opened(path)
                    with system.open_input_file(inside) as source:
                        file = pq.ParquetFile(source)
                        there = [c for c in names if c in file.schema_arrow.names]
                        for part in file.iter_batches(batch_size=8192, columns=there):
                            n = len(part)
                            columns = [
                                part.column(there.index(f.name)).cast(f.type) if f.name in there else pa.nulls(n, f.type)
                                for f in list(arrow)[: len(names)]
                            ]
                            columns += [pa.array([path] * n), pa.array(range(at, at + n), pa.int64()), pa.nulls(n, pa.string())]
                            at += n
                            yield pa.RecordBatch.from_arrays(columns, schema=arrow)
                except (OSError, ValueError, pa.ArrowException) as problem:
                    nulls = [pa.nulls(1, f.type) for f in list(arrow)[: len(names)]]
                    text = f"{type(problem).__name__}: {str(problem).splitlines()[0]}"
                    nulls += [pa.array([path]), pa.array([at], pa.int64()), pa.array([text])]
                    yield pa.RecordBatch.from_arrays(nulls, schema=arrow)

    rows = _parquet_ranges(files).mapInArrow(run, out)
    errors = rows.where(F.col("_error").isNotNull())
    errors = errors.select(F.col(name).alias("object"), "object_row", F.col("_error").alias("error"))
    return rows.where(F.col("_error").isNull()).drop("_error"), errors


def _parquet_schema(files: DataFrame) -> T.StructType:
    """The columns of the first file whose footer can be read, by name; none if there is no such file."""
    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    system, inside = opened(path)
                    with system.open_input_file(inside) as source:
                        found = from_arrow_schema(pq.ParquetFile(source).schema_arrow).json()
                except (OSError, ValueError, pa.ArrowException):
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([found])], ["path", "schema"])
                break  # one file a task tells enough

    found = _parquet_ranges(files).mapInArrow(footers, "path STRING, schema STRING").agg(F.min_by("schema", "path").alias("s")).first()["s"]
    return T.StructType.fromJson(json.loads(found)) if found else T.StructType([])
