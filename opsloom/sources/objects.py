"""Object sets: files below a prefix, read with their path as the object name."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

# Compression kinds and the file suffix of each.
COMPRESSION_SUFFIX = {"NONE": "", "GZIP": ".gz", "BZIP2": ".bz2"}

# Reader options for the keys of a CSV configuration.
CSV_OPTIONS = {
    "FieldDelimiter": "sep",
    "QuoteCharacter": "quote",
    "QuoteEscapeCharacter": "escape",
    "Comments": "comment",
    "RecordDelimiter": "lineSep",
}


def _glob(prefix: str) -> str:
    """A prefix need not end at a folder: everything that starts with it is meant."""
    return prefix if prefix.endswith("/") or "*" in prefix else f"{prefix}*"


def _is_empty_set(error: AnalysisException) -> bool:
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def scan_objects(spark: SparkSession, prefix: str) -> DataFrame:
    """Path and size of every file below a prefix; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    try:
        files = reader.load(_glob(prefix))
    except AnalysisException as error:
        if not _is_empty_set(error):
            raise
        return spark.createDataFrame([], "path STRING, size BIGINT")
    return files.select("path", F.col("length").alias("size"))


def object_totals(objects: DataFrame) -> DataFrame:
    return objects.agg(
        F.count("*").alias("objects"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("total_size"),
    )


def _csv_options(config: dict) -> dict[str, str]:
    options = {CSV_OPTIONS[k]: v for k, v in config.items() if k in CSV_OPTIONS}
    # USE takes names from the first line, IGNORE skips it, NONE has no header.
    header = config.get("FileHeaderInfo", "NONE")
    options["header"] = "true" if header in ("USE", "IGNORE") else "false"
    if str(config.get("AllowQuotedRecordDelimiter", "false")).lower() == "true":
        options["multiLine"] = "true"
    return options


def read_objects(
    spark: SparkSession,
    prefix: str,
    file_type: str,
    config: dict | None = None,
    compression: str = "NONE",
    schema: str | None = None,
    on_error: str = "skip",
    numbered: bool = False,
) -> DataFrame:
    """Records of all files below a prefix.

    ``object`` is the path of a record's file. With ``numbered``, ``object_row`` orders the
    records of a file.

    ``config`` is the caller's parse configuration. Columns of a CSV without header are
    ``_1, _2, ...``. The codec follows from the file suffix, so ``compression`` selects
    files by suffix instead of overriding it. With ``on_error="skip"`` unreadable files
    contribute no rows while the others are read. Give a schema to avoid an extra pass
    over the files that infers it.
    """
    if compression not in COMPRESSION_SUFFIX:
        raise ValueError(f"unknown compression {compression}")
    config = config or {}
    # An unreadable or vanished file must not end the read of the others.
    skip = str(on_error == "skip").lower()
    reader = spark.read.options(
        recursiveFileLookup="true", ignoreCorruptFiles=skip, ignoreMissingFiles=skip
    )
    suffix = COMPRESSION_SUFFIX[compression]
    if suffix:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    if schema is not None:
        reader = reader.schema(schema)

    try:
        return _read(reader, _glob(prefix), file_type.upper(), config, schema is None, numbered)
    except AnalysisException as error:
        if not _is_empty_set(error):
            raise
        columns = f"{schema}, object STRING" if schema else "object STRING"
        return spark.createDataFrame([], columns)


def _read(
    reader: DataFrameReader, path: str, kind: str, config: dict, inferred: bool, numbered: bool
) -> DataFrame:
    if kind == "CSV":
        records = reader.options(**_csv_options(config)).csv(path)
    elif kind == "JSON":
        multi_line = config.get("Type", "DOCUMENT").upper() == "DOCUMENT"
        records = reader.option("multiLine", str(multi_line).lower()).json(path)
    elif kind == "PARQUET":
        records = reader.parquet(path)
    else:
        raise ValueError(f"unknown file type {kind}")
    columns = [F.col(f"`{c}`") for c in records.columns]
    if kind == "CSV" and inferred and config.get("FileHeaderInfo", "NONE") != "USE":
        columns = [c.alias(f"_{i}") for i, c in enumerate(columns, start=1)]
    columns.append(F.col("_metadata.file_path").alias("object"))
    if not numbered:
        return records.select(*columns)
    # Parquet numbers its rows, so filters still reach the scan; other rows are numbered as read.
    if kind == "PARQUET":
        position = F.struct(F.lit(0), F.col("_metadata.row_index"))
    else:
        position = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return records.select(*columns, position.alias("object_row"))
