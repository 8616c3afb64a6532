"""Result output: console tables, files, inventory documents."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Writer options for the keys of an output configuration.
CSV_OUTPUT = {
    "FieldDelimiter": "sep",
    "QuoteCharacter": "quote",
    "QuoteEscapeCharacter": "escape",
    "RecordDelimiter": "lineSep",
}
JSON_OUTPUT = {"RecordDelimiter": "lineSep"}


def output_format(file_type: str) -> str:
    """Output follows the input; Parquet input has none of its own and is written as JSON."""
    return "csv" if file_type.upper() == "CSV" else "json"


def show_table(df: DataFrame, n: int = 20, truncate: int | bool = False) -> None:
    """Prints up to ``n`` rows and says so where there are more."""
    rows = df.take(n + 1)
    df.sparkSession.createDataFrame(rows[:n], df.schema).show(n, truncate=truncate)
    if len(rows) > n:
        print(f"these are the first {n} rows; there are more")


def write_result(
    df: DataFrame,
    path: str,
    fmt: str = "json",
    config: dict | None = None,
    single_file: bool = False,
    mode: str = "errorifexists",
) -> None:
    """Writes one file per task. ``single_file`` is for small reports only: one task writes all."""
    config = config or {}
    names = CSV_OUTPUT if fmt == "csv" else JSON_OUTPUT
    options = {names[k]: v for k, v in config.items() if k in names}
    if fmt == "csv" and config.get("QuoteFields", "ASNEEDED").upper() == "ALWAYS":
        options["quoteAll"] = "true"
    if fmt == "csv":  # blanks at the ends of a text are part of it
        options.update(ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")
    out = df.coalesce(1) if single_file else df
    if fmt not in ("csv", "json", "parquet", "text"):
        raise ValueError(f"unknown format {fmt}")
    out.write.mode(mode).options(**options).format(fmt).save(path)


def write_inventory(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Inventory documents as JSON lines, one folder per resource type."""
    report.select("type", "document").write.mode(mode).partitionBy("type").text(path)
