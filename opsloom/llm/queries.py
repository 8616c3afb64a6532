"""The registered queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm import chat_format, conversation_repair, decontamination, fingerprints, html_extract, language_id, line_dedup, near_dup, packing, resampling, substring_dedup, toxicity, warc
from opsloom.llm.shared import held_out, shared_folder, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs)
    found = language_id.identified(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "entropy", "rejected")


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without later copies of repeated runs of lines."""
    found = line_dedup.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", "n_lines", "n_removed")


@query
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extracted(table(spark, sf_dir, "pages"))


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in spans shared with benchmark items."""
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("row_key")


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    index = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    found = toxicity.scored(docs.select("doc_id", "text"), index)
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted", "evidence")


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every piece of every document."""
    return packing.packed(table(spark, sf_dir, "documents"))


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of at least 50 words that an earlier document has too."""
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document, of its edited text, and how many others lie within the radius.

    n_near is counted for the documents whose id is divisible by 20, against all documents.
    """
    return fingerprints.edited_and_next(table(spark, sf_dir, "documents"))


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    return warc.archived(table(spark, sf_dir, "pages"), shared_folder(spark, "archives")).drop("url")


@query
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near duplicates per document; class_key tells classes apart whose least ids are null or equal."""
    found = near_dup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", F.hex("root").alias("class_key"), "copies", "n_shingles")


@query
def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document, drawn towards the benchmark texts."""
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and its audit of every conversation after damage."""
    convs = table(spark, sf_dir, "conversations")
    return conversation_repair.repair_report(convs, conversation_repair.damaged(convs))


@query
def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted and written, and one that speaks in marks; what is returned is read back."""
    convs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], convs.schema)
    return chat_format.read_back(stored(chat_format.formatted(convs.unionByName(extra)), "chats"))
