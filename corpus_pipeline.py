"""From raw documents to packed training sequences, in stages that are each written and read again.

Language identification, line deduplication, near-duplicate removal, decontamination, packing. Every stage works on
all that the one before has kept, and returns the columns of documents, but for the last one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm import decontamination, language_id, line_dedup, near_dup, packing
from opsloom.llm.shared import shared_folder


def _renamed(docs: DataFrame) -> DataFrame:
    """``docs`` with columns that no operator adds or replaces, but for doc_id, text and lang; see :func:`_restored`."""
    kept = ("doc_id", "text", "lang")
    return docs.toDF(*[c if c in kept else f"column_{i}" for i, c in enumerate(docs.columns)])


def _restored(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from rows of :func:`_renamed`, under their names."""
    return found.select(*_renamed(docs).columns).toDF(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; lang becomes the predicted one. Wordless and foreign texts go."""
    found = language_id.identified(_renamed(docs), language_id.fit(docs)).where(~F.col("rejected"))
    return _restored(found.withColumn("lang", F.col("lang_pred")), docs)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines are deleted; documents of which nothing is left go."""
    found = line_dedup.deduplicated(_renamed(docs))
    left = (F.col("n_removed") == 0) | (F.length(F.trim(F.col("text"))) > 0)
    found = _restored(found.where(F.coalesce(left, F.lit(True))), docs)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the least doc_id; null ids come last.

    A class is known by its root, as ids may be null or repeat. Of rows that repeat id and text one stays.
    """
    row = F.struct(*_parts("doc_id"), F.col("node").alias("_node"))
    keep = near_dup.near_duplicates(docs).groupBy("root").agg(F.min(row).alias("row")).select("row.*")
    # The columns of the join are those of the deduplication, so texts are shuffled once.
    by = ["_node", "_id", "_no_id"]
    rows = _renamed(docs).select("*", near_dup.text_key().alias("_node"), *_parts("doc_id"))
    return _restored(rows.join(keep, by, "left_semi").dropDuplicates(by), docs)


def _parts(doc_id: str) -> list[Column]:
    """An id as two columns without nulls, in the order of ids with nulls last."""
    column = F.col(doc_id).cast("bigint")
    return [column.isNull().alias("_no_id"), F.coalesce(column, F.lit(0)).alias("_id")]


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words is shared with benchmark items."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _restored(decontamination.clean_documents(_renamed(docs), benchmark), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with bucket, batch and slot."""
    return packing.packed(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", remove_repeated_lines),
    ("near duplicates", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("packing", pack),
]

#: Language models, near-duplicate classes and bucket boundaries are not for SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_folder(spark, name.replace(" ", "-").lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
