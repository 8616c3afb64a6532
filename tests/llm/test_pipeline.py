import random
from collections import Counter

import corpus_pipeline as cp
import duckdb
import pytest
from conftest import SMALL, WORD, sentence
from pyspark.sql import functions as F
from test_decontamination import by_force as contaminated_by_force
from test_line_dedup import by_force as lines_by_force
from test_near_dup import classes_by_force

import __spark_entry__ as contract
from opsloom.llm import language_id
from opsloom.llm.oracle import ORACLE


def test_stages_against_brute_force(spark, small_docs):
    """Every stage on what the stage before has kept."""
    docs = small_docs
    for name, stage in cp.STAGES:
        before = sorted((r["doc_id"], r["text"]) for r in docs.collect())
        found = stage(spark, docs, SMALL).cache()
        if name == "packing":
            assert sum(r["n_tokens"] for r in found.collect()) == sum(len(t) for _, t in before)
            break
        assert found.columns == small_docs.columns and found.dtypes == small_docs.dtypes
        after = sorted((r["doc_id"], r["text"]) for r in found.collect())
        if name == "language ID":
            expected = before  # all are in learned languages
        elif name == "line dedup":
            texts = lines_by_force(before, 2)
            old = dict(before)
            expected = sorted((i, t) for i, t in texts.items() if t == old[i] or t.strip(" "))
            assert all(r["n_chars"] == len(r["text"]) for r in found.collect())
        elif name == "near duplicates":
            expected = sorted((i, t) for (i, t), c in classes_by_force(before).items() if i == c)
            assert len(expected) < len(before)
        else:
            items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
            judged = contaminated_by_force(before, items)
            expected = sorted(k for k in before if not judged[k][4])
            assert len(expected) < len(before)
        assert after == expected, name
        docs = found
    assert [n for n, _ in cp.STAGES] == ["language ID", "line dedup", "near duplicates", "decontamination", "packing"]


def test_odd_rows(spark, odd_docs, no_docs, small_docs, tmp_path):
    spark.createDataFrame([(1, None), (None, "a b")], "item_id bigint, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    for docs in (odd_docs.unionByName(small_docs, allowMissingColumns=True), odd_docs, no_docs):
        for name, stage in cp.STAGES:
            found = stage(spark, docs, f"file://{tmp_path}").cache()
            if name != "packing":
                assert found.columns == docs.columns
                if "node" in docs.columns:
                    assert {r[0] for r in found.select("node").distinct().collect()} <= {"own", None}
            docs = found
    kept = cp.remove_near_duplicates(spark, odd_docs, "").collect()
    assert Counter(r["doc_id"] for r in kept) == dict.fromkeys((1, 2, 3, 4, 5, 7, 8, 9), 1)


def test_unrelated_texts_of_null_or_equal_ids_stay(spark):
    """Two rows without an id that are unrelated, two of one id, and near copies of one of each."""
    rng = random.Random(9)
    texts = [sentence(rng, 80) for _ in range(4)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1] + " tail"), (7, texts[2]), (7, texts[3]), (8, texts[3] + " tail"), (None, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = [tuple(r) for r in cp.remove_near_duplicates(spark, docs, "").collect()]
    assert len(kept) == 4 and {(None, texts[0]), (7, texts[2]), (7, texts[3])} < set(kept)
    assert {t for _, t in kept} & {texts[1], texts[1] + " tail"}


def test_rejected_documents_go(spark, small_docs):
    foreign = small_docs.limit(1).select(F.lit(10**9).alias("doc_id"), F.lit("Совсем другой язык " * 30).alias("text"), F.lit(None).cast("string").alias("lang"), "source", "n_chars")
    found = cp.identify_language(spark, small_docs.unionByName(foreign), SMALL)
    assert found.count() == small_docs.count()
    assert language_id.UNKNOWN not in {r["lang"] for r in found.select("lang").distinct().collect()}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "benchmark", "pages"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    got = contract.queries()[name](spark, SMALL)
    expected = duck.execute(ORACLE[name])
    columns = sorted(c[0] for c in expected.description)
    rows = [dict(zip([c[0] for c in expected.description], row, strict=True)) for row in expected.fetchall()]
    assert sorted(got.columns) == columns
    assert sorted(str([r[c] for c in columns]) for r in got.collect()) == sorted(str([r[c] for c in columns]) for r in rows)
    assert rows


def test_every_operator_has_a_query():
    names = contract.queries()
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and WORD.match(n[2:]) and n[2].isdigit()} == set(range(1, 11))
