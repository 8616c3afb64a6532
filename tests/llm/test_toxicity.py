import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsloom.llm import toxicity
from opsloom.llm.shared import held_out
from opsloom.llm.words import words


def made_index(seed, n=700, dense=toxicity.DENSE):
    rng = np.random.default_rng(seed)
    docs, toxic = [], rng.integers(0, 2, n)
    for t in toxic:
        items = np.unique(rng.integers(0, 40, 12)) + (40 if t else 0) * (rng.random(1) < 0.8)
        items = np.unique(np.concatenate((items, rng.integers(100, 130, 6)))).astype(np.uint64)
        docs.append((items, rng.integers(1, 4, len(items))))
    seen = np.bincount(np.concatenate([items for items, _ in docs]).astype(int))
    return docs, toxic, toxicity.build(np.arange(n), toxic, docs, (0.9, 0.1), seen[seen > 0], n, dense)


def cosines_by_definition(docs, toxic):
    """All cosines between the examples, from the words themselves."""
    terms = sorted({int(w) for items, _ in docs for w in items})
    has = np.zeros((len(docs), len(terms)))
    tf = np.zeros_like(has)
    for i, (items, counts) in enumerate(docs):
        for word, count in zip(items, counts, strict=True):
            at = terms.index(int(word))
            has[i, at], tf[i, at] = 1, 1 + np.log(count)
    idf = np.log((len(docs) + 1) / has.sum(axis=0))
    share = [(has[toxic == c].sum(axis=0) + 2) / ((toxic == c).sum() + 4) for c in (0, 1)]
    vectors = tf * idf * (0.05 + np.abs(np.log(share[1]) - np.log(share[0])))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors @ vectors.T


@pytest.mark.parametrize("dense", [0, 20, toxicity.DENSE])
def test_nearest_are_those_of_all_cosines_over_all_words(dense):
    docs, toxic, index = made_index(1, dense=dense)
    assert len(index.ids) > 5 * toxicity.BLOCK and len(index.dense) <= dense
    assert set(index.terms) == {w for items, _ in docs for w in items}
    every = cosines_by_definition(docs, toxic)
    items, counts = (np.concatenate(x) for x in zip(*docs, strict=True))
    bounds = np.concatenate(([0], np.cumsum([len(x) for x, _ in docs])))
    place, weight, ends = toxicity._vectors(items, counts, bounds, index.terms, index.importance)
    assert (ends == bounds).all()
    found = list(toxicity.nearest(index, place, weight, ends))
    assert len(found) == len(docs) > toxicity._TEXTS
    for i, (at, values) in enumerate(found):
        assert values == pytest.approx(np.sort(every[i])[::-1][: toxicity.K], abs=1e-5)
        assert every[i][index.ids[at]] == pytest.approx(values, abs=1e-5)


def test_frequencies_count_all_documents(spark):
    texts = [("red green",), ("Green green blue",), (None,), ("",), ("blue " * 5000 + "red",)]
    docs = spark.createDataFrame(texts, "text string").repartition(3)
    raw = np.frombuffer(b"blue green lilac red", np.uint8)
    hashes = words(raw, np.array([0, len(raw)]))[0]
    order = np.argsort(hashes)
    found, total = toxicity.frequencies(docs, hashes[order])
    assert total == 5
    assert found.tolist() == np.array([2, 2, 0, 2])[order].tolist()


def test_every_text_with_a_known_word_has_neighbours(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    index = toxicity.fit(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    rows = toxicity.scored(docs, index).select("text", "evidence", "score").collect()
    filled = [r for r in rows if r["text"] and any(ch.isalnum() for ch in r["text"])]
    assert sum(bool(r["evidence"]) for r in filled) >= 0.95 * len(filled)
    assert len({r["score"] for r in filled}) > 3


def test_bounds_hold_for_repeated_ids(spark):
    rows = [(i % 3 if i % 2 else i, f"one two w{i}") for i in range(600)] + [(5, "same text")] * 300
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id bigint, toxic int")
    assert len(toxicity.fit(docs, labels, per_class=10, calibration=20).ids) <= 20
    index = toxicity.fit(docs, labels, postings=50)
    assert 0 < len(index.weights) <= 50


def test_monotone_map():
    rng = np.random.default_rng(2)
    raw = rng.random(2000)
    x, y = toxicity.monotone(raw, (rng.random(2000) < raw**2).astype(float), np.ones(2000))
    assert (np.diff(x) >= 0).all() and (np.diff(y) >= 0).all()
    assert np.interp(0.5, x, y) == pytest.approx(0.25, abs=0.08)


def test_held_out_documents(spark):
    rng = random.Random(3)
    bad = ["vile", "rotten", "nasty", "foul"]
    rows, labels = [], []
    for i in range(1500):
        text = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(20, 200))]
        toxic = int(rng.random() < 0.12)
        for _ in range(3 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((i, " ".join(text)))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    index = toxicity.fit(docs, known)
    found = toxicity.scored(docs, index).join(known, "doc_id").where(held_out()).collect()
    assert len(found) > 300
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found)
    assert all(r["predicted"] == r["toxic"] for r in found)
    truth = dict(labels)
    for r in found:
        assert not r["predicted"] or all(truth[i] for i in r["evidence"])
    wrong = known.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(docs, wrong)
    assert (again.ids == index.ids).all() and (again.probability == index.probability).all()


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    labels = spark.createDataFrame([(4, 1), (4, None), (None, 1), (7, 0), (5, 0), (5, 0)], "doc_id bigint, toxic int")
    index = toxicity.fit(odd_docs, labels)
    found = toxicity.scored(odd_docs, index)
    assert set(found.columns) == {*odd_docs.columns, "predicted", "evidence"}
    rows = found.collect()
    assert len(rows) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.scored(no_docs, index).count() == 0
    none = toxicity.fit(no_docs, labels.limit(0))
    assert toxicity.scored(odd_docs, none).count() == len(odd_rows)
