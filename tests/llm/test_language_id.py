import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsloom.llm import language_id as li
from opsloom.llm.shared import held_out


def slow_kneser_ney(texts, order):
    """p(letter | context) straight from the definition, for one language; spaces begin a text."""
    grams = [Counter() for _ in range(order + 1)]
    wide = Counter()
    for t in texts:
        t = " " * order + t
        for i in range(len(t) - order):
            wide[t[i : i + order + 1]] += 1
    for g, n in wide.items():
        grams[order][g[1:]] += n
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    letters = {c for t in texts for c in t} | {" "}
    size = len(letters - {" "}) + 2
    discounts = []
    for k in range(order + 1):
        once, twice = (sum(v == x for v in grams[k].values()) for x in (1, 2))
        discounts.append(once / (once + 2 * twice) if once and twice else 0.5)
    followers = [defaultdict(list) for _ in range(order + 1)]
    for k in range(1, order + 1):
        for g, n in grams[k].items():
            followers[k][g[:-1]].append(n)

    def p(context, c, k):
        if k == 0:
            return 1 / size
        lower = p(context[1:] if k > 1 else "", c, k - 1)
        own = followers[k].get(context[len(context) - (k - 1) :] if k > 1 else "")
        if not own:
            return lower
        g = (context[len(context) - (k - 1) :] if k > 1 else "") + c
        total = sum(own)
        return max(grams[k][g] - discounts[k], 0) / total + discounts[k] * len(own) / total * lower

    return p


def test_probabilities_are_those_of_the_definition():
    rng = random.Random(1)
    order = 3
    texts = ["".join(rng.choice("abcd ") for _ in range(60)) for _ in range(6)]
    clean = [" ".join(t.split()) + " " for t in texts]
    wide = Counter()
    for t in clean:
        t = " " * order + t
        for i in range(len(t) - order):
            wide[t[i : i + order + 1]] += 1
    rows = np.array([[ord(c) for c in g] for g in wide], np.uint32)
    model = li.estimate(["x"], {"x": (rows, np.array(list(wide.values())))}, order)
    p = slow_kneser_ney(clean, order)
    for text in ["abca dbd", "dddd zaz", "a", "cab zzz abcd"]:
        totals, lengths = li.Scorer(model).batch([text])
        t = " " + " ".join(text.split()) + " "
        padded = " " * (order - 1) + t
        expected = 0.0
        for i in range(1, len(t)):
            context = padded[i : i + order - 1]
            c = t[i]
            known = all(x in "abcd " for x in context + c)
            if known:
                expected += math.log(p(context, c, order))
        if all(x in "abcd " for x in text):
            assert totals[0, 0] == pytest.approx(expected, rel=1e-4)
        assert lengths[0] == len(t) - 1


def test_distributions_sum_to_one():
    rows = np.array([[32, 32, 97, 98], [32, 97, 98, 97], [97, 98, 97, 32]], np.uint32)
    model = li.estimate(["x"], {"x": (rows, np.array([2, 1, 1]))}, 3)
    scorer = li.Scorer(model)
    numbers = [int(model.codes[list(model.letters).index(c)]) for c in (97, 98, 32)] + [li._OTHER]
    for context in ([1, 1], [1, numbers[0]], [numbers[0], numbers[1]], [2, 2]):
        total = 0.0
        for c in numbers:
            totals = np.zeros((1, 1))
            scorer._flush([np.array([*context, c], np.uint64)], [0], totals)
            total += math.exp(totals[0, 0])
        assert total == pytest.approx(1.0, abs=1e-5)


def test_held_out_accuracy_and_no_clean_document_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = li.identified(docs, li.fit(docs))
    rows = found.where(held_out()).select("lang", "lang_pred", "score", "rejected").collect()
    assert len(rows) > 200
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert found.where("rejected").count() == 0


def test_foreign_and_wordless_texts_are_rejected(spark, small_docs):
    model = li.fit(small_docs)
    texts = ["Это совсем другой язык, которого никто не учил, и он отклонён. " * 5, "12345 !!!", "", None, "xqzj kvwq zzxq jjqv " * 30]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = [(r["lang_pred"], r["score"], r["rejected"]) for r in li.identified(rows, model).orderBy("doc_id").collect()]
    assert all(r[2] for r in got)
    assert [r[0] for r in got[1:4]] == ["und"] * 3 and [r[1] for r in got[1:4]] == [0.0] * 3
    assert got[0][0] != "und"


def test_only_text_decides_and_odd_rows(spark, small_docs, odd_docs, odd_rows, no_docs):
    model = li.fit(small_docs)
    found = li.identified(odd_docs, model)
    assert set(found.columns) == {*odd_docs.columns, "entropy"}
    rows = found.collect()
    assert len(rows) == len(odd_rows)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 8, 9)} == {"und"}
    assert li.identified(no_docs, model).count() == 0
    empty = li.fit(no_docs)
    assert {r["lang_pred"] for r in li.identified(odd_docs, empty).collect()} == {"und"}
    changed = small_docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None).cast("string"))
    a = {r["doc_id"]: r["lang_pred"] for r in li.identified(small_docs, model).collect()}
    b = {r["doc_id"]: r["lang_pred"] for r in li.identified(changed, model).collect()}
    assert a == b


def test_a_long_text_is_scored_whole(spark, small_docs, monkeypatch):
    model = li.fit(small_docs)
    text = " ".join(r["text"] for r in small_docs.limit(5).collect())
    whole, _ = li.Scorer(model).batch([text])
    monkeypatch.setattr(li, "_PASS", 1000)
    parts, _ = li.Scorer(model).batch([text])
    assert parts == pytest.approx(whole, rel=1e-6)
