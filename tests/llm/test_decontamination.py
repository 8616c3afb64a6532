import hashlib
import random

from conftest import sentence, words_of

from opsloom.llm import decontamination


def by_force(docs, items):
    out = {}
    for doc_id, text in docs:
        words = words_of(text)
        hit, names = set(), set()
        for item_id, item in items:
            own = words_of(item)
            n = min(13, len(own))
            if not n:
                continue
            grams = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    if item_id is not None:
                        names.add(str(item_id))
        listed = ",".join(sorted(names))
        out.setdefault((doc_id, text or ""), (
            len(words), len(hit), len(names), hashlib.sha256(listed.encode()).hexdigest(),
            len(hit) > 0 and 20 * len(hit) >= len(words),
        ))
    return out


def run(spark, docs, items):
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame(items, "item_id bigint, text string")
    texts = docs.select(decontamination.row_key().alias("row_key"), "text").dropDuplicates()
    rows = decontamination.contamination(docs, items).join(texts, "row_key").collect()
    return {(r[1], r["text"] or ""): tuple(r[2:7]) for r in rows}


def test_planted_spans_of_every_length(spark):
    rng = random.Random(4)
    items = [(i, sentence(rng, rng.choice([1, 3, 7, 8, 12, 13, 14, 30, 60]))) for i in range(60)]
    items += [(7, "Twice The ID with other words and a few more to make it long"), (None, sentence(rng, 20)), (90, ""), (91, None)]
    docs = [(None, None), (0, ""), (1, "..."), (2, "w1")]
    for i in range(3, 80):
        words = sentence(rng, rng.randrange(0, 200), 50).split()
        for _ in range(rng.randrange(4)):
            item = words_of(rng.choice(items)[1])
            at, n = rng.randrange(len(words) + 1), rng.randrange(8, 20)
            first = rng.randrange(max(1, len(item) - n + 1))
            words[at:at] = item[first : first + n]
        docs.append((i, ", ".join(words).upper() if i % 2 else " ".join(words)))
    docs += docs[10:13]  # repeated rows
    assert run(spark, docs, items) == by_force(docs, items)


def test_repeating_words(spark):
    items = [(1, "a " * 30), (2, "a b " * 10), (3, "b")]
    docs = [(1, "a " * 13), (2, "a " * 12), (3, "a b " * 40 + "c"), (4, "c")]
    assert run(spark, docs, items) == by_force(docs, items)


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    items = spark.createDataFrame([(1, odd_rows[1][1]), (1, None)], "item_id bigint, text string")
    found = decontamination.contamination(odd_docs, items).collect()
    assert {r["doc_id"] for r in found if r["contaminated"]} == {None, 4}
    clean = decontamination.clean_documents(odd_docs, items)
    assert clean.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(["None", "1", "2", "3", "5", "6", "7", "8", "9"])
    assert decontamination.contamination(no_docs, items).count() == 0
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.contamination(odd_docs, none).where("n_hit > 0 or contaminated").count() == 0
