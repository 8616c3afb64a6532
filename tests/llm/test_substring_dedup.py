import random
from collections import defaultdict

import numpy as np
import pytest
from conftest import sentence, words_of

from opsloom.llm import substring_dedup as sd


def best_chain(d, s, k, cost):
    """Best score by trying all predecessors."""
    score = []
    for j in range(len(d)):
        gains = [score[i] - cost * (d[j] - d[i] + s[j] - s[i]) for i in range(j) if d[i] < d[j] and s[i] < s[j]]
        score.append(k + max([0.0, *gains]))
    return max(score)


@pytest.mark.parametrize("seed", range(20))
def test_chains_are_best(seed):
    rng = random.Random(seed)
    places = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(40)})
    d, s = (np.array(x) for x in zip(*places, strict=True))
    found = sd.chains(d, s)
    assert sorted(np.concatenate(found).tolist()) == list(range(len(d)))
    top = found[0]
    assert (np.diff(d[top]) > 0).all() and (np.diff(s[top]) > 0).all()
    gaps = (d[top[-1]] - d[top[0]]) + (s[top[-1]] - s[top[0]])
    assert sd.K * len(top) - sd.GAP_COST * gaps == pytest.approx(best_chain(d, s, sd.K, sd.GAP_COST))


def test_every_window_has_its_minimizer():
    rng = np.random.default_rng(1)
    grams = rng.integers(0, 1 << 62, 500).astype(np.uint64)
    bounds = np.array([0, 3, 3, 200, 500])
    got = set(sd.minimizers(grams, bounds, 10).tolist())
    expected = set()
    for a, b in zip(bounds, bounds[1:], strict=False):
        for i in range(a, max(b - 10 + 1, min(a + 1, b))):
            part = grams[i : min(i + 10, b)]
            expected.add(int(i + part.argmin()))
    assert got == expected


def planted(rng, split):
    """Documents, and (doc, first word, last word) of planted repeats of more than 50 words.

    With ``split`` a passage may be planted inside another one and cut it in two.
    """
    rows = {i: sentence(rng, rng.randrange(60, 400), 5000).split() for i in range(80)}
    truth = []
    for _ in range(25):
        n = rng.randrange(51, 120)
        passage = [f"p{rng.randrange(10**6)}" for _ in range(n)]
        for i in rng.sample(range(80), rng.randrange(2, 6)):
            at = rng.randrange(1, len(rows[i]))
            while not split and rows[i][at - 1][0] == rows[i][at][0] == "p":
                at = rng.randrange(1, len(rows[i]))
            rows[i][at:at] = passage
    seen = {}
    for i in sorted(rows):
        words = rows[i]
        for j in range(len(words) - 50):
            gram = tuple(words[j : j + 51])
            if seen.setdefault(gram, i) != i:
                truth.append((i, j, j + 51))
    return [(i, " ".join(w)) for i, w in rows.items()], truth


@pytest.mark.parametrize("split", [False, True])
def test_planted_passages_are_found_and_no_others(spark, split):
    rows, truth = planted(random.Random(2), split)
    assert len(truth) > 500
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sd.repeated_passages(docs).collect()
    spans = defaultdict(list)
    texts = dict(rows)
    for r in found:
        spans[r["doc_id"]].append((r["start"], r["end"]))
        assert r["source_doc_id"] < r["doc_id"]
        own, other = words_of(texts[r["doc_id"]]), words_of(texts[r["source_doc_id"]])
        shared = set(own[r["start"] : r["end"]]) & set(other[r["source_start"] : r["source_end"]])
        assert len(shared) >= 40 and 50 <= r["equal_words"] <= r["end"] - r["start"]
    lost = [i for i, s, e in truth if not any(a <= s and e <= b for a, b in spans[i])]
    # Runs that are cut in the first document of each of their long seeds, in pieces of 26 to 50 words, can be lost.
    assert len(lost) <= (0.005 * len(truth) if split else 0)
    assert set(spans) == {i for i, _, _ in truth}


def test_fuzzy_passages(spark):
    rng = random.Random(4)
    passage = sentence(rng, 120, 10**6).split()
    edited = list(passage)
    for at in (20, 45, 70, 95):
        edited[at] = "changed"
    del edited[60]
    edited.insert(30, "added")
    rows = [
        (1, " ".join(sentence(rng, 50).split() + passage + sentence(rng, 50).split())),
        (2, " ".join(edited)),
        (3, " ".join(passage[:30] + sentence(rng, 200).split())),
    ]
    found = sd.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert [(r["doc_id"], r["source_doc_id"]) for r in found] == [(2, 1)]
    r = found[0]
    assert (r["start"], r["end"], r["source_start"], r["source_end"]) == (0, 120, 50, 170)
    assert r["equal_words"] >= 113


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    rows = {(r["doc_id"], r["source_doc_id"]): r for r in sd.repeated_passages(odd_docs).collect()}
    assert set(rows) == {(4, None), (6, 5)}
    assert rows[6, 5]["equal_words"] == 80_000 and rows[4, None]["equal_words"] == 60
    assert sd.repeated_passages(no_docs).count() == 0


def found_pairs(spark, rows):
    found = sd.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    return sorted((r["doc_id"], r["source_doc_id"], r["start"], r["end"]) for r in found)


def test_a_first_document_that_holds_pieces_hides_no_later_one(spark):
    rng = random.Random(9)
    passage = sentence(rng, 60, 10**6).split()
    other = [sentence(rng, 30, 10**6).split() for _ in range(4)]
    pieces = other[0] + passage[:20] + other[1] + passage[20:40] + other[2] + passage[40:] + other[3]
    rows = [(1, " ".join(pieces)), (2, " ".join(passage)), (3, " ".join(sentence(rng, 10, 10**6).split() + passage))]
    assert found_pairs(spark, rows) == [(3, 2, 10, 70)]


def test_a_passage_held_twice_is_found_twice(spark):
    rng = random.Random(3)
    passage, gap = sentence(rng, 80, 10**6), sentence(rng, 40, 10**6)
    rows = [(1, passage), (2, f"{passage} {gap} {passage}")]
    assert found_pairs(spark, rows) == [(2, 1, 0, 80), (2, 1, 120, 200)]


def test_long_seeds_cover_every_run_of_51_words():
    rng = np.random.default_rng(5)
    for _ in range(200):
        grams = rng.integers(0, 1 << 62, 51 - sd.K + 1).astype(np.uint64)
        at = sd.minimizers(grams, np.array([0, len(grams)]), sd.LONG_WINDOW)
        assert (at + sd.LONG <= 51).any()


@pytest.mark.parametrize("seed", range(3))
def test_small_tables_against_all_pairs(spark, seed):
    """Documents made of pieces of six runs, cut anywhere: most that a document could lose to the pieces of others."""
    rng = random.Random(seed)
    stock = [[f"s{rng.randrange(10**6)}" for _ in range(90)] for _ in range(6)]
    rows = []
    for i in range(40):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            run = rng.choice(stock)
            a = rng.choice([0, 0, rng.randrange(60)])
            parts += run[a : rng.choice([90, rng.randrange(a + 1, 91)])] + [f"u{rng.randrange(10**9)}" for _ in range(rng.randrange(3))]
        rows.append((i, " ".join(parts)))
    found = defaultdict(list)
    for i, _, a, b in found_pairs(spark, rows):
        found[i].append((a, b))
    seen, wanted = {}, set()
    for i, text in rows:
        words = text.split()
        for j in range(len(words) - 50):
            if seen.setdefault(tuple(words[j : j + 51]), i) != i:
                wanted.add((i, j))
    lost = [(i, j) for i, j in wanted if not any(a <= j and j + 51 <= b for a, b in found[i])]
    assert len(wanted) > 300 and len(lost) <= 0.08 * len(wanted)
