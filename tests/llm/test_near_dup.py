import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from conftest import jaccard, sentence, shingle_counts

from opsloom.llm import near_dup
from opsloom.llm.components import components
from opsloom.llm.shared import slices
from opsloom.llm.words import shingles, weighted, words


def classes_by_force(rows, threshold=0.8):
    """Least id of the component of every row, from all pairs."""
    texts = sorted({t for _, t in rows if t is not None})
    bags = {t: shingle_counts(t) for t in texts}
    parent = {t: t for t in texts}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for a, b in combinations(texts, 2):
        sizes = sorted((sum(bags[a].values()), sum(bags[b].values())))
        if sizes[0] >= threshold * sizes[1] > 0 and jaccard(bags[a], bags[b]) >= threshold:
            parent[find(a)] = find(b)
    least = {}
    for i, t in rows:
        if t is not None and i is not None:
            least[find(t)] = min(least.get(find(t), i), i)
    return {(i, t): least.get(find(t)) for i, t in rows if t is not None}


def test_classes_are_those_of_all_pairs(spark, small_docs, small_rows):
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(small_docs).collect()}
    expected = {i: c for (i, _), c in classes_by_force(small_rows).items()}
    assert got == expected
    assert len(set(got.values())) < len(got)


def test_a_group_of_near_copies_is_one_class_and_repeats_count(spark):
    rng = random.Random(1)
    base = sentence(rng, 300).split()
    rows = []
    for i in range(700):
        copy = list(base)
        for _ in range(rng.randrange(1, 9)):
            copy[rng.randrange(300)] = f"edit{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, " ".join(["x y z"] * 40 + [f"tail{i}"])) for i in range(3)]
    rows += [(2000, " ".join(["x y z"] * 10))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(docs).collect()}
    assert got == {i: c for (i, _), c in classes_by_force(rows).items()}
    assert got[2000] == 2000 and got[1002] == 1000


def test_roots_tell_classes_of_null_and_equal_ids_apart(spark):
    rng = random.Random(6)
    texts = [sentence(rng, 60) for _ in range(4)]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[3] + " tail")]
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["class_id"] or 0) for r in found) == [(0, 0), (0, 0), (7, 7), (7, 7), (8, 7)]
    assert len({bytes(r["root"]) for r in found}) == 4


def test_signatures_estimate_the_weighted_similarity():
    rng = random.Random(2)
    a = [f"w{rng.randrange(40)}" for _ in range(400)]
    b = a[:300] + [f"w{rng.randrange(40)}" for _ in range(100)]
    texts = [" ".join(a), " ".join(b), " ".join(a), ""]
    ((_, _, raw, bounds),) = slices(pa.array(texts))
    hashes, _, _, per_text = words(raw, bounds)
    signature = near_dup.bag_signatures(*weighted(*shingles(hashes, per_text, 1)), 4000)
    one, two = ({w: t.count(w) for w in set(t)} for t in (a, b))
    assert (signature[0] == signature[2]).all()
    assert np.isinf(signature[3]).all()
    assert (signature[0] == signature[1]).mean() == pytest.approx(jaccard(one, two), abs=0.03)


def test_overlaps_of_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, 30).astype(np.uint64)) for _ in range(9)]
    both = near_dup.overlaps(sets[:4], sets[4:])
    assert both.tolist() == [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:4]]


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    rows = near_dup.near_duplicates(odd_docs).collect()
    assert len(rows) == len(odd_rows)
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], set()).add((r["class_id"], r["copies"]))
    assert by_id[4] == {(4, 3), (4, 1)}
    assert (4, 3) in by_id[None]  # the plain text under a null id
    assert by_id[6] == {(5, 1)}
    assert by_id[3] == {(3, 1)} and by_id[1] == {(1, 1)}
    assert by_id[8] == {(8, 2)}
    assert near_dup.near_duplicates(no_docs).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5), (9, 3)]
    got = dict(components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    assert got == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1200)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
