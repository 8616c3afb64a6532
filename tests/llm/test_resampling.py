import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as contract
from opsloom.llm import resampling
from opsloom.llm.shared import utf8

from conftest import DOCUMENTS, SMALL, sentence, words_of


def features_of(text):
    words = words_of(text)
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])], len(words)


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10000


def brute_force(docs, target):
    """(doc_id, n_features, weight, score, rank) of (doc_id, text) rows, as the contract states it."""
    source, wanted = [0] * 10000, [0] * 10000
    for _, text in docs:
        for f in features_of(text)[0]:
            source[bucket(f)] += 1
    for text in target:
        for f in features_of(text)[0]:
            wanted[bucket(f)] += 1
    s_all, t_all = sum(source), sum(wanted)
    rows = []
    for doc_id, text in docs:
        found, n_words = features_of(text)
        total = 0
        for f in found:
            s, t = source[bucket(f)], wanted[bucket(f)]
            total += math.floor(1000 * math.log((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))
        weight = total // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc_id, len(found), weight, score, n_words))
    order = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = order[: len(order) * 25 // 100]
    result = [(*r[:4], i + 1) for i, r in enumerate(drawn)] + [(*r[:4], None) for r in order[len(drawn) :]]
    return result + [(*r[:4], None) for r in rows if r[4] < 20]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_checksums_of_words_and_pairs():
    rng = random.Random(3)
    texts = ["", "a", "a b", "Ä中 x", "x" * 40 + " " + "y" * 33 + " z " + "w" * 32, "l" * 32 + " m", "tail"]
    texts += [" ".join("q" * rng.randrange(1, 45) for _ in range(rng.randrange(9))) for _ in range(50)]
    got, bounds, n = resampling.feature_buckets(*utf8(pa.array(texts)))
    for i, text in enumerate(texts):
        expected, n_words = features_of(text)
        assert sorted(got[bounds[i] : bounds[i + 1]].tolist()) == sorted(bucket(f) for f in expected)
        assert n[i] == n_words


def test_against_brute_force(spark):
    rng = random.Random(11)
    rows = [(i, sentence(rng, rng.randrange(60), 80), None, None, None) for i in range(150)]
    rows += [(7, "again " * 30, None, None, None)] * 2
    target = [sentence(rng, 40, 30) for _ in range(9)] + [None, ""]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    got = resampling.resampled(docs, spark.createDataFrame([(t,) for t in target], "text string"))
    assert ordered(got.collect()) == ordered(brute_force([r[:2] for r in rows], target))
    assert [t for _, t in got.dtypes] == ["bigint"] * 5


def test_odd_rows_and_empty_tables(spark, odd_docs, odd_rows, no_docs):
    target = spark.createDataFrame([("w1 w2 w3",)], "text string")
    got = resampling.resampled(odd_docs, target)
    assert ordered(got.collect()) == ordered(brute_force([r[:2] for r in odd_rows], ["w1 w2 w3"]))
    assert resampling.resampled(no_docs, target).count() == 0
    none = resampling.resampled(odd_docs, no_docs)
    assert ordered(none.collect()) == ordered(brute_force([r[:2] for r in odd_rows], []))


@pytest.mark.parametrize(
    "keys",
    [
        [(5, 1), (5, None), (-3, 1 << 62), (5, -(1 << 63)), (-(1 << 63), 7), ((1 << 63) - 1, (1 << 63) - 1)],
        [(0, None)] * 5,
        [(1, 2)] * 9000 + [(1, 1), (2, 9)],
    ],
)
def test_radix_sort_of_any_key(spark, keys):
    rows = spark.createDataFrame([(i, *k) for i, k in enumerate(keys)], "at int, high bigint, low bigint").repartition(3)
    got = sorted(resampling.radix_ranked(rows, "high", "low").collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, len(keys) + 1))
    expected = sorted(keys, key=lambda k: (-k[0], k[1] is None, k[1] or 0))
    assert [(r["high"], r["low"]) for r in got] == expected
    assert sorted(r["at"] for r in got) == list(range(len(keys)))


def test_radix_sort_over_many_blocks(spark):
    rng = np.random.default_rng(1)
    high, low = rng.integers(-300, 300, 30_000), rng.permutation(30_000)
    table = spark.createDataFrame(list(zip(high.tolist(), low.tolist())), "high bigint, low bigint")
    got = {(r["high"], r["low"]): r["rank"] for r in resampling.radix_ranked(table, "high", "low").collect()}
    for rank, i in enumerate(np.lexsort((low, -high)).tolist()):
        assert got[(int(high[i]), int(low[i]))] == rank + 1


def test_query_equals_sql(spark):
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    found = duck.execute(contract.oracle_sql()["op11_resampling"])
    got = contract.queries()["op11_resampling"](spark, SMALL)
    assert got.columns == [c[0] for c in found.description]
    assert ordered(got.collect()) == ordered(found.fetchall())
