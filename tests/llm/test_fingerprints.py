import hashlib
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from conftest import sentence
from pyspark.sql import functions as F

from opsloom.llm import fingerprints as fp
from opsloom.llm.shared import slices
from opsloom.llm.words import mix, shingles, words


def slow(text):
    ((_, _, raw, bounds),) = slices(pa.array([text]))
    hashes, _, _, per_text = words(raw, bounds)
    terms, _ = shingles(hashes, per_text, fp.TERM)
    votes = [0] * fp.BITS
    for term in terms:
        pair = [int(term), int(mix(np.array([term]) ^ fp._SECOND)[0])]
        for bit in range(fp.BITS):
            votes[bit] += 1 if pair[bit // 64] >> (bit % 64) & 1 else -1
    return sum((v > 0) << bit for bit, v in enumerate(votes)).to_bytes(16, "little").hex()


def test_fingerprints_are_weighted_votes():
    rng = random.Random(1)
    texts = [sentence(rng, n, 30) for n in (0, 1, 2, 3, 50, 254, 255, 256, 257, 258, 700)]
    got = [m.tobytes().hex() for m in fp._of_texts(texts)]
    assert got == [slow(t) for t in texts]


def expected_rows(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for (i, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        text, following = text or "", following or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        mark, new, other = (np.frombuffer(bytes.fromhex(slow(t)), np.uint8)[None] for t in (text, edited, following))
        out[i] = (
            len(text), hashlib.sha256(edited.encode()).hexdigest(), slow(text), slow(edited),
            float(fp.likeness(mark, new)[0]), float(fp.likeness(mark, other)[0]),
        )
    return out


def test_edited_and_next_documents(spark):
    rng = random.Random(2)
    ids = rng.sample(range(10**6), 150)
    rows = [(i, None if i % 10 == 0 else sentence(rng, rng.randrange(60), 50) + "é\U0001f600" * (i % 3)) for i in ids]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = {r["doc_id"]: tuple(r)[1:7] for r in fp.with_next(docs).collect()}
    assert got == expected_rows(rows)
    one = spark.createDataFrame([(7, "a b c d e f")], "doc_id bigint, text string")
    assert fp.with_next(one).first()["near_next"] == 1.0


def test_half_edited_texts_are_nearer_than_other_ones(spark):
    rng = random.Random(3)
    rows = [(i, sentence(rng, 300)) for i in range(40)]
    found = fp.with_next(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert all(r["near_edited"] > r["near_next"] for r in found)
    assert np.mean([r["near_edited"] for r in found]) == pytest.approx(0.5, abs=0.08)
    assert np.mean([r["near_next"] for r in found]) < 0.15


def test_all_within_the_radius_are_found(spark):
    rng = random.Random(4)
    marks = []
    for _ in range(60):
        base = rng.getrandbits(fp.BITS)
        for _ in range(4):
            other = base
            for bit in rng.sample(range(fp.BITS), rng.randrange(0, 7)):
                other ^= 1 << bit
            marks.append(f"{other:032x}")
    df = spark.createDataFrame([(m,) for m in marks], "fingerprint string")
    for radius, blocks in ((3, 5), (5, 8)):
        got = {(r["asked"], r["found"]): r["distance"] for r in fp.within_radius(df, df, radius, blocks).collect()}
        expected = {(a, a): 0 for a in marks}
        for a, b in combinations(set(marks), 2):
            apart = (int(a, 16) ^ int(b, 16)).bit_count()
            if apart <= radius:
                expected[a, b] = expected[b, a] = apart
        assert got == expected
    with pytest.raises(ValueError):
        fp.within_radius(df, df, 5, 5)


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    rows = fp.edited_and_next(odd_docs, every=1).collect()
    assert len(rows) == len(odd_rows)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["fingerprint"] == by_id[8]["fingerprint"] == "0" * 32
    assert by_id[9]["n_near"] == 5 - 1 and by_id[None]["n_near"] is None
    assert fp.fingerprinted(odd_docs).count() == len(odd_rows)
    assert fp.edited_and_next(no_docs).count() == 0


def test_documents_without_id_are_dealt_over_ranges(spark):
    rows = [(None if i % 3 == 0 else i, f"text number {i}") for i in range(900)] + [(7, "same")] * 40
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    placed = fp.with_next(docs)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small tasks would be put together
    try:
        found = placed.withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(found) == len(rows)
    tasks = {}
    for row in found:
        if row["doc_id"] is None:
            tasks[row["part"]] = tasks.get(row["part"], 0) + 1
    assert len(tasks) > 2 and max(tasks.values()) < 200
    order = sorted(((-(1 << 63) if i is None else i, hashlib.md5(t.encode()).digest(), t) for i, t in rows), reverse=True)
    edits = Counter(
        hashlib.sha256(fp.edited(t, order[(at + 1) % len(order)][2]).encode()).hexdigest()
        for at, (_, _, t) in enumerate(order)
    )
    assert edits == Counter(r["edited_sha256"] for r in found)
