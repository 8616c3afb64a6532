import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from opsloom.llm import packing


def padding(lengths, counts, bounds):
    return sum(c * (next(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts, strict=True))


@pytest.mark.parametrize("seed", range(8))
def test_boundaries_have_the_least_padding(seed):
    rng = random.Random(seed)
    lengths = sorted(rng.sample(range(1, 60), rng.randrange(1, 11)))
    counts = [rng.randrange(1, 50) for _ in lengths]
    buckets = rng.randrange(1, 5)
    got = packing.boundaries(np.array(lengths), np.array(counts), buckets)
    options = [
        [*c, lengths[-1]]
        for k in range(min(buckets, len(lengths)))
        for c in combinations(lengths[:-1], k)
    ]
    assert padding(lengths, counts, got) == min(padding(lengths, counts, o) for o in options)
    assert len(got) <= buckets


def test_batches_hold_all_text_within_the_budget(spark, small_docs, small_rows):
    rows = packing.packed(small_docs, max_tokens=512, buckets=6, budget=4096).collect()
    texts, batches, slots = dict(small_rows), defaultdict(int), set()
    pieces = defaultdict(dict)
    for r in rows:
        assert 0 < r["n_tokens"] <= r["bucket"] <= 512
        pieces[r["doc_id"]][r["piece"]] = (r["start"], r["n_tokens"])
        batches[r["batch"]] += r["bucket"]
        slots.add((r["batch"], r["slot"]))
    for doc_id, text in texts.items():
        whole = "".join(text[s : s + n] for _, (s, n) in sorted(pieces[doc_id].items()))
        assert whole == text
    assert max(batches.values()) <= 4096 and len(slots) == len(rows)
    short = [b for b, size in batches.items() if size + int(b.split("-")[0]) <= 4096]
    assert len(short) <= len({b.rsplit("-", 1)[0] for b in batches})


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    rows = packing.packed(odd_docs).collect()
    assert sum(r["n_tokens"] for r in rows) == sum(len(r[1] or "") for r in odd_rows)
    assert packing.packed(no_docs).count() == 0
    with pytest.raises(ValueError):
        packing.packed(odd_docs, budget=10)
