"""Repeated passages, also fuzzy ones: shared seeds, collinear chains, alignment.

**Seeds.** k-mers of words, thinned to minimizers: of ``WINDOW`` consecutive k-mers the least hash is kept, so any
``K + WINDOW - 1`` equal words share a seed. At the minimizers of wider windows (``LONG_WINDOW``) there are long seeds
too, of ``LONG`` words, so any ``LONG + LONG_WINDOW - 1 = 51`` equal words share a long one. A seed is joined with its
first document only (least doc_id), never with all of them, so a passage that many documents share costs as many rows
as it has copies. A document that holds only short pieces of a passage is the first one of its short seeds, but not of the
long seeds across its cuts: these lead to the first document that holds more, and one is enough, as the
alignment extends over the rest. The first document is found by an aggregation with map-side combination before the join.

**Chains.** The matches of a pair of documents are ordered by their place; a chain increases in both documents.
Its score is the words it covers less a cost per word of the gaps on either side. As that cost is a sum over both
sides, the best predecessor is the largest value among smaller places: a prefix maximum in a Fenwick tree.
Chains are cut at gaps of more than ``MAX_GAP`` words.

**Alignment.** Words between matches are aligned, and both ends are extended over single edits. A passage counts
if it has at least ``MIN_WORDS`` equal words, and these are at least ``IDENTITY`` of the longer side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.shared import slices, stored, utf8
from opsloom.llm.words import mix, shingles, words

K, WINDOW = 6, 10
LONG, LONG_WINDOW = 22, 30
#: Places within a long seed that count as matches of k words; no gap between them cuts a chain.
LONG_STEPS = (0, 8, 16)
MIN_WORDS, IDENTITY = 50, 0.8
#: A chain is aligned if it spans as many words; every repeated run of MIN_WORDS words spans more.
MIN_CHAIN, MAX_GAP, GAP_COST = 20, 25, 0.1
#: Documents that are aligned with one partner in a single group.
GROUP = 256
_LEAST_ID = -(1 << 63)


def minimizers(grams: np.ndarray, bounds: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hash of every window of k-mers inside a text (of all, if it has fewer)."""
    n = len(grams)
    if not n:
        return np.zeros(0, np.int64)
    sizes = np.diff(bounds)
    text = np.repeat(np.arange(len(sizes)), sizes)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    at = np.arange(n) + text * (window - 1)
    wide = np.full(n + len(sizes) * (window - 1), top)
    wide[at] = grams
    least = wide.copy()
    for j in range(1, window):
        np.minimum(least[:-j], wide[j:], out=least[:-j])
    whole = np.zeros(len(wide), bool)
    inside = np.arange(n) - bounds[:-1][text]
    whole[at] = (inside + window <= sizes[text]) | (inside == 0)
    least[~whole] = 0
    most = least.copy()
    for j in range(1, window):
        np.maximum(most[j:], least[:-j], out=most[j:])
    return np.flatnonzero(most[at] == grams)


def _long_hashes(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of the ``LONG`` words from each start on, apart from those of k-mers."""
    total = np.full(len(starts), 0x51ED2701A3C5E96B, np.uint64)
    for j in range(LONG):
        total = mix(total ^ hashes[starts + j])
    return total


def _seeds(k: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("doc_id").to_numpy(), batch.column("rid").to_numpy()
            for first, last, raw, bounds in slices(batch.column("text")):
                hashes, _, _, per_text = words(raw, bounds)
                grams, ends = shingles(hashes, per_text, k)
                at = minimizers(grams, ends, window)
                wide = minimizers(grams, ends, LONG_WINDOW)
                text = np.searchsorted(ends, wide, "right") - 1
                starts = per_text[text] + wide - ends[text]
                there = starts + LONG <= per_text[text + 1]
                wide = wide[there]
                # Of a short seed the first place in a text is enough: long ones tell where else a passage stands.
                text = np.searchsorted(ends, at, "right") - 1
                order = np.lexsort((at, grams[at], text))
                at, text = at[order], text[order]
                new = np.ones(len(at), bool)
                new[1:] = (grams[at[1:]] != grams[at[:-1]]) | (text[1:] != text[:-1])
                at = at[new]
                seeds = np.concatenate((grams[at], _long_hashes(hashes, starts[there])))
                is_long = np.arange(len(seeds)) >= len(at)
                at = np.concatenate((at, wide))
                text = np.searchsorted(ends, at, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(seeds.view(np.int64)),
                        pa.array(ids[first:last][text]),
                        pa.array(rows[first:last][text]),
                        pa.array((at - ends[text]).astype(np.int32)),
                        pa.array(is_long),
                    ],
                    names=["seed", "doc_id", "rid", "place", "is_long"],
                )

    return run


def chains(d: np.ndarray, s: np.ndarray, k: int = K) -> list[np.ndarray]:
    """Collinear chains of matches (ascending d), best first, each match in one chain at most."""
    n = len(d)
    ranks = np.searchsorted(np.unique(s), s) + 1
    tree = [(-np.inf, -1)] * (int(ranks.max()) + 1)
    score, back = [0.0] * n, [-1] * n
    dl, sl, rl = d.tolist(), s.tolist(), ranks.tolist()
    size = len(tree)
    i = 0
    while i < n:
        j = i
        while j < n and dl[j] == dl[i]:  # matches at one place cannot follow each other
            best, at = -np.inf, -1
            r = rl[j] - 1
            while r > 0:
                if tree[r][0] > best:
                    best, at = tree[r]
                r -= r & -r
            gain = best - GAP_COST * (dl[j] + sl[j])
            score[j], back[j] = (k + gain, at) if gain > 0 else (float(k), -1)
            j += 1
        for x in range(i, j):
            value = (score[x] + GAP_COST * (dl[x] + sl[x]), x)
            r = rl[x]
            while r < size:
                if value > tree[r]:
                    tree[r] = value
                r += r & -r
        i = j
    used, found = [False] * n, []
    for end in np.argsort(-np.array(score), kind="stable").tolist():
        chain, x = [], end
        while x >= 0 and not used[x]:
            used[x] = True
            chain.append(x)
            x = back[x]
        if chain:
            found.append(np.array(chain[::-1]))
    return found


def _chain_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (rid, base, place); one row for each piece of a chain that spans enough."""
        key, places = None, ([], [], [])
        for batch in batches:
            rid, base = batch.column("rid").to_numpy(), batch.column("base").to_numpy()
            d, s = batch.column("place").to_numpy(), batch.column("base_place").to_numpy()
            is_long = batch.column("is_long").to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.r_[True, (rid[1:] != rid[:-1]) | (base[1:] != base[:-1])]) if len(d) else []
            out = []
            for first, last in zip(cut, [*cut[1:], len(d)], strict=True):
                now = (int(rid[first]), int(base[first]))
                if now != key:
                    out += _spans(key, places, k)
                    key, places = now, ([], [], [])
                for held, column in zip(places, (d, s, is_long), strict=True):
                    held.append(column[first:last])
            yield _span_batch(out)
        yield _span_batch(_spans(key, places, k))

    return run


def _spans(key, places, k: int) -> list[tuple]:
    if key is None:
        return []
    d, s = np.concatenate(places[0]).astype(np.int64), np.concatenate(places[1]).astype(np.int64)
    is_long = np.concatenate(places[2])
    if is_long.any():
        more = [np.column_stack((d[is_long] + step, s[is_long] + step)) for step in LONG_STEPS]
        d, s = np.unique(np.concatenate((np.column_stack((d, s)), *more)), axis=0).T
    if d.max() + k - d.min() < MIN_CHAIN:
        return []
    out = []
    for chain in chains(d, s, k):
        x, y = d[chain], s[chain]
        cuts = np.flatnonzero((np.diff(x) > k + MAX_GAP) | (np.diff(y) > k + MAX_GAP)) + 1
        for part in np.split(np.arange(len(chain)), cuts):
            if x[part[-1]] + k - x[part[0]] >= MIN_CHAIN:
                out.append((*key, x[part].tolist(), y[part].tolist()))
    return out


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    names = ["rid", "base", "places", "base_places"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence; both are short."""
    if len(a) == len(b) and (a == b).all():
        return len(a)
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        step = np.concatenate(([0], row[:-1] + (b == x)))
        row = np.maximum.accumulate(np.maximum(row, step))
    return int(row[-1])


def _extend(a: np.ndarray, b: np.ndarray, i: int, j: int, step: int) -> tuple[int, int, int]:
    """From words i and j on in one direction over equal words and single edits: ends and equal words."""
    equal, ahead = 0, 4
    while True:
        n = min(len(a) - i, len(b) - j) if step > 0 else min(i, j) + 1
        if n <= 0:
            return i, j, equal
        x = a[i : i + n] if step > 0 else a[i - n + 1 : i + 1][::-1]
        y = b[j : j + n] if step > 0 else b[j - n + 1 : j + 1][::-1]
        apart = x != y
        run = int(apart.argmax()) if apart.any() else n
        i, j, equal = i + step * run, j + step * run, equal + run
        if run == n:
            return i, j, equal
        for di, dj in ((1, 1), (1, 0), (0, 1), (2, 2)):
            p, q = i + step * di, j + step * dj
            last_p, last_q = p + step * (ahead - 1), q + step * (ahead - 1)
            if min(p, q, last_p, last_q) < 0 or max(p, last_p) >= len(a) or max(q, last_q) >= len(b):
                continue
            if all(a[p + step * t] == b[q + step * t] for t in range(ahead)):
                i, j = p, q
                break
        else:
            return i, j, equal


def aligned(a: np.ndarray, b: np.ndarray, places: list[int], base_places: list[int], k: int = K) -> tuple:
    """Word ranges [start, end) in both texts and the number of equal words, from the matches of a chain."""
    equal, x, y = 0, places[0], base_places[0]
    first = (x, y)
    for d, s in zip(places, base_places, strict=True):
        if d > x or s > y:
            equal += _common(a[x : max(d, x)], b[y : max(s, y)]) if d > x and s > y else 0
        taken = max(0, min(d + k - max(d, x), s + k - max(s, y)))
        equal += taken
        x, y = max(x, d + k), max(y, s + k)
    x, y = min(x, len(a)), min(y, len(b))
    right = _extend(a, b, x, y, 1)
    left = _extend(a, b, first[0] - 1, first[1] - 1, -1)
    return left[0] + 1, right[0], left[1] + 1, right[1], equal + left[2] + right[2]


def _align(k: int, least: int, identity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted: the text of the base (first), then the texts that share chains with it."""
        group, base, base_id = None, None, None
        for batch in batches:
            raw, bounds = utf8(batch.column("text"))
            columns = (batch.column(c).to_pylist() for c in ("base", "salt", "first", "doc_id", "chains"))
            out = set()
            for i, (key, salt, first, doc_id, pieces) in enumerate(zip(*columns, strict=True)):
                own, _, _, _ = words(raw[bounds[i] : bounds[i + 1]], np.array([0, bounds[i + 1] - bounds[i]]))
                if first:
                    group, base, base_id = (key, salt), own, doc_id
                    continue
                if group != (key, salt):
                    raise ValueError("chains without the text of their base")
                for piece in pieces:
                    found = aligned(own, base, piece["places"], piece["base_places"], k)
                    longer = max(found[1] - found[0], found[3] - found[2])
                    if found[4] >= least and found[4] >= identity * longer:
                        out.add((doc_id, found[0], found[1], base_id, *found[2:]))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            names = ["doc_id", "start", "end", "source_doc_id", "source_start", "source_end", "equal_words"]
            rows = list(zip(*out, strict=True)) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=names)

    return run


def repeated_passages(
    docs: DataFrame, min_words: int = MIN_WORDS, identity: float = IDENTITY, k: int = K, window: int = WINDOW
) -> DataFrame:
    """One row per repeated passage: doc_id, start, end, source_doc_id, source_start, source_end, equal_words.

    Ranges count words and exclude their end; the source is the document with the least doc_id that has the seeds
    of the passage; a passage that a document holds twice is found twice. Null ids are the least and come back null. Texts without ``min_words`` words, null and
    empty ones among them, have no passage. Repeats inside a document are none. Rows that repeat id and text
    are one document; an id that repeats with another text is another document. Columns beyond doc_id and text
    are not read.
    """
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LEAST_ID)).alias("doc_id")
    rid = F.xxhash64("doc_id", "text").alias("rid")
    texts = docs.where(F.col("text").isNotNull()).select(key, rid, "text")
    seeds = texts.mapInArrow(_seeds(k, window), "seed bigint, doc_id bigint, rid bigint, place int, is_long boolean")
    seeds = stored(seeds, "seeds")
    first = seeds.groupBy("seed").agg(
        F.min("doc_id").alias("base_id"), F.min_by("rid", "doc_id").alias("base"),
        F.min_by("place", "doc_id").alias("base_place"), F.count("*").alias("n"),
    ).where("n > 1").drop("n", "base_id")
    # Stored, so that the join alone makes a stage and Spark can split a seed that is in very many places.
    first = stored(first, "first")
    matches = seeds.join(first, "seed").where("rid <> base").select("rid", "base", "place", "base_place", "is_long")
    matches = matches.repartition("rid", "base").sortWithinPartitions("rid", "base", "place", "base_place")
    spans = matches.mapInArrow(_chain_rows(k), "rid bigint, base bigint, places array<int>, base_places array<int>")
    spans = stored(spans.groupBy("rid", "base").agg(F.collect_set(F.struct("places", "base_places")).alias("chains")), "chains")

    # Stored, so that the join alone makes a stage and Spark can split a base that very many documents repeat.
    sizes = stored(spans.groupBy("base").agg(F.count("*").alias("n")), "sizes")
    salt = F.pmod(F.xxhash64("rid"), F.ceil(F.col("n") / GROUP)).alias("salt")
    dealt = stored(spans.join(sizes, "base").select("rid", "base", salt, "chains"), "dealt")
    needed = dealt.select("rid").union(dealt.select(F.col("base").alias("rid"))).distinct()
    found = stored(texts.join(needed, "rid").dropDuplicates(["rid"]), "texts")
    member = dealt.join(found, "rid").select("base", "salt", F.lit(False).alias("first"), "doc_id", "text", "chains")
    bases = dealt.select("base", "salt").distinct().join(found.withColumnRenamed("rid", "base"), "base")
    bases = bases.select("base", "salt", F.lit(True).alias("first"), "doc_id", "text", F.lit(None).cast(dealt.schema["chains"].dataType).alias("chains"))
    rows = member.union(bases).repartition("base", "salt").sortWithinPartitions("base", "salt", F.desc("first"))
    out = rows.mapInArrow(
        _align(k, min_words, identity),
        "doc_id bigint, start int, end int, source_doc_id bigint, source_start int, source_end int, equal_words int",
    )

    def shown(name: str):
        return F.when(F.col(name) != _LEAST_ID, F.col(name)).alias(name)

    return out.distinct().select(
        shown("doc_id"), "start", "end", shown("source_doc_id"), "source_start", "source_end", "equal_words"
    )
