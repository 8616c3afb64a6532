"""Near duplicates by BagMinHash over word shingles, banded, then verified on the multisets.

**Signature.** The weight of a shingle is how often the text has it. Every (shingle, weight interval) carries
a Poisson process of points in time; the intervals are dyadic ([0, 1), [1, 2), [2, 4), ...), so a weight of w
needs about log2(w) processes, not w. A point has a component of the signature and a place inside its interval;
it counts if the place is below the weight. A component keeps its earliest point, and two texts agree in a
component with a probability of exactly their weighted Jaccard similarity. Points later than a time limit,
which is doubled for the few texts where a component stays empty, cannot be earliest and are never made.

**Candidates.** Texts that agree in all rows of a band share a bucket, and all pairs of a bucket are candidates,
but they are never listed. Equal texts are one node. First every node is compared with the least node of its
bucket, which joins most groups of copies. Where a bucket still holds several components, its nodes outside the
component of the least node are compared with all its nodes, block by block: a task gets two blocks of bounded
size and takes all overlaps between them from one matrix product. So no link between candidates is lost, and
what is moved is blocks of nodes, not pairs.

**Verification** computes the exact weighted Jaccard similarity. Links are closed to components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.llm.components import components
from opsloom.llm.shared import slices, stored, text_key, utf8
from opsloom.llm.words import mix, shingles, weighted, words

#: Bands and rows per band. A pair at 0.8 shares a bucket with probability 1 - (1 - 0.8 ** 5) ** 26 > 0.9999.
BANDS, ROWS = 26, 5
THRESHOLD = 0.8
#: Texts that meet one partner in a single group of the verification, or form a block.
GROUP = 256
#: Shingles of a block, unless one text has more.
BLOCK_SHINGLES = 1 << 20
_TURN = np.uint64(0x9E3779B97F4A7C15)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def bag_signatures(items: np.ndarray, counts: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """Earliest times of ``size`` components for each text; all infinite for a text without items."""
    n = len(bounds) - 1
    signature = np.full((n, size), np.inf)
    weight = np.concatenate(([0], np.cumsum(counts)))
    weight = (weight[bounds[1:]] - weight[bounds[:-1]]).astype(np.float64)
    text = np.repeat(np.arange(n), np.diff(bounds))
    limit = np.zeros(n)
    filled = weight > 0
    limit[filled] = (np.log(size) + 7) / weight[filled]
    level, at = 0, np.arange(len(items))
    parts = []
    while len(at):  # level 0 is [0, 1), level k is [2 ** (k - 1), 2 ** k)
        parts.append((at, np.full(len(at), level)))
        level += 1
        at = at[counts[at] > (1 << (level - 1))]
    if not parts:
        return signature
    at = np.concatenate([p[0] for p in parts])
    levels = np.concatenate([p[1] for p in parts])
    low = np.where(levels == 0, 0, 1 << np.maximum(levels - 1, 0))
    width = np.maximum(low, 1).astype(np.float64)
    key = mix(items[at] + levels.astype(np.uint64) * _TURN)
    pending = np.arange(len(at))
    while len(pending):
        _points(signature, pending, key, text[at], low, width, counts[at], limit, size)
        short = np.isinf(signature).any(axis=1) & filled
        if not short.any():
            break
        limit[short] *= 2
        signature[short] = np.inf
        pending = np.flatnonzero(short[text[at]])
    return signature


def _points(signature, alive, key, text, low, width, count, limit, size) -> None:
    """Puts all points up to the limits of the texts into the signature."""
    time = np.zeros(len(alive))
    turn = np.uint64(0)
    flat = signature.reshape(-1)
    with np.errstate(over="ignore"):
        while len(alive):
            turn += _TURN
            draw = mix(key[alive] + turn)
            time = time - np.log(_uniform(draw)) / (size * width[alive])
            on = time <= limit[text[alive]]
            alive, time, draw = alive[on], time[on], draw[on]
            second = mix(draw ^ _TURN)
            component = ((second >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
            place = (second & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32
            kept = low[alive] + np.floor(place * width[alive]) < count[alive]
            np.minimum.at(flat, text[alive[kept]] * size + component[kept], time[kept])


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key per text and band."""
    bits = np.ascontiguousarray(signature[:, : bands * rows]).view(np.uint64).reshape(len(signature), bands, rows)
    key = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None, :] * _TURN, len(signature), axis=0)
    for j in range(rows):
        key = mix(key ^ bits[:, :, j])
    return key.view(np.int64)


def _sign(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, raw, bounds in slices(batch.column("text")):
                hashes, _, _, per_text = words(raw, bounds)
                items, counts, per_item = weighted(*shingles(hashes, per_text))
                keys = band_keys(bag_signatures(items, counts, per_item, bands * rows), bands, rows)
                some = np.diff(per_text) > 0
                ends = np.concatenate(([0], np.cumsum(some * bands))).astype(np.int32)
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("node"),
                        pa.array(np.diff(shingles_weight(per_item, counts)), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[some].reshape(-1))),
                    ],
                    names=["doc_id", "node", "size", "bands"],
                )

    return run


def shingles_weight(per_item: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Running number of shingles at the bounds of the texts."""
    return np.concatenate(([0], np.cumsum(counts)))[per_item]


def multiset(text_bytes: np.ndarray) -> np.ndarray:
    """The shingles of one text as a sorted set in which the j-th copy of a shingle is an element of its own."""
    hashes, _, _, per_text = words(text_bytes, np.array([0, len(text_bytes)]))
    items, counts, _ = weighted(*shingles(hashes, per_text))
    copies = np.repeat(items, counts)
    number = np.arange(len(copies)) - np.repeat(np.cumsum(counts) - counts, counts)
    later = number > 0
    copies[later] = mix(copies[later] + number[later].astype(np.uint64) * _TURN)
    copies.sort()
    return copies


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum()) if len(b) else 0
    return both / (len(a) + len(b) - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted: the text of b (first), then each text a that is compared with it."""
    group, base = None, None
    for batch in batches:
        raw, bounds = utf8(batch.column("text"))
        groups = list(zip(batch.column("b").to_pylist(), batch.column("salt").to_pylist(), strict=True))
        first = batch.column("first").to_pylist()
        at, values = [], []
        for i, key in enumerate(groups):
            bag = multiset(raw[bounds[i] : bounds[i + 1]])
            if first[i]:
                group, base = key, bag
                continue
            if group != key:
                raise ValueError("a pair without the text of its second node")
            at.append(i)
            values.append(weighted_jaccard(base, bag))
        take = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("a").take(take), batch.column("b").take(take), pa.array(values, pa.float64())],
            names=["a", "b", "similarity"],
        )


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, similarity) of distinct pairs of nodes, from ``texts`` (node, text).

    The pairs of a node b are dealt over groups, so a node with many partners is many tasks; texts pass in
    sorted order, one batch at a time.
    """
    salt = F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / GROUP))
    dealt = pairs.join(pairs.groupBy("b").agg(F.count("*").alias("n")), "b").select("a", "b", salt.alias("salt"))
    member = dealt.join(texts, dealt["a"] == texts["node"]).select("b", "salt", F.lit(False).alias("first"), "a", "text")
    base = dealt.select("b", "salt").distinct().join(texts, F.col("b") == texts["node"])
    base = base.select("b", "salt", F.lit(True).alias("first"), F.lit(None).cast("binary").alias("a"), "text")
    rows = member.union(base).repartition(F.col("b"), F.col("salt"))
    rows = rows.sortWithinPartitions("b", "salt", F.desc("first"))
    return rows.mapInArrow(_verify, "a binary, b binary, similarity double")


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, raw, bounds in slices(batch.column("text")):
            bags = [multiset(raw[bounds[i] : bounds[i + 1]]) for i in range(last - first)]
            ends = np.concatenate(([0], np.cumsum([len(bag) for bag in bags]))).astype(np.int32)
            values = pa.array(np.concatenate(bags).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").slice(first, last - first), pa.ListArray.from_arrays(pa.array(ends), values)],
                names=["node", "bag"],
            )


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets."""
    lengths = [len(x) for x in (*left, *right)]
    owner = np.repeat(np.arange(len(lengths)), lengths)
    _, column, copies = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    shared = copies > 1
    label = np.cumsum(shared) - 1
    kept = shared[column]
    owner, column = owner[kept], label[column[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    for low in range(0, int(shared.sum()), width):
        at = slice(*np.searchsorted(column, [low, low + width]))
        part = np.zeros((len(lengths), width), np.float32)
        part[owner[at], column[at] - low] = 1
        total += part[: len(left)] @ part[len(left) :].T
    return total


def _forest(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Pairs that join, in turn, what is not joined yet."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for x, y in pairs.tolist():
        rx, ry = find(x), find(y)
        if rx != ry:
            parent[ry] = rx
            kept.append((x, y))
    return kept


def _join_blocks(threshold: float):
    """Rows come sorted by bucket and pair of blocks; gives the components that a pair of nodes joins."""

    def joined(asked: list, given: list) -> pa.RecordBatch:
        names: dict[bytes, int] = {}
        left = np.array([names.setdefault(root, len(names)) for root, _ in asked])
        right = np.array([names.setdefault(root, len(names)) for root, _ in given])
        links: list[tuple[int, int]] = []
        if len(names) > 1 and asked and given:
            both = overlaps([bag for _, bag in asked], [bag for _, bag in given])
            size = np.array([len(bag) for _, bag in asked])[:, None] + np.array([len(bag) for _, bag in given])
            x, y = np.nonzero((both >= threshold * (size - both) - 1e-3) & (left[:, None] != right))
            links = _forest(np.unique(np.stack([left[x], right[y]], 1), axis=0), len(names))
        roots = list(names)
        return pa.RecordBatch.from_arrays(
            [pa.array([roots[x] for x, _ in links], pa.binary()), pa.array([roots[y] for _, y in links], pa.binary())],
            names=["a", "b"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides = None, ([], [])
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("bucket", "asked", "given")), strict=True)
            sets, roots, side = batch.column("bag"), batch.column("root"), batch.column("side").to_pylist()
            ends, values = sets.offsets.to_numpy(), sets.values.to_numpy().view(np.uint64)
            for i, now in enumerate(keys):
                if now != key:
                    if key is not None:
                        yield joined(*sides)
                    key, sides = now, ([], [])
                sides[side[i]].append((roots[i].as_py(), values[ends[i] : ends[i + 1]].copy()))
        if key is not None:
            yield joined(*sides)

    return run


def _blocks(open_: DataFrame, bags: DataFrame) -> DataFrame:
    """Rows of pairs of blocks: nodes outside the pivot's component against all nodes of the bucket."""

    def blocks(n: str, size: str) -> Column:
        return F.greatest(F.ceil(F.col(n) / GROUP), F.ceil(F.col(size) / BLOCK_SHINGLES), F.lit(1)).cast("int")

    outside = F.col("root") != F.col("pivot_root")
    totals = open_.groupBy("bucket").agg(
        F.count("*").alias("n"), F.sum("size").alias("sizes"),
        F.count(F.when(outside, 1)).alias("n_out"), F.sum(F.when(outside, F.col("size"))).alias("sizes_out"),
    )
    totals = totals.select("bucket", blocks("n", "sizes").alias("all"), blocks("n_out", "sizes_out").alias("out"))
    rows = open_.join(totals, "bucket").join(bags, "node")
    own = F.pmod(F.xxhash64("node"), F.col("all")).cast("int")
    given = rows.select(
        "bucket", F.explode(F.sequence(F.lit(0), F.col("out") - 1)).alias("asked"), own.alias("given"),
        F.lit(1).alias("side"), "root", "bag",
    )
    own = F.pmod(F.xxhash64("node"), F.col("out")).cast("int")
    asked = rows.where(outside).select(
        "bucket", own.alias("asked"), F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("given"),
        F.lit(0).alias("side"), "root", "bag",
    )
    return given.union(asked).repartition("bucket", "asked", "given").sortWithinPartitions("bucket", "asked", "given")


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, root, copies, n_shingles, node (a key of the text).

    class_id is the least doc_id of the documents that are linked, directly or through others, by a weighted
    Jaccard similarity of at least ``threshold``; copies is how many documents have the same text. Texts of
    fewer than five words have one shingle of all words; texts without words, null among them, are linked to
    equal texts only. class_id is null where all ids of a class are, and classes that carry the same least id
    share it; root, the key of one text of the class, is what tells classes apart. Rows that repeat get equal
    results. Columns beyond doc_id and text are not read.
    """
    node = text_key().alias("node")
    table = docs.select(F.col("doc_id").cast("bigint"), node, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        _sign(bands, rows), "doc_id bigint, node binary, size bigint, bands array<bigint>"
    )
    table = stored(table, "signatures")
    nodes = table.groupBy("node").agg(F.min("bands").alias("bands"), F.min("size").alias("size"))
    buckets = nodes.select("node", "size", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("pivot"), F.max("node").alias("last"))
    # Stored, as are others below: the join then has plain shuffles on both sides, and Spark can split a large bucket.
    shared = stored(shared.where(F.col("pivot") != F.col("last")).select("bucket", "pivot"), "shared")
    members = stored(buckets.join(shared, "bucket"), "buckets")
    needed = members.select("node").distinct()
    texts = docs.select(node, "text").join(needed, "node").groupBy("node").agg(F.min("text").alias("text"))
    texts = stored(texts, "texts")

    pairs = members.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    links = verified(pairs, texts).where(F.col("similarity") >= threshold - 1e-12)
    roots = stored(components(links), "roots")

    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of_pivot = placed.where("node = pivot").select("bucket", F.col("root").alias("pivot_root"))
    placed = placed.join(of_pivot, "bucket")
    mixed = placed.where("root <> pivot_root").select("bucket").distinct()
    open_ = stored(placed.join(mixed, "bucket"), "open")
    bags = texts.join(open_.select("node").distinct(), "node").mapInArrow(_bags, "node binary, bag array<bigint>")
    joined = _blocks(open_, stored(bags, "bags")).mapInArrow(_join_blocks(threshold), "a binary, b binary")
    above = components(joined).select(F.col("node").alias("root"), F.col("root").alias("top"))

    ids = table.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies"))
    ids = ids.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = ids.join(above, "root", "left").withColumn("root", F.coalesce("top", "root"))
    class_id = ids.groupBy("root").agg(F.min("least_id").alias("class_id"))
    # Stored, so that the last join stands alone and Spark can split the rows of a text with very many copies.
    ids = stored(ids.join(class_id, "root").select("node", "class_id", "root", "copies"), "classes")
    return table.select("doc_id", "node", F.col("size").alias("n_shingles")).join(ids, "node")
