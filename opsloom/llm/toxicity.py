"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

**Vectors.** All words of the examples, with tf = 1 + ln(count), idf = ln((N + 1) / df) from the document
frequencies of the whole corpus, and a factor for what the labels say of a word: ``FLOOR`` plus the size of the
smoothed log-odds of its presence in toxic against clean examples. No word is left out; the factor only makes what
matters for the label weigh more than topic and style. Vectors have length 1.

**Index.** Examples are ordered by their heaviest word and cut into blocks; a posting list per word and block holds
the examples of that block, and with each list goes its largest weight. The ``DENSE`` most common words, which all
blocks have, are rows of a matrix instead, multiplied for many texts at once. For a text the matrix and the largest
weights give a bound per block. Blocks are read from the largest bound down, until no bound exceeds the K-th
similarity found: the K nearest examples are exact.

**Score.** Neighbours vote with their similarity and the weight of their class; a constant mass votes as the
share of toxic documents. A monotone map from votes to probabilities is fitted on calibration documents, which are
no examples. The evidence is the nearest examples.

**Learning.** A bounded sample: about ``PER_CLASS`` documents of either label as examples, with at most ``POSTINGS``
pairs of a word and an example in all, and ``CALIBRATION`` documents to calibrate, whole texts, chosen by a hash of
the row. Of them the driver holds the index only: 20 bytes a pair at most and the
matrix of 4 * ``DENSE`` bytes an example. Every document is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from opsloom.llm.shared import held_out, ranges, slices, small, spread, stored
from opsloom.llm.words import weighted, words

PER_CLASS, CALIBRATION, POSTINGS = 1000, 4000, 2_000_000
FLOOR, SMOOTH = 0.05, 2.0
K, BLOCK, DENSE, PRIOR_MASS = 15, 64, 1024, 0.05
#: Texts that are multiplied with the matrix at once.
_TEXTS = 256
THRESHOLD = 0.3


@dataclass
class Index:
    """Vocabulary and postings, as arrays. A cell is a word and a block that has it."""

    terms: np.ndarray  # hashes of the vocabulary, ascending
    importance: np.ndarray  # of each term: idf and what the labels say
    cells: np.ndarray  # first cell of each term
    blocks: np.ndarray  # of each cell
    tops: np.ndarray  # largest weight of each cell
    starts: np.ndarray  # first posting of each cell
    examples: np.ndarray  # of each posting
    weights: np.ndarray  # of each posting
    dense: np.ndarray  # weights of the most common words: words by examples, blocks filled up
    dense_at: np.ndarray  # row of each term in it, -1 for the others
    ids: np.ndarray  # doc_id of each example, in index order
    toxic: np.ndarray
    vote: np.ndarray  # weight of each example's class
    prior: float
    raw: np.ndarray  # calibration map: votes and probabilities
    probability: np.ndarray


def _vectors(items: np.ndarray, counts: np.ndarray, bounds: np.ndarray, terms, importance):
    """Positions in the vocabulary, unit weights and bounds."""
    at = np.searchsorted(terms, items)
    at[at == len(terms)] = 0
    known = terms[at] == items if len(terms) else np.zeros(len(items), bool)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[known]
    at, weight = at[known], (1 + np.log(counts[known])) * importance[at[known]]
    length = np.sqrt(np.bincount(text, weight * weight, len(bounds) - 1))
    return at, weight / length[text], np.searchsorted(text, np.arange(len(bounds)))


def relevance(present: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Factor of each word, from how many clean and toxic examples (2 rows) have it, of ``n`` each."""
    share = (present + SMOOTH) / (n + 2 * SMOOTH)[:, None]
    return FLOOR + np.abs(np.log(share[1] / share[0]))


def build(
    ids,
    toxic,
    docs: list[tuple[np.ndarray, np.ndarray]],
    shares: tuple[float, float],
    frequency: np.ndarray,
    total: int,
    dense: int = DENSE,
) -> Index:
    """An index of examples (distinct words and counts per example).

    ``shares`` are those of clean and toxic documents; ``frequency`` says of each word of the examples, in order,
    how many of the corpus's ``total`` documents have it.
    """
    ids, toxic = np.asarray(ids, np.int64), np.asarray(toxic, np.int64)
    n = np.array([(toxic == c).sum() for c in (0, 1)])
    vote = (np.array(shares) / np.maximum(n, 1))[toxic] * len(ids)
    sizes = [len(items) for items, _ in docs]
    bounds = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    items = np.concatenate([x for x, _ in docs]) if docs else np.zeros(0, np.uint64)
    counts = np.concatenate([c for _, c in docs]) if docs else np.zeros(0, np.int64)
    terms, at = np.unique(items, return_inverse=True)
    owner = np.repeat(toxic, sizes)
    present = np.stack([np.bincount(at[owner == c], minlength=len(terms)) for c in (0, 1)])
    importance = np.log((total + 1) / np.maximum(frequency, 1)) * relevance(present, n)
    place, weight, ends = _vectors(items, counts, bounds, terms, importance)
    # Examples that share their heaviest word lie in the same blocks, which keeps bounds tight.
    heaviest = np.full(len(docs), len(terms))
    for i in range(len(docs)):
        if ends[i] < ends[i + 1]:
            heaviest[i] = place[ends[i] : ends[i + 1]][weight[ends[i] : ends[i + 1]].argmax()]
    order = np.argsort(heaviest, kind="stable")
    rank = np.empty(len(docs), np.int64)
    rank[order] = np.arange(len(docs))
    example = rank[np.repeat(np.arange(len(docs)), np.diff(ends))]
    every = max(1, -(-len(docs) // BLOCK))
    held = np.bincount(place, minlength=len(terms))
    common = np.lexsort((np.arange(len(terms)), -held))[:dense]
    common = common[held[common] > BLOCK]
    dense_at = np.full(len(terms), -1, np.int32)
    dense_at[common] = np.arange(len(common))
    matrix = np.zeros((len(common), every * BLOCK), np.float32)
    rare = dense_at[place] < 0
    matrix[dense_at[place[~rare]], example[~rare]] = weight[~rare]
    place, weight, example = place[rare], weight[rare], example[rare]
    by = np.lexsort((example, place))
    weight, example = weight[by].astype(np.float32), example[by].astype(np.int32)
    cell = place[by] * every + example // BLOCK
    starts = np.flatnonzero(np.diff(cell, prepend=-1))
    tops = np.maximum.reduceat(weight, starts) if len(starts) else np.zeros(0, np.float32)
    return Index(
        terms, importance, np.searchsorted(cell[starts] // every, np.arange(len(terms) + 1)),
        (cell[starts] % every).astype(np.int32), tops, np.append(starts, len(cell)).astype(np.int32), example, weight,
        matrix, dense_at, ids[order], toxic[order], vote[order], float(shares[1]), np.array([0.0, 1.0]), np.array([0.0, 1.0]),
    )


def nearest(index: Index, place: np.ndarray, weight: np.ndarray, bounds: np.ndarray, k: int = K) -> Iterator[tuple]:
    """For each text (of words between ``bounds``) the k most similar examples: positions, similarities above 0.

    Ties go by position.
    """
    for first in range(0, len(bounds) - 1, _TEXTS):
        ends = bounds[first : first + _TEXTS + 1]
        part = slice(ends[0], ends[-1])
        row = index.dense_at[place[part]]
        text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        query = np.zeros((len(ends) - 1, len(index.dense)), np.float32)
        query[text[row >= 0], row[row >= 0]] = weight[part][row >= 0]
        base = query @ index.dense
        for i in range(len(ends) - 1):
            own = slice(ends[i], ends[i + 1])
            yield _nearest(index, place[own], weight[own], base[i].astype(float), k)


def _nearest(index: Index, place: np.ndarray, weight: np.ndarray, base: np.ndarray, k: int) -> tuple:
    """The above for one text; ``base`` is what the matrix gives for each example."""
    cells = index.cells[place + 1] - index.cells[place]
    cell, own = ranges(index.cells[place], cells), np.repeat(weight, cells)
    block = index.blocks[cell]
    bound = np.bincount(block, own * index.tops[cell], len(base) // BLOCK) + base.reshape(-1, BLOCK).max(axis=1)
    order = np.argsort(-bound, kind="stable")
    sums = np.zeros(len(base))
    least, at, step = 0.0, 0, 8
    while at < len(order):
        chosen = order[at : at + step]
        chosen = chosen[(bound[chosen] > 0) & (bound[chosen] >= least - 1e-6)]
        if not len(chosen):
            break
        taken = np.zeros(len(bound), bool)
        taken[chosen] = True
        mine = np.flatnonzero(taken[block])
        start = index.starts[cell[mine]]
        size = index.starts[cell[mine] + 1] - start
        posting = ranges(start, size)
        sums += np.bincount(index.examples[posting], index.weights[posting] * np.repeat(own[mine], size), len(base))
        sums += np.where(np.repeat(taken, BLOCK), base, 0)
        at, step = at + step, 3 * step
        if len(base) > k:
            least = np.partition(sums, len(base) - k)[len(base) - k]
    hit = np.flatnonzero((sums > 0) & (sums >= least))
    best = hit[np.lexsort((hit, -sums[hit]))[:k]]
    return best, sums[best]


def votes(index: Index, found: np.ndarray, values: np.ndarray) -> float:
    mass = index.vote[found] * values
    return float(((mass * index.toxic[found]).sum() + PRIOR_MASS * index.prior) / (mass.sum() + PRIOR_MASS))


def monotone(raw: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The monotone map from raw votes to probabilities with the least squares, by pooling neighbours."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []
    for x, y, w in zip(raw[order], label[order], weight[order], strict=True):
        pools.append([w * x, w * y, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    x = np.array([p[0] / p[2] for p in pools])
    y = np.array([(p[1] + 0.5 * p[1] / p[2] + 0.01) / (p[2] + 0.52) for p in pools])
    return np.concatenate(([0.0], x, [1.0])), np.concatenate(([0.0], y, [1.0]))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each text with their counts, and how many they are, instead of the text."""
    for batch in batches:
        others = [name for name in batch.schema.names if name != "text"]
        for first, last, raw, bounds in slices(batch.column("text")):
            hashes, _, _, per_text = words(raw, bounds)
            items, counts, ends = weighted(hashes, per_text)
            offsets = pa.array(ends.astype(np.int32))
            part = batch.slice(first, last - first)
            columns = [
                *[part.column(c) for c in others],
                pa.ListArray.from_arrays(offsets, pa.array(items.view(np.int64))),
                pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int64))),
                pa.array(np.diff(ends).astype(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*others, "items", "counts", "size"])


def frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """How many of all ``docs`` have each of ``terms`` (ascending hashes), and how many ``docs`` there are.

    Tasks count the given words only, so what is shuffled and collected is bounded by them.
    """
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, rows = sent.value, 0
        totals = np.zeros(len(terms) + 1, np.int64)
        for batch in batches:
            rows += len(batch)
            for _, _, raw, bounds in slices(batch.column("text")):
                hashes, _, _, per_text = words(raw, bounds)
                at = np.searchsorted(terms, hashes)
                at[at == len(terms)] = 0
                known = terms[at] == hashes if len(terms) else np.zeros(len(hashes), bool)
                text = np.repeat(np.arange(len(bounds) - 1), np.diff(per_text))[known]
                pairs = np.unique(text * len(terms) + at[known])
                totals[:-1] += np.bincount(pairs % max(1, len(terms)), minlength=len(terms))
        totals[-1] = rows
        seen = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(totals[seen])], names=["term", "n"])

    counts = docs.select("text").mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(terms) + 1, np.int64)
    out[counts.column("term").to_numpy()] = counts.column("n").to_numpy()
    return out[:-1], int(out[-1])


def _drawn(bags: DataFrame, most: int) -> list:
    """(key, size) of at most ``most`` rows, in the order of their draw."""
    return bags.select("key", "size", "draw").orderBy("draw", "key").limit(most).collect()


def fit(
    docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, calibration: int = CALIBRATION, postings: int = POSTINGS
) -> Index:
    """An index with its calibration from labelled documents that are not held out.

    Labels without id or value count for nothing; of several labels of an id the largest holds. Rows of one id
    are documents of their own, rows that repeat id and text are one. An empty text is an example without words.
    Without any label or document the index is empty and every text gets the same score. Neither nulls nor repeated
    ids enlarge the sample: its bounds hold per row.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sizes = dict(known.groupBy("toxic").count().collect())
    n = [sizes.get(c, 0) for c in (0, 1)]
    every = max(1, sum(n))
    shares = (n[0] / every, n[1] / every)
    calibrates = spread("doc_id", F.lit("calibrate")) < min(0.25, calibration / every)
    take = F.when(F.col("toxic") == 1, per_class / max(1, n[1])).otherwise(per_class / max(1, n[0]))
    sample = known.withColumn("calibrates", calibrates).where(F.col("calibrates") | (spread("doc_id") < take))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.join(small(sample, 8 * (per_class + calibration)), "doc_id")
    key, draw = F.xxhash64("doc_id", "text").alias("key"), spread("text").alias("draw")
    rows = rows.select("doc_id", "toxic", "calibrates", key, draw, "text")
    bags = rows.mapInArrow(
        _bags,
        "doc_id bigint, toxic int, calibrates boolean, key bigint, draw double, "
        "items array<bigint>, counts array<bigint>, size bigint",
    )
    bags = stored(bags.dropDuplicates(["key"]), "examples")
    chosen, held = [], 0
    by_class = [_drawn(bags.where(~F.col("calibrates") & (F.col("toxic") == c)), per_class) for c in (0, 1)]
    for row in sorted((r for part in by_class for r in part), key=lambda r: (r["draw"], r["key"])):
        if held + row["size"] <= postings:  # a text that does not fit is no example; the others are whole
            chosen.append(row["key"])
            held += row["size"]
    spark = docs.sparkSession
    keys = spark.createDataFrame([(k,) for k in chosen], "key bigint")
    own = bags.join(F.broadcast(keys), "key").select("key", "doc_id", "toxic", "items", "counts").toArrow()
    order = np.lexsort((own.column("key").to_numpy(), own.column("doc_id").to_numpy()))
    items = [np.asarray(own.column("items")[int(i)].values, np.int64).view(np.uint64) for i in order]
    counts = [np.asarray(own.column("counts")[int(i)].values, np.int64) for i in order]
    terms = np.unique(np.concatenate(items)) if items else np.zeros(0, np.uint64)
    ids, toxic = own.column("doc_id").to_numpy()[order], own.column("toxic").to_numpy()[order]
    index = build(ids, toxic, list(zip(items, counts, strict=True)), shares, *frequencies(docs, terms))

    sent = spark.sparkContext.broadcast(index)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            bags, counts = batch.column("items"), batch.column("counts")
            bounds = np.concatenate(([0], np.cumsum(bags.value_lengths().to_numpy()))).astype(np.int64)
            flat = bags.flatten().to_numpy().view(np.uint64), counts.flatten().to_numpy()
            raw = [votes(index, *found) for found in nearest(index, *_vectors(*flat, bounds, index.terms, index.importance))]
            columns = [batch.column("key"), batch.column("toxic"), pa.array(raw, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "toxic", "raw"])

    drawn = [(row["key"],) for row in _drawn(bags.where("calibrates"), calibration)]
    test = bags.join(F.broadcast(spark.createDataFrame(drawn, "key bigint")), "key").select("key", "toxic", "items", "counts")
    test = test.mapInArrow(vote, "key bigint, toxic int, raw double").toArrow()
    if len(test):
        order = np.argsort(test.column("key").to_numpy())
        label = test.column("toxic").to_numpy()[order].astype(float)
        index.raw, index.probability = monotone(test.column("raw").to_numpy()[order], label, np.ones(len(test)))
    return index


def scored(docs: DataFrame, index: Index, evidence: int = 3) -> DataFrame:
    """``docs`` with score, predicted, and evidence (doc_ids of the nearest examples); they replace such columns.

    Only text is used. Texts without a word that an example has, null and empty ones among them, get the score
    of no evidence. Very long texts are taken whole.
    """
    new = ["score", "predicted", "evidence"]
    docs = docs.drop(*new)
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            score, seen = [], []
            for _, _, raw, bounds in slices(batch.column("text")):
                hashes, _, _, per_text = words(raw, bounds)
                known = np.searchsorted(index.terms, hashes)
                known[known == len(index.terms)] = 0
                mine = index.terms[known] == hashes if len(index.terms) else np.zeros(len(hashes), bool)
                kept = np.concatenate(([0], np.cumsum(mine)))[per_text]
                vectors = _vectors(*weighted(hashes[mine], kept), index.terms, index.importance)
                for found, values in nearest(index, *vectors):
                    score.append(votes(index, found, values))
                    seen.append(index.ids[found[:evidence]].tolist())
            score = np.interp(score, index.raw, index.probability)
            columns = [
                pa.array(score, pa.float64()),
                pa.array((score >= THRESHOLD).astype(np.int32)),
                pa.array(seen, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *new])

    schema = StructType([*docs.schema.fields]).add("score", "double").add("predicted", "integer")
    return docs.mapInArrow(run, schema.add("evidence", ArrayType(LongType())))
