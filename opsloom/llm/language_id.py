"""Language identification with one interpolated Kneser-Ney character model per language.

**Text.** Lower case; every character that is no letter, and every run of them, is one space; a space begins and
ends the text. Letters get numbers from the training alphabet; other letters share one number.

**Models.** Order 5. The highest order uses counts, lower orders the number of distinct left neighbours, each
with one absolute discount of its own estimated from the counts of counts; the lowest order is interpolated
with the uniform distribution. All languages share one table per order: the n-grams that any language has seen,
as sorted hashes, each with the interpolated log-probability and the back-off weight of every language, so a
character costs one look-up where the longest n-gram is known and one more for each order it is not.
Hashes are spread evenly, so a position is found through an index of their leading bits.

**Decision.** The language with the least cross-entropy per character. Softmax over the negative cross-entropies,
with a temperature fitted on calibration documents, gives the score. A document whose best cross-entropy is
beyond the bound of that language (``REJECT_QUANTILE`` of calibration documents, ``REJECT_MARGIN`` nats and the length
of the text) is marked as rejected; it resembles none of the languages.

**Learning.** The models are fitted on a bounded sample of labelled documents, whole texts: about ``PER_LANGUAGE``
per language, chosen by a hash of the id; a fifth of them calibrate. Counting is a Spark job; the driver
gets n-gram counts of the sample only. Every document is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from opsloom.llm.shared import held_out, spread
from opsloom.llm.words import mix

ORDER = 5
#: Labelled documents per language in the sample, about; at most LANGUAGES languages, the most frequent ones.
PER_LANGUAGE, LANGUAGES = 600, 64
REJECT_QUANTILE, REJECT_MARGIN = 0.999, 1.5
UNKNOWN = "und"
_BITS = 12  # of a letter's number in an n-gram
_SPACE, _OTHER = 1, 2
_TURN = np.uint64(0x9E3779B97F4A7C15)
#: Characters of one pass.
_PASS = 1 << 19


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)


def _letters() -> np.ndarray:
    """True for code points that are letters."""
    table = np.zeros(0x110000, bool)
    table[[c for c in range(0x30000) if chr(c).isalpha()]] = True
    return table


_known: dict[str, np.ndarray] = {}


def letter_table() -> np.ndarray:
    if "letters" not in _known:
        _known["letters"] = _letters()
    return _known["letters"]


def squeezed(text: str | None, numbers: np.ndarray) -> np.ndarray:
    """Numbers of the letters of a text with one space for all between them, and one at both ends; empty without letters."""
    if not text:
        return np.zeros(0, np.uint64)
    codes = numbers[_points(text)]
    spaces = codes == _SPACE
    keep = ~spaces
    keep[1:] |= keep[:-1]
    codes = codes[keep]
    if not len(codes) or (codes == _SPACE).all():
        return np.zeros(0, np.uint64)
    if codes[0] != _SPACE:
        codes = np.concatenate(([_SPACE], codes))
    if codes[-1] != _SPACE:
        codes = np.concatenate((codes, [_SPACE]))
    return codes.astype(np.uint64)


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Packed n-grams that end at each place from n - 1 on."""
    total = np.zeros(max(0, len(codes) - n + 1), np.uint64)
    for j in range(n):
        total = (total << np.uint64(_BITS)) | codes[j : len(codes) - n + 1 + j]
    return total


def _count(order: int):
    """Packed n-grams of the highest order of each batch with their counts; shorter ones at the start of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letter_table()
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                points = _points(text or "")
                kept = np.where(table[points], points, 0x20)
                keep = kept != 0x20
                keep[1:] |= keep[:-1]
                kept = np.concatenate(([0x20] * order, kept[keep], [0x20])).astype(np.uint32)
                if len(kept) == order + 1:
                    continue
                view = np.lib.stride_tricks.sliding_window_view(kept, order + 1)
                grams, counts = np.unique(view, axis=0, return_counts=True)
                texts = [g.tobytes() for g in np.ascontiguousarray(grams)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(texts)), pa.array(texts, pa.binary()), pa.array(counts, pa.int64())],
                    names=["lang", "gram", "n"],
                )

    return run


class Model:
    """Tables of all orders; kept as arrays so that it is sent to executors as it is."""

    def __init__(self, languages: list[str], numbers: dict[int, int], order: int):
        self.languages, self.order = languages, order
        self.letters = np.array(sorted(numbers), np.uint32)
        self.codes = np.array([numbers[c] for c in sorted(numbers)], np.uint16)
        self.hashes: list[np.ndarray] = []
        self.logp: list[np.ndarray] = []
        self.back: list[np.ndarray] = []
        self.floor = 0.0
        self.temperature = 1.0
        self.bound = np.full(len(languages), np.inf)

    def numbers(self) -> np.ndarray:
        table = np.where(letter_table(), _OTHER, _SPACE).astype(np.uint16)
        table[self.letters] = self.codes
        return table

    def index(self) -> list[tuple[np.ndarray, int]]:
        """For each order, where the hashes with the same leading bits begin."""
        out = []
        for hashes in self.hashes:
            bits = max(4, int(np.ceil(np.log2(len(hashes) + 1))) + 1)
            leading = (hashes >> np.uint64(64 - bits)).astype(np.int64)
            out.append((np.searchsorted(leading, np.arange((1 << bits) + 1)).astype(np.int32), bits))
        return out


def find(hashes: np.ndarray, index: tuple[np.ndarray, int], wanted: np.ndarray) -> np.ndarray:
    """Positions of hashes in the sorted array, -1 where it has none."""
    starts, bits = index
    leading = (wanted >> np.uint64(64 - bits)).astype(np.int64)
    at, end = starts[leading], starts[leading + 1]
    found = np.full(len(wanted), -1, np.int32)
    open_ = np.flatnonzero(at < end)
    at, end = at[open_], end[open_]
    while len(open_):
        same = hashes[at] == wanted[open_]
        found[open_[same]] = at[same]
        at = at + 1
        on = ~same & (at < end)
        open_, at, end = open_[on], at[on], end[on]
    return found


def _hash(packed: np.ndarray) -> np.ndarray:
    return mix(packed + _TURN)


def _discount(counts: np.ndarray) -> float:
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return once / (once + 2 * twice) if once and twice else 0.5


def estimate(languages: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int) -> Model:
    """Kneser-Ney tables from the (order + 1)-grams of each language: code points (rows) and counts.

    The extra character on the left gives the distinct left neighbours of the n-grams of ``order``.
    """
    letters = sorted({int(c) for rows, _ in counts.values() for c in np.unique(rows)} - {0x20})
    letters = letters[: (1 << _BITS) - 3]
    numbers = {c: i + 3 for i, c in enumerate(letters)} | {0x20: _SPACE}
    model = Model(languages, numbers, order)
    table = np.full(0x110000, _OTHER, np.uint64)
    for c, i in numbers.items():
        table[c] = i
    size = len(letters) + 2
    model.floor = -np.log(size)
    per = {}
    for lang in languages:
        rows, n = counts.get(lang, (np.zeros((0, order + 1), np.uint32), np.zeros(0, np.int64)))
        codes = table[rows]
        full = np.zeros(len(codes), np.uint64)
        for j in range(1, order + 1):
            full = (full << np.uint64(_BITS)) | codes[:, j]
        grams, at = np.unique(full, return_inverse=True)
        levels = [None] * (order + 1)
        levels[order] = (grams, np.bincount(at, n, len(grams)).astype(np.float64))
        for k in range(order - 1, 0, -1):  # continuation counts: distinct left neighbours of each k-gram
            higher = levels[k + 1][0]
            grams, at = np.unique(higher & np.uint64((1 << (_BITS * k)) - 1), return_inverse=True)
            levels[k] = (grams, np.bincount(at, minlength=len(grams)).astype(np.float64))
        per[lang] = levels
    below_keys, below = np.zeros(1, np.uint64), np.full((1, len(languages)), 1.0 / size)
    for k in range(1, order + 1):
        keys = reduce(np.union1d, [per[lang][k][0] for lang in languages])
        contexts = np.unique(keys >> np.uint64(_BITS))
        shorter = keys & np.uint64((1 << (_BITS * (k - 1))) - 1)
        lower = below[np.searchsorted(below_keys, shorter)] if k > 1 else np.repeat(below, len(keys), 0)
        context_at = np.searchsorted(contexts, keys >> np.uint64(_BITS))
        p, weight = np.zeros((len(keys), len(languages))), np.ones((len(contexts), len(languages)))
        for i, lang in enumerate(languages):
            grams, n = per[lang][k]
            if not len(grams):
                continue
            discount = _discount(n)
            owner = np.searchsorted(contexts, grams >> np.uint64(_BITS))
            total = np.bincount(owner, n, len(contexts))
            kinds = np.bincount(owner, minlength=len(contexts))
            seen = total > 0
            weight[seen, i] = discount * kinds[seen] / total[seen]
            own = np.searchsorted(keys, grams)
            p[own, i] = (n - discount) / total[owner]
        p += weight[context_at] * lower
        order_ = np.argsort(_hash(keys))
        model.hashes.append(_hash(keys)[order_])
        model.logp.append(np.log(p)[order_].astype(np.float32))
        back_order = np.argsort(_hash(contexts))
        model.back.append((_hash(contexts)[back_order], np.log(weight)[back_order].astype(np.float32)))
        below_keys, below = keys, p
    return model


class Scorer:
    """Cross-entropies of texts under a model."""

    def __init__(self, model: Model):
        self.model, self.table = model, model.numbers()
        self.index = model.index()
        backs = []
        for hashes, _ in model.back:
            bits = max(4, int(np.ceil(np.log2(len(hashes) + 1))) + 1)
            leading = (hashes >> np.uint64(64 - bits)).astype(np.int64)
            backs.append((np.searchsorted(leading, np.arange((1 << bits) + 1)).astype(np.int32), bits))
        self.backs = backs

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Total log-probability per text and language, and the number of characters scored."""
        model = self.model
        totals, lengths = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), np.int64)
        pending: list[np.ndarray] = []
        owners: list[int] = []
        size = 0
        pad = np.full(model.order - 1, _SPACE, np.uint64)
        for i, text in enumerate(texts):
            codes = squeezed(text, self.table)
            lengths[i] = max(0, len(codes) - 1)
            for first in range(1, len(codes), _PASS):
                part = codes[max(0, first - model.order + 1) : first + _PASS]
                missing = model.order - 1 - (first - max(0, first - model.order + 1))
                pending.append(np.concatenate((pad[:missing], part)))
                owners.append(i)
                size += len(pending[-1])
                if size >= _PASS:
                    self._flush(pending, owners, totals)
                    pending, owners, size = [], [], 0
        if pending:
            self._flush(pending, owners, totals)
        return totals, lengths

    def _flush(self, parts: list[np.ndarray], owners: list[int], totals: np.ndarray) -> None:
        model, order = self.model, self.model.order
        codes = np.concatenate(parts)
        sizes = np.array([len(p) for p in parts])
        ends = np.cumsum(sizes)
        grams = _grams(codes, order)
        place = np.arange(len(grams)) + order - 1
        owner = np.repeat(np.arange(len(parts)), sizes)[order - 1 :]
        inside = place - (ends - sizes)[owner] >= order - 1
        grams, owner = grams[inside], owner[inside]
        unique = np.bincount(owner, minlength=len(parts))
        total = np.zeros((len(grams), len(model.languages)), np.float32)
        open_ = np.arange(len(grams))
        for k in range(order, 0, -1):
            own = grams[open_] & np.uint64((1 << (_BITS * k)) - 1)
            at = find(model.hashes[k - 1], self.index[k - 1], _hash(own))
            hit = at >= 0
            total[open_[hit]] += model.logp[k - 1][at[hit]]
            open_, own = open_[~hit], own[~hit]
            if not len(open_):
                break
            hashes, weights = model.back[k - 1]
            back = find(hashes, self.backs[k - 1], _hash(own >> np.uint64(_BITS)))
            seen = back >= 0
            total[open_[seen]] += weights[back[seen]]
        total[open_] += model.floor
        starts = np.cumsum(unique) - unique
        filled = np.flatnonzero(unique)
        sums = np.add.reduceat(total, starts[filled], axis=0, dtype=np.float64)
        np.add.at(totals, np.array(owners)[filled], sums)

    def decide(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        """Best language (-1: no letter), its cross-entropy, score and whether it is rejected."""
        totals, lengths = self.batch(texts)
        entropy = -totals / np.maximum(lengths, 1)[:, None]
        best = entropy.argmin(axis=1)
        least = entropy[np.arange(len(texts)), best]
        odds = np.exp((least[:, None] - entropy) / self.model.temperature)
        score = 1 / odds.sum(axis=1)
        empty = lengths == 0
        far = least > self.model.bound[best] + REJECT_MARGIN + 4 / np.sqrt(np.maximum(lengths, 1))
        return np.where(empty, -1, best), least, np.where(empty, 0.0, score), empty | far


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, order: int = ORDER) -> Model:
    """A model from labelled documents that are not held out; languages are the values of lang."""
    learned = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = learned.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return Model([], {}, order)
    share = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(min(1.0, per_language / r["count"]))) for r in sizes])
    sample = learned.where(spread("doc_id") < share).select(
        "lang", "text", (spread("doc_id", F.lit("calibrate")) < 0.2).alias("calibrates")
    )
    grams = sample.where("not calibrates").select("lang", "text").mapInArrow(
        _count(order), "lang string, gram binary, n bigint"
    )
    rows = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(r["lang"] for r in sizes)
    counts = {}
    owner = np.array(rows.column("lang").to_pylist(), object)
    data = rows.column("gram").combine_chunks() if rows.num_rows else None
    for lang in languages if rows.num_rows else []:
        at = np.flatnonzero(owner == lang)
        part = data.take(pa.array(at))
        raw = b"".join(part.to_pylist())
        counts[lang] = (np.frombuffer(raw, np.uint32).reshape(-1, order + 1), rows.column("n").to_numpy()[at])
    if not counts:
        return Model([], {}, order)
    model = estimate(languages, counts, order)
    _calibrate(docs, sample, model)
    return model


def _calibrate(docs: DataFrame, sample: DataFrame, model: Model) -> None:
    """Temperature and bounds from the calibration documents, scored on the executors."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    names = model.languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            totals, lengths = scorer.batch(batch.column("text").to_pylist())
            entropy = (-totals / np.maximum(lengths, 1)[:, None])[lengths > 0]
            true = [names.index(x) for x in batch.column("lang").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.array(true)[lengths > 0], pa.int32()),
                    pa.array(lengths[lengths > 0], pa.int64()),
                    pa.array(entropy.tolist(), pa.list_(pa.float64())),
                ],
                names=["true", "length", "entropy"],
            )

    rows = sample.where("calibrates").select("lang", "text").mapInArrow(
        run, "true int, length bigint, entropy array<double>"
    ).toArrow()
    if not rows.num_rows:
        return
    true, length = rows.column("true").to_numpy(), rows.column("length").to_numpy()
    entropy = np.array(rows.column("entropy").to_pylist())
    best = entropy.argmin(axis=1)
    losses = []
    steps = np.geomspace(0.005, 1.0, 60)
    for t in steps:
        z = -(entropy - entropy.min(axis=1, keepdims=True)) / t
        p = np.exp(z[np.arange(len(true)), true]) / np.exp(z).sum(axis=1)
        losses.append(-np.log(np.maximum(p, 1e-12)).mean())
    model.temperature = float(steps[int(np.argmin(losses))])
    for i in range(len(names)):
        own = entropy[best == i, i] - 4 / np.sqrt(length[best == i])
        model.bound[i] = np.quantile(own, REJECT_QUANTILE) if len(own) else np.inf


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score, entropy and rejected; they replace columns of these names.

    Only text is used. lang_pred is ``und`` and score 0 where a text is null or has no letter; such documents, and
    those that resemble no language, are rejected. Very long texts are scored whole, in passes.
    """
    names = model.languages
    new = ["lang_pred", "score", "entropy", "rejected"]
    docs = docs.drop(*new)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            text = batch.column("text")
            if not names:
                best, least = np.full(len(text), -1), np.zeros(len(text))
                score, rejected = np.zeros(len(text)), np.ones(len(text), bool)
            else:
                best, least, score, rejected = scorer.decide(text.to_pylist())
            columns = [
                pa.array([UNKNOWN if i < 0 else names[i] for i in best.tolist()], pa.string()),
                pa.array(score, pa.float64()),
                pa.array(least, pa.float64()),
                pa.array(rejected, pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *new])

    schema = StructType([*docs.schema.fields]).add("lang_pred", "string").add("score", "double")
    return docs.mapInArrow(run, schema.add("entropy", "double").add("rejected", "boolean"))
