"""Importance resampling towards a target distribution, and a distributed radix sort that ranks the scores.

A text's features are its words and pairs of consecutive words; each falls into one of ``BUCKETS`` buckets by
the CRC-32 of its bytes. The counts of all buckets over the corpus and over the target give one gain per
bucket, and a text is scored against that array alone. Adding a Gumbel variate of the id to the mean gain
and keeping the highest scores draws without replacement in proportion to the weights.

Ranks come from an LSD radix sort of the composite key (score descending, id ascending). Each pass is a stable
counting sort on one digit: rows are counted per block of consecutive positions and digit, global prefix sums
over (digit, block) say where each block's rows of a digit go, and a row's place among them is added. No pass
holds more than a block of rows together, whatever the key.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.llm.shared import slices, stored
from opsloom.llm.words import words

BUCKETS = 10_000
SEED = 7
LEAST_WORDS, PERCENT = 20, 25
#: Bits of a digit, rows of a block and blocks of a superblock in a pass of the radix sort.
DIGIT_BITS, BLOCK_BITS, SUPER_BITS = 8, 12, 10
#: Words up to so many bytes are hashed together, byte place by byte place; longer ones one by one.
_LONG = 32


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> 1), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def _shift_tables() -> np.ndarray:
    """[n, place, byte]: what a byte of a checksum becomes behind n more bytes, so that checksums can be chained."""
    tables = np.empty((_LONG + 2, 4, 256), np.uint32)
    byte = np.arange(256, dtype=np.uint32)
    for place in range(4):
        tables[0, place] = byte << np.uint32(8 * place)
    for n in range(1, _LONG + 2):
        tables[n] = _CRC[tables[n - 1] & 255] ^ (tables[n - 1] >> np.uint32(8))
    return tables


_SHIFT = _shift_tables().reshape(-1)


def _shifted(checksums: np.ndarray, n: np.ndarray) -> np.ndarray:
    at = n.astype(np.int64) << 10
    moved = _SHIFT[at + (checksums & 255)]
    for place in range(1, 4):
        moved ^= _SHIFT[at + (place << 8) + ((checksums >> np.uint32(8 * place)) & 255)]
    return moved


def _fold(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 0x41) & (raw <= 0x5A), raw | 0x20, raw).astype(np.uint8)


def checksums(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of the byte ranges, all at once."""
    length = ends - starts
    order = np.argsort(np.minimum(length, _LONG + 1).astype(np.uint8), kind="stable")[::-1]
    first, bounded = starts[order], np.minimum(length[order], _LONG + 1)
    state = np.full(len(order), 0xFFFFFFFF, np.uint32)
    at = int(np.searchsorted(-bounded, -_LONG, "left"))  # longer ones come first
    for place in range(_LONG):
        to = int(np.searchsorted(-bounded, -place, "left"))
        if to <= at:
            break
        part = state[at:to]
        state[at:to] = _CRC[(part ^ raw[first[at:to] + place]) & 255] ^ (part >> np.uint32(8))
    out = np.empty(len(order), np.uint32)
    out[order] = ~state
    for i in order[:at].tolist():
        out[i] = zlib.crc32(raw[starts[i] : ends[i]].tobytes())
    return out


def feature_buckets(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of some texts, n + 1 bounds of each text's features, and its number of words.

    A text's words and pairs stand together: the pair that a word begins follows it, but for the last word.
    """
    raw = _fold(raw)
    _, starts, ends, per_text = words(raw, bounds)
    single = checksums(raw, starts, ends)
    if len(starts) < 2:
        pairs = np.zeros(0, np.uint32)
    else:
        length = ends[1:] - starts[1:]
        plain = np.minimum(length, _LONG)
        blank = np.full(len(length), zlib.crc32(b" "), np.uint32)
        # The pair is the first word followed by " " and the second.
        pairs = _shifted(single[:-1], plain + 1) ^ _shifted(blank, plain) ^ single[1:]
        for i in np.flatnonzero(length > _LONG).tolist():
            pairs[i] = zlib.crc32(raw[starts[i + 1] : ends[i + 1]].tobytes(), zlib.crc32(b" ", int(single[i])))
    n = np.diff(per_text)
    both = np.empty(2 * len(starts), np.uint32)
    both[0::2] = single
    both[1:-1:2] = pairs
    keep = np.ones(len(both), bool)
    keep[2 * per_text[1:][n > 0] - 1] = False  # no pair begins with the last word of a text
    counts = np.where(n > 0, 2 * n - 1, 0)
    return (both[keep] % np.uint32(BUCKETS)).astype(np.int64), np.concatenate(([0], np.cumsum(counts))), n


def bucket_counts(texts: DataFrame) -> DataFrame:
    """(bucket, n): how often the features of all rows' ``text`` fall into each bucket. Null has none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, raw, bounds in slices(batch.column(0)):
                total += np.bincount(feature_buckets(raw, bounds)[0], minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int32()), "n": pa.array(total[used], pa.int64())})

    return texts.select("text").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame) -> np.ndarray:
    """What a feature of each bucket tells for the target, in thousandths; an array of ``BUCKETS`` numbers."""
    counts = []
    for table in (source, target):
        column = np.zeros(BUCKETS, np.int64)
        for row in bucket_counts(table).collect():  # at most BUCKETS rows
            column[row["bucket"]] = row["n"]
        counts.append(column.tolist())
    s_all, t_all = sum(counts[0]), sum(counts[1])
    ratio = (
        float((t + 1) * (s_all + BUCKETS)) / float((s + 1) * (t_all + BUCKETS))
        for s, t in zip(*counts, strict=True)
    )
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def _noise(doc_id: str, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) per row, from the array of gains alone.

    Null and wordless texts have no features and weight 0. A null doc_id is drawn under the text ``null``.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            n_words, n_features, weights = [], [], []
            for _, _, raw, bounds in slices(batch.column(1)):
                buckets, per_text, n = feature_buckets(raw, bounds)
                total = np.concatenate(([0], np.cumsum(gain[buckets])))
                features = np.diff(per_text)
                n_words.append(n)
                n_features.append(features)
                weights.append((total[per_text[1:]] - total[per_text[:-1]]) // np.maximum(features, 1))
            if not n_words:
                continue
            weight = np.concatenate(weights)
            noise = np.array([_noise("null" if i is None else str(i), seed) for i in ids.to_pylist()], np.int64)
            columns = [ids, *(pa.array(np.concatenate(c), pa.int64()) for c in (n_words, n_features))]
            columns += [pa.array(weight, pa.int64()), pa.array(weight + noise, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(score, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


def _starts(counts: DataFrame) -> DataFrame:
    """(block, digit, first): where the rows of a digit of a block go, from (block, digit, n).

    Prefix sums over (digit, block) in three steps, so that no window holds more than a superblock's blocks,
    a digit's superblocks or all digits.
    """
    counts = counts.withColumn("super", F.shiftright("block", SUPER_BITS))
    supers = counts.groupBy("digit", "super").agg(F.sum("n").alias("n"))
    digits = supers.groupBy("digit").agg(F.sum("n").alias("n"))

    def before(*by: str, order: str) -> Column:
        window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(window), F.lit(0))

    # At most 2 ** DIGIT_BITS rows.
    digits = digits.select("digit", before(order="digit").alias("below"))
    supers = supers.select("digit", "super", before("digit", order="super").alias("ahead"))
    counts = counts.select("block", "digit", "super", before("digit", "super", order="block").alias("inside"))
    found = counts.join(supers, ["digit", "super"]).join(F.broadcast(digits), "digit")
    return found.select("block", "digit", (F.col("below") + F.col("ahead") + F.col("inside")).alias("first"))


def _pass(rows: DataFrame, digit: Column, last: bool) -> DataFrame:
    """One stable counting sort: ``place`` of every row by (digit, place). ``block`` holds places that belong together."""
    rows = rows.withColumn("digit", digit.cast("int"))
    first = _starts(rows.groupBy("block", "digit").agg(F.count("*").alias("n")))
    inside = Window.partitionBy("block", "digit").orderBy("place")
    moved = rows.withColumn("inside", F.row_number().over(inside) - 1).join(first, ["block", "digit"])
    moved = moved.withColumn("place", F.col("first") + F.col("inside"))
    moved = moved.withColumn("block", F.shiftright("place", BLOCK_BITS)).drop("digit", "inside", "first")
    return moved if last else stored(moved, "sorted")


def _digits(column: str, least: int, most: int, descending: bool = False) -> list[Column]:
    """The digits of a bigint column within least..most, lowest first, so that they sort as the column does."""
    if most - least < 1 << 63:
        code, widest = (F.lit(most) - F.col(column) if descending else F.col(column) - F.lit(least)), most - least
    else:  # the difference is beyond a bigint: all 64 bits, with the sign turned
        code, widest = F.col(column).bitwiseXOR(F.lit(-(1 << 63))), (1 << 64) - 1
        code = F.bitwise_not(code) if descending else code
    mask = F.lit((1 << DIGIT_BITS) - 1)
    return [F.shiftrightunsigned(code, s).bitwiseAND(mask) for s in range(0, widest.bit_length(), DIGIT_BITS)]


def radix_ranked(rows: DataFrame, high: str, low: str) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3... by bigint ``high`` descending, then bigint ``low`` ascending with nulls last.

    Rows equal in both columns are ranked one after the other. ``rows`` has no columns named place, block, digit,
    super, inside, first or rank, and ``high`` is never null.
    """
    # Ids grow along a partition; written, they are the same for every reader.
    number = F.monotonically_increasing_id()
    rows = stored(rows.withColumn("place", number).withColumn("block", F.shiftright("place", BLOCK_BITS)), "unsorted")
    bounds = rows.agg(
        F.max(high).alias("top"),
        F.min(high).alias("bottom"),
        F.max(low).alias("last"),
        F.min(low).alias("first"),
        F.count(F.when(F.col(low).isNull(), 1)).alias("nulls"),
    ).first()
    if bounds["top"] is None:
        return rows.drop("place", "block").withColumn("rank", F.lit(None).cast("bigint"))
    digits = []
    if bounds["last"] is not None:
        digits += [F.coalesce(d, F.lit(0)) for d in _digits(low, bounds["first"], bounds["last"])]
    if bounds["nulls"]:
        digits.append(F.col(low).isNull().cast("int"))
    digits += _digits(high, bounds["bottom"], bounds["top"], descending=True)
    digits = digits or [F.lit(0)]
    for i, digit in enumerate(digits):
        rows = _pass(rows, digit, last=i == len(digits) - 1)
    return rows.withColumn("rank", F.col("place") + 1).drop("place", "block")


def resampled(
    docs: DataFrame,
    target: DataFrame,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, rank (null where not drawn), all bigint.

    Of the N rows with at least ``least_words`` words, floor(percent * N / 100) are drawn, those of the highest
    scores, ties to the smaller doc_id, null ids last. Rows that repeat are drawn on their own. Of ``target`` only
    ``text`` is read; an empty target makes gains of what is rare in the corpus. Empty tables give an empty result.
    """
    rows = stored(scored(docs, gains(docs, target), seed), "scores")
    long_enough = F.col("n_words") >= least_words
    wanted = rows.where(long_enough).count() * percent // 100
    ranked = radix_ranked(rows.where(long_enough), "score", "doc_id")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    rest = rows.where(~long_enough).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
