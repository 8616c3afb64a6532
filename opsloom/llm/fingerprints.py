"""SimHash fingerprints and the search for all fingerprints within a Hamming radius.

A term is a run of ``TERM`` words (a shorter text is one term); its weight is how often the text has it. Each bit of
the hash of a term votes with that weight for or against the bit of the fingerprint; ties and texts without words
give 0. The share of bits in which two fingerprints differ estimates the angle between the weighted term vectors,
so the likeness is the cosine of that angle, 0 where it is negative.

For the search the bits are cut into ``blocks``; fingerprints within ``radius`` bits agree in at least blocks -
radius of them. There is a table for every choice of that many blocks, holding the fingerprints with the chosen
blocks in front; entries that agree in front are compared in full. This finds every pair within the radius.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.shared import slices, stored, text_key
from opsloom.llm.words import mix, shingles, words

BITS, TERM = 128, 3
RADIUS, BLOCKS = 3, 5
_SECOND = np.uint64(0xA0761D6478BD642F)
#: For each byte, its bits as eight bytes of a word, the first bit in the lowest byte.
_LANES = np.packbits(
    np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")[:, :, None].repeat(8, 2)
    * np.array([1] + [0] * 7, np.uint8),
    axis=2,
    bitorder="little",
).reshape(256, 8).view("<u8").reshape(256)
#: Votes that a byte can count.
_RUN = 255


def fingerprints(raw: np.ndarray, bounds: np.ndarray, term: int = TERM) -> np.ndarray:
    """A fingerprint of 16 bytes for each text of a batch."""
    hashes, _, _, per_text = words(raw, bounds)
    terms, ends = shingles(hashes, per_text, term)
    bits = np.stack([terms, mix(terms ^ _SECOND)], axis=1).view(np.uint8)
    n = np.diff(ends)
    ones = np.zeros((len(n), BITS), np.int32)
    runs = -(-n // _RUN)
    filled = np.flatnonzero(runs)
    if len(filled):
        first = np.cumsum(runs) - runs
        number = np.arange(int(runs.sum())) - np.repeat(first, runs)
        starts = np.repeat(ends[:-1], runs) + number * _RUN
        votes = np.add.reduceat(_LANES[bits], starts, axis=0)
        votes = votes.view(np.uint8).reshape(len(starts), BITS)
        ones[filled] = np.add.reduceat(votes, first[filled], axis=0, dtype=np.int32)
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little")


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of the estimated angle between texts, from 0 to 1."""
    apart = np.unpackbits(a ^ b, axis=1).sum(axis=1)
    return np.where(apart == 0, 1.0, np.clip(np.cos(np.pi * apart / BITS), 0, 1))


def _of_texts(texts: list[str]) -> np.ndarray:
    out = [fingerprints(raw, bounds) for _, _, raw, bounds in slices(pa.array(texts, pa.string()))]
    return np.concatenate(out) if out else np.zeros((0, BITS // 8), np.uint8)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (hexadecimal) per row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = _of_texts([t or "" for t in batch.column("text").to_pylist()])
            shown = pa.array([m.tobytes().hex() for m in marks], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), shown], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by as many first characters of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted; each row that is no guest is followed by the next document of its range."""
    held: list[tuple] = []
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("place", "guest", "doc_id", "text"))
        rows = held + list(zip(*columns, strict=True))
        held = rows[-1:]
        yield _compared([(a, b) for a, b in zip(rows, rows[1:], strict=False) if a[0] == b[0] and not a[1]])


def _compared(pairs: list[tuple]) -> pa.RecordBatch:
    texts = [a[3] for a, _ in pairs]
    changed = [edited(a[3], b[3]) for a, b in pairs]
    own, new = _of_texts(texts), _of_texts(changed)
    following = _of_texts([b[3] for _, b in pairs])
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    columns = [
        pa.array([a[2] for a, _ in pairs], pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in changed], pa.string()),
        pa.array([m.tobytes().hex() for m in own], pa.string()),
        pa.array([m.tobytes().hex() for m in new], pa.string()),
        pa.array(likeness(own, new), pa.float64()),
        pa.array(likeness(own, following), pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=names)


def with_next(docs: DataFrame) -> DataFrame:
    """The rows above for every document and the next one in descending doc_id; after the last comes the first.

    Rows are cut into ranges of (doc_id, hash of the text), one sort per range, and each range gets a guest: the
    first document of the range below, or of all for the lowest. So no sort holds all rows, also where many have no
    id or the same one, and texts are shuffled once. Rows of equal doc_id are ordered by the hash of the text; null
    ids come last; a null text is empty. Rows that repeat id and text are in one range.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))
    ids = docs.select(key.alias("key"), text_key().alias("tie"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = ids.repartitionByRange(parts, "key", "tie").groupBy(F.spark_partition_id())
    ranged = ranged.agg(F.max(F.struct("key", "tie")).alias("top")).select("top.*")
    tops = sorted((r["key"], bytes(r["tie"])) for r in ranged.collect())  # a row per range
    host = {top: [i + 1] for i, top in enumerate(tops[:-1])}
    if tops:
        host.setdefault(tops[-1], []).append(0)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = set()  # rows that repeat need one guest a task
        for batch in batches:
            rows = list(zip(batch.column("key").to_pylist(), batch.column("tie").to_pylist(), strict=True))
            guests = []
            for i, row in enumerate(rows):
                if row in host and row not in sent:
                    sent.add(row)
                    guests += [(i, place) for place in host[row]]
            place = pa.array([bisect_left(tops, row) for row in rows], pa.int32())
            names = [*batch.schema.names, "place", "guest"]
            yield pa.RecordBatch.from_arrays([*batch.columns, place, pa.array([False] * len(rows))], names=names)
            if guests:
                part = batch.take(pa.array([i for i, _ in guests]))
                place = pa.array([place for _, place in guests], pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns, place, pa.array([True] * len(guests))], names=names)

    if not tops:
        rows = docs.select(F.lit(0).alias("place"), F.lit(True).alias("guest"), F.col("doc_id").cast("bigint"), "text").limit(0)
    else:
        text = F.coalesce("text", F.lit("")).alias("text")
        rows = docs.select(F.col("doc_id").cast("bigint"), text, key.alias("key"), text_key().alias("tie"))
        rows = rows.mapInArrow(deal, "doc_id bigint, text string, key bigint, tie binary, place int, guest boolean")
        # Of the guests of a range the first in order is the next document; guests follow the hosts.
        rows = rows.repartition("place").sortWithinPartitions("place", "guest", F.desc("key"), F.desc("tie"))
        rows = rows.select("place", "guest", "doc_id", "text")
    return rows.mapInArrow(
        _pairs,
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )


def within_radius(
    asked: DataFrame, stored_: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS
) -> DataFrame:
    """(asked, found, distance) for all distinct fingerprints (hexadecimal) within ``radius`` bits of each other."""
    if not radius < blocks <= BITS // 4:
        raise ValueError("blocks must be more than the radius, and whole hexadecimal digits")
    digits = BITS // 4
    bounds = [digits * i // blocks for i in range(blocks + 1)]
    pieces = [F.substring("print", low + 1, high - low) for low, high in zip(bounds, bounds[1:], strict=False)]
    tables = [
        F.concat(F.lit(f"{i}:"), *[pieces[b] for b in chosen])
        for i, chosen in enumerate(combinations(range(blocks), blocks - radius))
    ]

    def entries(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(F.col("fingerprint").alias("print")).where("print is not null").distinct()
        return rows.select(F.col("print").alias(name), F.explode(F.array(*tables)).alias("front"))

    def half(name: str, first: int):
        return F.conv(F.substring(name, first, 8), 16, 10).cast("bigint")

    apart = sum(
        (F.bit_count(half("asked", i).bitwiseXOR(half("found", i))) for i in range(1, digits, 8)), start=F.lit(0)
    )
    both = entries(asked, "asked").join(entries(stored_, "found"), "front")
    both = both.select("asked", "found", apart.cast("int").alias("distance")).where(F.col("distance") <= radius)
    return both.distinct()


def edited_and_next(docs: DataFrame, radius: int = RADIUS, every: int = 20) -> DataFrame:
    """:func:`with_next` with n_near: other documents within ``radius`` bits, for ids divisible by ``every``, else null."""
    rows = stored(with_next(docs), "fingerprints")
    asked = rows.where(F.col("doc_id") % every == 0)
    copies = rows.groupBy("fingerprint").agg(F.count("*").alias("copies"))
    found = within_radius(asked, rows, radius).join(copies, F.col("found") == F.col("fingerprint"))
    near = found.groupBy(F.col("asked").alias("fingerprint")).agg((F.sum("copies") - 1).alias("n_near"))
    near = stored(near, "near")
    return rows.join(near, "fingerprint", "left").withColumn(
        "n_near", F.when(F.col("doc_id") % every == 0, F.col("n_near"))
    )
