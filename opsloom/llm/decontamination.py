"""Benchmark decontamination by winnowing: which words of a document are shared with benchmark items.

Every k-gram of words is hashed; of each window of w consecutive k-grams the least hash is kept. A span of
w + k - 1 shared words has a whole window in common and so a common kept hash: with k = 8 and w = 6 every
shared span of 13 words is found. Fingerprints of the items are joined with those of the documents; each hit
names a diagonal (offset of the item in the document), on which the words of both are compared, and every
span of at least 13 equal words counts. An item of fewer words is one span; those lengths are few and
their n-grams are all kept. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.llm.shared import row_key, small, stored

WINDOW, K = 13, 8
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Low bits of a fingerprint that hold the position of its k-gram.
_PLACE_BITS = 24
#: Fingerprints that are broadcast at most (about 30 MB); more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def word_array(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _placed(value: Column, place: Column) -> Column:
    """A hash with the position in its low bits."""
    return F.shiftleft(F.shiftright(value, _PLACE_BITS), _PLACE_BITS).bitwiseOR(place.cast("bigint"))


def _grams(words: Column, size: Column, n: int) -> Column:
    """Placed hashes of all n-grams, in order."""
    return F.transform(
        F.sequence(F.lit(1), size - (n - 1)),
        lambda i: _placed(F.xxhash64(F.lit(n), F.slice(words, i, n)), i - 1),
    )


def _winnowed(grams: Column, size: Column, window: int, k: int) -> Column:
    """The least placed hash of every window of k-grams, each once."""
    w = window - k + 1
    least = F.transform(
        F.sequence(F.lit(0), size - window), lambda i: F.least(*[F.get(grams, i + j) for j in range(w)])
    )
    return F.array_distinct(least)


def fingerprints(items: DataFrame, keep: list[str], lengths: list[int], window: int, k: int) -> DataFrame:
    """``keep`` columns with n (length of the gram), leads, gram and place, from ``items`` with words and size.

    One row of each item leads, also where it has no gram. n is 0 for winnowed k-grams;
    for each of ``lengths`` below the window all n-grams are kept.
    """
    none = F.array().cast("array<bigint>")
    rows = items.withColumn("grams", F.when(F.col("size") >= window, _grams(F.col("words"), F.col("size"), k)))
    marks = F.when(F.col("size") >= window, _winnowed(F.col("grams"), F.col("size"), window, k)).otherwise(none)
    kinds = [(0, marks)]
    for n in lengths:
        kinds.append((n, F.when(F.col("size") >= n, _grams(F.col("words"), F.col("size"), n)).otherwise(none)))
    parts = F.array(*[F.struct(F.lit(n).alias("n"), marks.alias("marks")) for n, marks in kinds])
    rows = rows.select(*keep, F.explode(parts).alias("kind"))
    rows = rows.select(*keep, F.col("kind.n").alias("n"), F.posexplode_outer("kind.marks").alias("turn", "mark"))
    return rows.select(
        *keep,
        "n",
        (F.coalesce("turn", F.lit(0)) + F.col("n") == 0).alias("leads"),
        F.shiftright("mark", _PLACE_BITS).alias("gram"),
        F.col("mark").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).cast("int").alias("place"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """One row per document: doc_id, row_key, n_words, n_hit, n_items, items_sha256, contaminated.

    A document is contaminated if at least a twentieth of its words, and one at least, lie in spans shared
    with items. Null and wordless texts have no words and are clean; items without words are left out; items
    with a null item_id count for the words but not among the items. Items that repeat an item_id are one item.
    Documents that repeat (id and text) are given once. Texts have at most 16 million words.
    """
    items = benchmark.select("item_id", word_array(F.col("text")).alias("words"))
    items = stored(
        items.distinct().withColumn("size", F.size("words")).where("size > 0").withColumn(
            "item", F.xxhash64("item_id", "words")
        ),
        "items",
    )
    lengths = sorted(r[0] for r in items.where(F.col("size") < window).select("size").distinct().collect())
    own = items.where((F.col("size") >= window) | F.col("size").isin(lengths))
    marks = fingerprints(own, ["item", "size"], lengths, window, k).where(
        F.col("gram").isNotNull() & (((F.col("n") == 0) | (F.col("n") == F.col("size"))))
    )
    marks = small(stored(marks.select("n", "gram", "item", F.col("place").alias("at")), "marks"), BROADCAST_ROWS)

    rows = docs.select("doc_id", row_key().alias("row_key"), word_array(F.col("text")).alias("words"))
    rows = rows.withColumn("size", F.size("words"))
    mine = fingerprints(rows, ["doc_id", "row_key", "size"], lengths, window, k)
    # One row per document leads; of the others those that meet an item are kept. No shuffle up to here.
    met = mine.join(marks, ["n", "gram"], "left").where("leads or item is not null")
    met = met.select("doc_id", "row_key", "size", "leads", "item", (F.col("place") - F.col("at")).alias("shift"))
    met = stored(met, "met")
    found = met.where("item is not null").groupBy("row_key").agg(F.collect_set(F.struct("item", "shift")).alias("hits"))
    spans = docs.select(row_key().alias("row_key"), "text").join(found, "row_key").dropDuplicates(["row_key"])
    spans = spans.withColumn("words", word_array(F.col("text"))).select("row_key", "words", "hits")
    longest = items.agg(F.max("size")).first()[0] or 0
    spans = spans.select(
        "row_key",
        F.explode(
            F.transform(
                "hits",
                lambda h: F.struct(
                    h["item"].alias("item"),
                    h["shift"].alias("shift"),
                    F.greatest(h["shift"], F.lit(0)).alias("low"),
                    F.slice("words", F.greatest(h["shift"], F.lit(0)) + 1, F.lit(longest)).alias("part"),
                ),
            )
        ).alias("hit"),
    ).select("row_key", "hit.*")
    spans = spans.join(items, "item")
    # Position j of the item meets word j + shift of the document; part begins at word low.
    equal = F.transform(
        F.sequence(F.lit(0), F.col("size") - 1),
        lambda j: F.coalesce(F.get("part", j + F.col("shift") - F.col("low")) == F.get("words", j), F.lit(False)),
    )
    need = F.least(F.col("size"), F.lit(window))
    # The one-element array binds the comparison, which is then made once and not for every start.
    starts = F.transform(
        F.array(equal),
        lambda e: F.filter(
            F.sequence(F.lit(0), F.col("size") - need), lambda j: F.forall(F.slice(e, j + 1, need), lambda x: x)
        ),
    )[0]
    places = F.flatten(
        F.transform(starts, lambda j: F.sequence(j + F.col("shift"), j + F.col("shift") + need - 1))
    )
    spans = spans.select("row_key", "item_id", F.array_distinct(places).alias("places"))
    spans = spans.where(F.size("places") > 0)
    words = spans.select("row_key", F.explode("places").alias("place")).distinct()
    words = words.groupBy("row_key").agg(F.count("*").alias("n_hit"))
    names = spans.groupBy("row_key").agg(F.collect_set(F.col("item_id").cast("string")).alias("names"))
    base = met.where("leads").groupBy("row_key").agg(F.min("doc_id").alias("doc_id"), F.min("size").alias("n_words"))
    out = base.join(words, "row_key", "left").join(names, "row_key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    listed = F.array_join(F.array_sort(F.coalesce("names", F.array().cast("array<string>"))), ",")
    return out.select(
        "doc_id",
        "row_key",
        F.col("n_words").cast("bigint").alias("n_words"),
        n_hit.alias("n_hit"),
        F.greatest(F.size("names"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns; rows that repeat are judged alike."""
    bad = contamination(docs, benchmark).where("contaminated").select(F.col("row_key").alias("__corpus_key"))
    return docs.join(bad, row_key() == F.col("__corpus_key"), "left_anti")
