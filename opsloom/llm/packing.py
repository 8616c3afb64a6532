"""Packing into length buckets whose boundaries minimise padding over the whole corpus.

A document is cut into pieces of at most ``max_tokens`` tokens. The histogram of piece lengths over all documents
has at most ``max_tokens`` bars, whatever the corpus; dynamic programming over it chooses the upper lengths
of ``buckets`` buckets so that the padding of all pieces to the length of their bucket is least. Inside a
bucket, batches of ``budget`` tokens (padding included) are formed: the pieces of a bucket are dealt by a
hash over groups of about ``GROUP`` pieces, as many as the histogram asks for, and numbered there; only the
last batch of a group may be short.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsloom.llm.shared import row_key, stored

MAX_TOKENS, BUCKETS, BUDGET = 4096, 12, 65536
GROUP = 5_000


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets with the least padding; lengths are distinct and ascending.

    cost(i, j) pads lengths i..j-1 to the last of them. The best first cut moves monotonically, so each layer
    is solved by divide and conquer.
    """
    n = len(lengths)
    if n == 0:
        return []
    number = np.concatenate(([0], np.cumsum(counts))).astype(np.float64)
    tokens = np.concatenate(([0], np.cumsum(counts * lengths))).astype(np.float64)
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    cuts = []
    for _ in range(min(buckets, n)):
        layer, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        layer[0] = 0.0
        stack = [(1, n, 0, n - 1)]
        while stack:
            low, high, first, last = stack.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = np.arange(first, min(last, j - 1) + 1)
            cost = best[i] + lengths[j - 1] * (number[j] - number[i]) - (tokens[j] - tokens[i])
            at = int(np.argmin(cost))
            layer[j], cut[j] = cost[at], i[at]
            stack += [(low, j - 1, first, int(i[at])), (j + 1, high, int(i[at]), last)]
        best = layer
        cuts.append(cut)
    bounds, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(cut[j])
    return bounds[::-1]


def pieces(docs: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(doc_id, row_key, piece, start, n_tokens): whole texts cut into pieces, a token being a code point."""
    n = F.length(F.coalesce("text", F.lit("")))
    number = F.ceil(n / max_tokens).cast("int")
    rows = docs.select("doc_id", row_key().alias("row_key"), n.alias("n"), number.alias("number")).where("number > 0")
    rows = rows.select("doc_id", "row_key", "n", F.explode(F.sequence(F.lit(0), F.col("number") - 1)).alias("piece"))
    start = F.col("piece") * max_tokens
    length = F.least(F.col("n") - start, F.lit(max_tokens)).cast("int")
    return rows.select("doc_id", "row_key", "piece", start.cast("bigint").alias("start"), length.alias("n_tokens"))


def packed(
    docs: DataFrame, max_tokens: int = MAX_TOKENS, buckets: int = BUCKETS, budget: int = BUDGET
) -> DataFrame:
    """One row per piece: doc_id, piece, start, n_tokens, bucket (its padded length), batch, slot.

    batch is a text that names bucket, group and number; slot counts from 0 within it. A null or empty text
    has no piece. Rows that repeat, ids that are null and columns beyond doc_id and text make no difference.
    """
    if budget < max_tokens:
        raise ValueError("a batch must hold a longest piece")
    rows = stored(pieces(docs, max_tokens), "pieces")
    bars = rows.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()  # at most max_tokens rows
    lengths = np.array(sorted(r["n_tokens"] for r in bars), np.int64)
    count = {r["n_tokens"]: r["n"] for r in bars}
    counts = np.array([count[x] for x in lengths.tolist()], np.int64)
    bounds = boundaries(lengths, counts, buckets)
    if not bounds:
        bounds = [max_tokens]
    upper = F.coalesce(*[F.when(F.col("n_tokens") <= b, F.lit(b)) for b in bounds])
    low, groups = 0, []
    for b in bounds:
        inside = int(counts[(lengths > low) & (lengths <= b)].sum())
        groups.append((F.lit(b), F.lit(max(1, -(-inside // GROUP)))))
        low = b
    rows = rows.withColumn("bucket", upper)
    number = F.create_map(*chain.from_iterable(groups))[F.col("bucket")]
    mark = F.xxhash64("row_key", "piece")
    rows = rows.withColumn("group", F.pmod(mark, number)).withColumn("mark", F.xxhash64(F.lit("order"), "row_key", "piece"))
    order = Window.partitionBy("bucket", "group").orderBy("mark", "row_key", "piece")
    capacity = F.expr(f"{budget} div bucket").cast("int")
    rows = rows.withColumn("at", F.row_number().over(order) - 1)
    return rows.select(
        "doc_id",
        "piece",
        "start",
        "n_tokens",
        F.col("bucket").cast("int").alias("bucket"),
        F.concat_ws("-", "bucket", "group", F.floor(F.col("at") / capacity)).alias("batch"),
        F.pmod(F.col("at"), capacity).alias("slot"),
    )
