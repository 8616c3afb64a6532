import random
import re

import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SMALL = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words_of(text):
    return WORD.findall((text or "").translate(FOLD))


def shingle_counts(text, size=5):
    words = words_of(text)
    if not words:
        return {}
    counts = {}
    for i in range(max(1, len(words) - size + 1)):
        gram = tuple(words[i : i + size])
        counts[gram] = counts.get(gram, 0) + 1
    return counts


def jaccard(a, b):
    keys = set(a) | set(b)
    low = sum(min(a.get(k, 0), b.get(k, 0)) for k in keys)
    high = sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
    return low / high if high else 0.0


def sentence(rng, n, vocabulary=2000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def small_rows(small_docs):
    return sorted((r["doc_id"], r["text"]) for r in small_docs.select("doc_id", "text").collect())


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    long = "\n".join(sentence(rng, 40) for _ in range(2000))
    plain = sentence(rng, 60)
    return [
        (None, None, None, None, None),
        (None, plain, "en", None, 3),
        (1, "", "en", "a", 0),
        (2, " \n\n ", None, "a", 4),
        (3, "one", "en", "a", 3),
        (4, plain, "en", "a", None),
        (4, plain, "en", "a", None),
        (4, plain + " tail", "en", "b", 1),
        (5, long, "en", "a", 1),
        (6, long + "\nend", "de", "a", 1),
        (7, "\x00é中\U0001f600   a1", "fr", "a", 1),
        (8, None, "en", "a", 1),
        (9, "!!! ... ???", "en", "a", 1),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The odd rows with extra columns whose names operators use themselves."""
    docs = spark.createDataFrame(odd_rows, DOCUMENTS)
    for name in ("row_key", "node", "words", "size", "score", "rejected", "lang_pred", "n_lines", "class_id", "bucket", "hits"):
        docs = docs.withColumn(name, F.lit("own"))
    return docs


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENTS)
