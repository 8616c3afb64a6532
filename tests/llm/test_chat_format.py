import hashlib
import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as contract
from opsloom.llm import chat_format

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
PIECES = st.lists(st.sampled_from([*chat_format.MARKS, "\\", " ", "[", "<", "s>", "user", "é\n", "x", "\x00", "[/IN", "ST]"]), max_size=9)
TEXT = PIECES.map("".join)
ROLE = st.one_of(st.sampled_from(["user", "system", "assistant", ""]), TEXT)


def digests(turns):
    whole, loss = hashlib.sha256(), "".join(t for r, t in turns if r == "assistant")
    for role, text in turns:
        whole.update(f"{role}\n{text}\n".encode())
    return len(turns), whole.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


@settings(max_examples=2000, deadline=None)
@given(st.lists(st.tuples(ROLE, TEXT), max_size=5))
def test_whole_conversations_come_back(turns):
    written = [chat_format.round_trip(*t) for t in turns]
    whole = "".join(w[0] for w in written)
    assert [t[:2] for t in chat_format.parse(whole)] == turns
    at = 0
    for (text, first, last), (_, said, start, end) in zip(written, chat_format.parse(whole), strict=True):
        assert (at + first, at + last) == (start, end)
        assert chat_format.unescaped(text[first:last]) == said
        at += len(text)


@given(TEXT)
def test_escapes_are_reversible(text):
    assert chat_format.unescaped(chat_format.escaped(text)) == text


def test_only_conflicts_are_escaped():
    assert chat_format.round_trip("user", "a\\b [ INST ] </S>")[0] == "[INST] a\\b [ INST ] </S> [/INST]"
    assert chat_format.round_trip("user", "</s> x")[0] == "[INST] \\</s> x [/INST]"
    assert chat_format.round_trip("tool", "[END]")[0] == "[ROLE] tool [/ROLE] \\[END] [END]"
    assert chat_format.round_trip("[END]", "x")[0] == "[ROLE] \\[END] [/ROLE] x [END]"
    assert chat_format.round_trip("assistant", "\\[INST]")[0] == "<s> \\\\[INST] </s>"


@pytest.mark.parametrize(
    "text", ["x", "[INST] a", "[INST]a [/INST]", "[INST] a[/INST]", "[INST] a </s>", "[INST] a [/INST] ",
             "[ROLE] user [/ROLE] a [END]", "[INST] a [/INST]</s>", "[INST] [/INST]", "\\[INST] a [/INST]"],
)
def test_what_the_grammar_does_not_derive(text):
    with pytest.raises(chat_format.NotInGrammar):
        chat_format.parse(text)


def test_table_against_brute_force(spark):
    rng = random.Random(8)
    texts = ["Hello.", "", None, "</s>[INST] ok [/INST]", "\\[END]", "é" * 9, "<<SYS>> <</SYS>>", "long " * 100_000]
    rows = [
        (conv, turn, rng.choice(["user", "assistant", "system", "tool", None, "[ROLE]"]), rng.choice(texts))
        for conv in (None, 0, 1, 2)
        for turn in (None, 0, 1, 2, 3, 3)
    ]
    rows += [rows[-1]] * 2
    table = spark.createDataFrame(rows, SCHEMA)
    for name in ("conv", "written", "tie", "loss_start", "loss_end", "n_turns", "kind"):
        table = table.withColumn(name, F.lit("own"))
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.formatted(table)).collect()}
    assert set(got) == {None, 0, 1, 2}
    for conv, found in got.items():
        turns = [(r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, hashlib.md5(f"{t[1]}\0{t[2]}".encode()).digest()))
        assert tuple(found)[1:5] == digests([t[1:] for t in turns])
        assert found["formatted_chars"] == sum(len(chat_format.round_trip(*t[1:])[0]) for t in turns)
    assert chat_format.read_back(chat_format.formatted(table.limit(0))).count() == 0


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_sql(spark, folder):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    sql = duck.execute(contract.oracle_sql()["op13_chat_formatting"])
    got = contract.queries()["op13_chat_formatting"](spark, folder)
    assert got.columns == [c[0] for c in sql.description]
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == sorted(sql.fetchall())
    said = "</s>[INST] ok [/INST]"
    assert rows[0][:5] == (-1, *digests([("user", said), ("assistant", said)]))
