import hashlib
import heapq
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from opsloom.llm import conversation_repair
from opsloom.llm.queries import op12_conversation_repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
INK = re.compile(r"[^\x20\x09-\x0D]")
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(name.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def key(row):
    conv, turn, role, text = row
    name = "n" if conv is None else f"c{conv}"
    return turn is not None, turn or 0, hashlib.md5("\0".join((name, role, text)).encode()).digest()


def cheapest(turns):
    """Best-first search over all edits: cost, audit and repaired lines. ``turns``: (role, text, fault)."""
    due = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    queue, seen = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, lines = heapq.heappop(queue)
        if i == len(turns) and state in ("", "a"):
            return cost, audit, "\n".join(lines)
        if (i, state) in seen:
            continue
        seen.add((i, state))

        def go(more, letter, to, at, role=None, text=""):
            line = () if role is None else (f"{role}:{text}",)
            heapq.heappush(queue, (cost + more, audit + letter, at, to, lines + line))

        role = due[state]
        go(3, "I", role[0], i, role)
        if i == len(turns):
            continue
        name, text, fault = turns[i]
        go(4, "D", state, i + 1)
        if fault in ("blank", "duplicate"):
            continue
        extra = 3 if fault == "truncated" else 0
        go(3 + extra, "R", role[0], i + 1, role, text)
        if name and state + name[0] in ("s", "u", "su", "ua", "au"):
            go(extra, "K", name[0], i + 1, name, text)


def brute_force(rows, everyone):
    result = []
    for conv in everyone:
        own = sorted((r for r in rows if r[0] == conv), key=key)
        counts, seen, turns = dict.fromkeys(("blank", "duplicate", "truncated"), 0), set(), []
        for _, _, role, text in own:
            ink = INK.findall(text)
            fault = None
            if not ink:
                fault = "blank"
            elif (role, text) in seen:
                fault = "duplicate"
            elif ink[-1] not in ".!?":
                fault = "truncated"
            seen.add((role, text))
            counts[fault] = counts.get(fault, 0) + 1
            turns.append((role, text, fault))
        numbers = [r[1] for r in own if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, text = cheapest(turns)
        digest = hashlib.sha256(text.encode()).hexdigest()
        result.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest))
    return sorted(result, key=str)


def random_rows(rng, convs, longest):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "umpire", ""]
    texts = ["Yes.", "no", " \t", "", "What?\n", "Go on!", "a.b", "x"]
    rows = []
    for conv in range(convs):
        turn = 0
        for _ in range(rng.randrange(longest + 1)):
            turn += rng.choice([0, 1, 1, 1, 3])
            text = rng.choice(texts) if rng.random() < 0.5 else f"{rng.choice(texts)} {rng.randrange(99)}."
            rows.append((conv, turn if rng.random() < 0.95 else None, rng.choice(roles), text))
    return rows


def report(spark, rows, everyone=None):
    table = spark.createDataFrame(rows, SCHEMA)
    found = conversation_repair.repair_report(everyone or table, table).select(*COLUMNS).collect()
    return sorted((tuple(r) for r in found), key=str)


@pytest.mark.parametrize("block_bits", [0, 2, 10])
def test_against_search_over_all_edits(spark, monkeypatch, block_bits):
    monkeypatch.setattr(conversation_repair, "BLOCK_BITS", block_bits)
    rows = random_rows(random.Random(block_bits), 60, 14)
    assert report(spark, rows) == brute_force(rows, {r[0] for r in rows})


def test_one_conversation_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "BLOCK_BITS", 5)
    rng = random.Random(2)
    rows = [(1, i, rng.choice(["user", "assistant"]), f"{i}{rng.choice('..x')}") for i in range(900)]
    rows += [(2, 0, "user", "Hi.")] * 400  # one turn repeated, over many blocks
    rows += random_rows(rng, 1, 40)
    assert report(spark, rows) == brute_force(rows, {r[0] for r in rows})


def test_least_audit_of_equal_costs(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (2, 0, "assistant", "c."), (3, 0, "user", "d"), (4, 0, "system", "e.")]
    found = {r[0]: (r[6], r[7]) for r in report(spark, rows)}
    # Inserting costs 3; deleting one of two and inserting costs more.
    assert found == {1: (3, "KR"), 2: (3, "IK"), 3: (4, "D"), 4: (4, "D")}


def test_ranks_select_the_least_path():
    # Two paths of one node: D then R, or I then D; and one of three letters from another.
    source, letter = np.array([0, 0, 1, 2, 3]), np.array([1, 0, 0, 3, 2])
    target = np.array([1, 2, 4, 4, 0])
    who, arcs = conversation_repair._ranked_paths(source, letter, target, 5, np.array([0, 3]))
    assert (who.tolist(), arcs.tolist()) == ([0, 0, 1, 1, 1], [1, 3, 4, 1, 3])


def test_damage(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", None]), rng.choice(["a. b?", None])) for c in (None, 1, 2) for t in (None, *range(90))]
    got = conversation_repair.damaged(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(damage(rows), key=str)


def test_odd_rows_and_empty_tables(spark):
    long = "word " * 200_000
    rows = [
        (None, None, None, None), (None, None, None, None), (None, 5, "user", "Hello."), (1, None, "user", long),
        (1, 3, "assistant", long + "."), (1, 3, "assistant", long + "."), (2, 0, "", "Empty role."), (3, 7, "user", ""),
    ]
    table = spark.createDataFrame(rows, SCHEMA)
    for name in ("conv", "key", "pos", "block", "at", "seq", "kind", "audit", "cost"):
        table = table.withColumn(name, F.lit("own"))
    more = spark.createDataFrame([(9, 0, "user", "gone")], SCHEMA).unionByName(table.select(*SCHEMA.split()[::2]))
    found = conversation_repair.repair_report(more, table).select(*COLUMNS).collect()
    filled = [tuple(" " if x is None and i > 1 else x for i, x in enumerate(r)) for r in rows]
    assert sorted((tuple(r) for r in found), key=str) == brute_force(filled, [None, 1, 2, 3, 9])
    assert conversation_repair.repair_report(table.limit(0)).count() == 0


def test_turns_after_repair(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "user", "x"), (2, 0, "user", "Go."), (2, 1, "tool", "So.")], SCHEMA)
    found = conversation_repair.pieces(conversation_repair.faults(rows))
    turns = conversation_repair.repaired(rows, found).select("conv_id", "seq", "role", "text", "edit").collect()
    assert sorted(tuple(r) for r in turns) == [
        (1, 0, "user", "", "I"), (1, 1, "assistant", "Hi.", "K"), (2, 0, "user", "Go.", "K"), (2, 1, "assistant", "So.", "R"),
    ]


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_sql_and_search(spark, folder):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    rows = duck.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    sql = duck.execute(contract.oracle_sql()["op12_conversation_repair"])
    got = op12_conversation_repair(spark, folder)
    assert sorted(got.columns) == sorted(c[0] for c in sql.description)
    expected = sorted((tuple(r) for r in sql.fetchall()), key=str)
    assert sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=str) == expected
    assert expected == brute_force(damage(rows), {r[0] for r in rows})
