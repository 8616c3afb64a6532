"""Repair of conversations: the cheapest edits that make the roles alternate, and the least audit among them.

A conversation is read as a path through states (nothing yet, system, user, assistant). Every turn is kept,
given the role that is due, or deleted, and empty turns may be inserted, each at a cost; a conversation is whole
if its role initials read ``(s?(ua)+)?``. The letters of the edits (D, I, K, R) make up the audit.

Turns are put in one global order and cut into blocks of consecutive turns, so a conversation of any length is
spread over tasks. Three steps follow:

* A cost DP runs backwards inside each block. Where a conversation goes on in the next block, the blocks' 4 x 4 cost
  matrices are multiplied by pointer doubling along the conversation, which gives the costs from each block's end.
* The arcs of the DP that lie on cheapest paths are nodes of a graph. They are ranked by their least audits of
  1, 2, 4, 8... letters: the rank of twice the length comes from the pair of an arc's own rank and that of
  the arc that its pointer leads to, and pointers are doubled. The least rank of a block's entry state names
  its path, and the doubled pointers list it. A letter leads from a node to one node only, so the least path
  of any length is unique and one pointer per arc is enough.
* The state in which a conversation enters each block comes from composing the blocks' maps of entry to exit states,
  by pointer doubling again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom.llm.shared import stored

BLOCK_BITS = 10
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Faults of a turn; the first that holds counts.
NONE, BLANK, DUPLICATE, CUT = 0, 1, 2, 3
#: Blanks of a text: the space and the five control characters from tab on.
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
ROLES = ("", "system", "user", "assistant")
#: States are nothing yet, after a system, user, assistant turn. The role due next, by state.
_DUE = np.array([2, 2, 3, 2])
#: [initial, state]: the state after a turn with this initial (0: another one, then s, u, a) is kept; -1: not allowed.
_KEPT = np.array([[-1, -1, -1, -1], [1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1]])
#: Adjacent initials that are in order.
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[1, 2] = _LEGAL[2, 3] = _LEGAL[3, 2] = True
#: Cost from the end of a conversation: the inserts that are still due.
_FINAL = np.array([0, 2 * INSERT, INSERT, 0])
_FAR = 1 << 40
_LETTERS = np.frombuffer(b"DIKR", np.uint8)


def conversation_key(conv_id: Column | str = "conv_id") -> Column:
    """A text without null per conversation, null being one of its own."""
    column = F.col(conv_id) if isinstance(conv_id, str) else conv_id
    return F.coalesce(F.concat(F.lit("c"), column.cast("string")), F.lit("n"))


def turn_key(conv: str = "conv", role: str = "role", text: str = "text") -> Column:
    """128 bits for a conversation's role and text, neither being null. Turns that repeat share it."""
    parts = F.concat_ws("\x00", conv, role, text)
    return F.unhex(F.md5(parts.cast("binary")))


def damaged(convs: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) as a careless collector leaves them, by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the turn, 1 empties its text, 2 takes the sentence ends out, 3 repeats it, 4 makes it the user's.
    Nulls of role and text become one space, and so do those of conv_id and turn in the checksum.
    """
    blank = F.lit(" ")
    conv, turn = (F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn"))
    name = F.concat(conv, F.lit(":"), turn)
    rows = convs.select(
        "conv_id",
        "turn",
        F.coalesce("role", blank).alias("role"),
        F.coalesce("text", blank).alias("text"),
        (F.crc32(name.cast("binary")) % 20).alias("kind"),
    ).where("kind <> 0")
    text = (
        F.when(F.col("kind") == 1, F.lit(""))
        .when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
    )
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", 1).when(first == "u", 2).when(first == "a", 3).otherwise(0)


def _filled(rows: DataFrame) -> DataFrame:
    """Rows with ``conv`` and ``key``; nulls of role and text are one space."""
    rows = rows.select(
        conversation_key().alias("conv"),
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    return rows.withColumn("key", turn_key())


def faults(rows: DataFrame) -> DataFrame:
    """(conv, turn, pos, block, initial, fault) per turn, stored; texts are not among them.

    pos counts all turns by conversation, turn (nulls first) and, in ties, a hash of role and text. A turn is blank
    (nothing but blanks), a duplicate (role and text stand earlier in the conversation), or cut (its last character
    that is not blank ends no sentence).
    """
    bare = F.rtrim("text", F.lit(BLANKS))
    light = _filled(rows).select(
        "conv",
        "turn",
        "key",
        _initial(F.col("role")).cast("byte").alias("initial"),
        (bare == "").alias("blank"),
        (~F.substring(bare, -1, 1).isin(*ENDS)).alias("cut"),
    )
    # Written, the numbers are the same for every reader; as the last key they let equal turns lie in two ranges.
    light = stored(light.withColumn("at", F.monotonically_increasing_id()), "turns")
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("key"), F.col("at")]
    light = light.repartitionByRange(*order).sortWithinPartitions(*order).drop("at")
    light = stored(light.withColumn("number", F.monotonically_increasing_id()), "ordered")
    light = light.withColumn("part", F.shiftright("number", 33))
    # One row per partition of the sorted table.
    starts = light.groupBy("part").agg(F.count("*").alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    pos = F.col("start") + F.col("number").bitwiseAND(F.lit((1 << 33) - 1))
    light = light.join(F.broadcast(starts), "part").withColumn("pos", pos)
    # Stored, so that adaptive execution can split the join where one turn is repeated very often.
    first = light.groupBy("key").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
    light = light.join(stored(first.drop("n"), "repeated"), "key", "left")
    fault = (
        F.when(F.col("blank"), BLANK)
        .when(F.col("pos") > F.col("first"), DUPLICATE)
        .when(F.col("cut"), CUT)
        .otherwise(NONE)
    )
    block = F.shiftright("pos", BLOCK_BITS)
    return stored(
        light.select("conv", "turn", "pos", block.alias("block"), "initial", fault.cast("byte").alias("fault")), "faults"
    )


class _Block:
    """The turns of a block, cut into segments of one conversation each."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("pos")
        self.conv = table.column("conv").to_pylist()
        self.number = table.column("block")[0].as_py()
        self.initial = table.column("initial").to_numpy().astype(np.int64)
        self.fault = table.column("fault").to_numpy()
        n = len(self.conv)
        self.first = np.array([i for i in range(n) if i == 0 or self.conv[i] != self.conv[i - 1]], np.int64)
        self.last = np.append(self.first[1:], n)
        self.fixed = np.isin(self.fault, (BLANK, DUPLICATE))  # to be deleted
        self.extra = np.where(self.fault == CUT, TRUNCATED, 0)

    def step(self, r: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, ...]:
        """Costs from turns ``r`` on (one row per turn, four states), and those of D, K and R, given those after them."""
        delete = after + DELETE
        target = _KEPT[self.initial[r]]
        extra = np.where(self.fixed[r], _FAR, self.extra[r])[:, None]
        keep = np.where(target >= 0, np.take_along_axis(after, np.maximum(target, 0), 1), _FAR) + extra
        rerole = after[:, _DUE] + REROLE + extra
        least = np.minimum(np.minimum(delete, keep), rerole)
        # A third insert would lead back to a state that was left at no cost.
        costs = np.minimum(least, np.minimum(least[:, _DUE] + INSERT, least[:, _DUE[_DUE]] + 2 * INSERT))
        return costs, delete, keep, rerole


def _matrices(table: pa.Table) -> pa.Table:
    """Of a block's first and last segment: costs from each state at its start to each state at its end."""
    block = _Block(table)
    out = {"conv": [], "block": [], "m": [], "final_initial": []}
    for s in sorted({0, len(block.first) - 1}):
        after = np.where(np.eye(4, dtype=bool), 0, _FAR)  # one row per state at the end
        for r in range(block.last[s] - 1, block.first[s] - 1, -1):
            after = np.minimum(block.step(np.full(4, r), after)[0], _FAR)
        out["conv"].append(block.conv[block.first[s]])
        out["block"].append(block.number)
        out["m"].append(after.T.reshape(-1).tolist())
        out["final_initial"].append(int(block.initial[block.last[s] - 1]))
    return pa.table(out, pa.schema([("conv", pa.string()), ("block", pa.int64()), ("m", pa.list_(pa.int64())), ("final_initial", pa.int32())]))


_PATHS = pa.schema(
    [("conv", pa.string()), ("block", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32()), ("begins", pa.bool_()),
     ("goes_on", pa.bool_()), ("cost", pa.int64()), ("illegal", pa.int64()), ("audit", pa.string())]
)


def _ranked_paths(source: np.ndarray, letter: np.ndarray, target: np.ndarray, nodes: int, starts: np.ndarray) -> tuple:
    """Of each start node the least path over the arcs: (start, arc) along all paths, in order.

    ``letter`` is 0..3 and differs among the arcs of a node. Arc m stands for the end of a path.
    """
    m = len(source)
    by_node = np.lexsort((letter, source))
    least = np.full(nodes, m, np.int64)
    ahead = source[by_node]
    new = np.ones(m, bool)
    new[1:] = ahead[1:] != ahead[:-1]
    least[ahead[new]] = by_node[new]
    pointer = np.append(least[target], m)
    rank = np.append(letter.astype(np.int64) + 1, 0)  # an end sorts before every letter
    doubled = []
    while (pointer != m).any():
        doubled.append(pointer)
        _, rank = np.unique(rank * (m + 5) + rank[pointer], return_inverse=True)
        pointer = pointer[pointer]
    # The least whole audit of each node, by the ranks.
    by_node = np.lexsort((rank[:m], source))
    least[source[by_node][::-1]] = by_node[::-1]
    who, place, arcs = np.arange(len(starts)), np.zeros(len(starts), np.int64), least[starts]
    for k, pointer in enumerate(doubled):
        further = pointer[arcs]
        there = further != m
        who = np.concatenate((who, who[there]))
        place = np.concatenate((place, place[there] + (1 << k)))
        arcs = np.concatenate((arcs, further[there]))
    order = np.lexsort((place, who))
    return who[order], arcs[order]


def _paths(table: pa.Table, edges: pa.Table) -> pa.Table:
    """Cost, audit and exit state of every segment of a block, by entry state.

    ``edges`` has at most one row: the costs from the end of the block's last segment, if that goes on, and the
    initial of the turn before the block, if its first segment is not the beginning of its conversation.
    """
    if not table.num_rows:
        return _PATHS.empty_table()
    block = _Block(table)
    n, segments = len(block.conv), len(block.first)
    ends = before = None
    if edges.num_rows:
        ends, before = edges.column("ends")[0].as_py(), edges.column("before")[0].as_py()
    costs = np.empty((n + segments, 4), np.int64)
    costs[n:] = _FINAL
    if ends is not None:
        costs[n + segments - 1] = ends
    parts = []
    length = block.last - block.first
    state = np.arange(4)
    for d in range(1, int(length.max()) + 1):
        s = np.flatnonzero(length >= d)
        r = block.last[s] - d
        below = n + s if d == 1 else r + 1
        costs[r], delete, keep, rerole = block.step(r, costs[below])
        here = costs[r]
        source = 4 * r[:, None] + state
        # Letters in the order of ASCII: delete, insert, keep, rerole.
        options = (
            (delete, 4 * below[:, None] + state),
            (here[:, _DUE] + INSERT, 4 * r[:, None] + _DUE),
            (keep, 4 * below[:, None] + np.maximum(_KEPT[block.initial[r]], 0)),
            (rerole, 4 * below[:, None] + _DUE),
        )
        for code, (cost, target) in enumerate(options):
            best = cost == here
            target = np.broadcast_to(target, best.shape)
            parts.append((source[best], np.full(int(best.sum()), code), target[best]))
    closing = np.arange(segments - (ends is not None))
    for q in (1, 2):  # inserts at the end of a conversation
        parts.append((4 * (n + closing) + q, np.ones(len(closing), np.int64), 4 * (n + closing) + _DUE[q]))
    source, letter, target = (np.concatenate(p) for p in zip(*parts, strict=True))
    begins = np.ones(segments, bool)
    begins[0] = before is None
    segment = np.concatenate([np.full(1 if b else 4, i) for i, b in enumerate(begins)])
    entry = np.concatenate([[0] if b else state for b in begins])
    starts = 4 * block.first[segment] + entry
    who, arcs = _ranked_paths(source, letter, target, 4 * (n + segments), starts)
    bounds = np.searchsorted(who, np.arange(len(starts) + 1))
    audits = _LETTERS[letter[arcs]].tobytes().decode()
    pairs = ~_LEGAL[block.initial[:-1], block.initial[1:]]
    pairs = np.concatenate(([before is not None and not _LEGAL[before, block.initial[0]]], pairs))
    pairs[block.first[1:]] = False
    illegal = np.add.reduceat(pairs.astype(np.int64), block.first)
    last = segment == segments - 1
    return pa.table(
        {
            "conv": [block.conv[i] for i in block.first[segment].tolist()],
            "block": np.full(len(starts), block.number),
            "entry": entry.astype(np.int32),
            "leave": (target[arcs[bounds[1:] - 1]] % 4).astype(np.int32),
            "begins": begins[segment],
            "goes_on": last & (ends is not None),
            "cost": costs.reshape(-1)[starts],
            "illegal": illegal[segment],
            "audit": [audits[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)],
        },
        _PATHS,
    )


def _product(a: str, b: str) -> Column:
    """The least-plus product of two 4 x 4 matrices held as arrays."""
    def cell(i: int, j: int) -> Column:
        return F.least(*[F.get(a, F.lit(4 * i + k)) + F.get(b, F.lit(4 * k + j)) for k in range(4)], F.lit(_FAR))

    return F.array(*[cell(i, j) for i in range(4) for j in range(4)])


def _doubled(rows: DataFrame, value: str, joined: Column, label: str) -> DataFrame:
    """(conv, block, value): ``value`` combined along each conversation by pointer doubling.

    ``to`` names the block that a row's pointer leads to; ``joined`` combines ``value`` with ``other``.
    """
    while True:
        ahead = rows.select("conv", F.col("block").alias("to"), F.col(value).alias("other"), F.col("to").alias("further"))
        both = F.when(F.col("other").isNull(), F.col(value)).otherwise(joined)
        rows = rows.join(ahead, ["conv", "to"], "left")
        rows = stored(rows.select("conv", "block", both.alias(value), F.col("further").alias("to")), label)
        # A pointer beyond the conversation's last block meets no row and is null from then on.
        if rows.where(F.col("to").isNotNull()).isEmpty():
            return rows.drop("to")


def _chosen(found: DataFrame) -> DataFrame:
    """(conv, block, cost, illegal, audit) of every segment, a row each, on the path of the whole conversation."""
    columns = ["conv", "block", "begins", "cost", "illegal", "audit"]
    # The block in which a conversation begins is entered in state 0, so it leads every entry state to one exit.
    chain = found.where(~F.col("begins") | F.col("goes_on")).groupBy("conv", "block").agg(
        F.map_from_entries(F.collect_list(F.struct("entry", "leave"))).alias("leave")
    )
    exits = F.array(*[F.coalesce(F.col("leave")[q], F.col("leave")[0]) for q in range(4)])
    chain = chain.select("conv", "block", exits.alias("exits"), (F.col("block") - 1).alias("to"))
    through = F.transform("other", lambda q: F.get("exits", q))
    chain = _doubled(chain, "exits", through, "states")
    entry = chain.select("conv", (F.col("block") + 1).alias("block"), F.get("exits", F.lit(0)).alias("entry"))
    later = found.where(~F.col("begins")).join(entry, ["conv", "block", "entry"]).select(*columns)
    return found.where("begins").select(*columns).unionByName(later)


def pieces(turns: DataFrame) -> DataFrame:
    """(conv, block, begins, cost, illegal, audit) per conversation and block, from :func:`faults`; stored."""
    light = turns.select("conv", "pos", "block", "initial", "fault")
    matrices = light.groupBy("block").applyInArrow(_matrices, "conv string, block bigint, m array<bigint>, final_initial int")
    matrices = stored(matrices, "matrices")
    linked = matrices.select("conv", (F.col("block") - 1).alias("block")).distinct()
    pairs = matrices.join(linked, ["conv", "block"], "left_semi")  # segments that go on
    # Of a block's two segments only the last goes on and only the first has begun before.
    chain = matrices.select("conv", "block", "m", (F.col("block") + 1).alias("to"))
    products = _doubled(chain, "m", _product("m", "other"), "products")
    final = F.array(*[F.least(*[F.get("m", F.lit(4 * i + j)) + int(_FINAL[j]) for j in range(4)]) for i in range(4)])
    rest = products.select("conv", (F.col("block") - 1).alias("block"), final.alias("ends"))
    ends = pairs.join(rest, ["conv", "block"]).select("block", "ends", F.lit(None).cast("int").alias("before"))
    none = F.lit(None).cast("array<bigint>").alias("ends")
    before = pairs.select((F.col("block") + 1).alias("block"), none, F.col("final_initial").alias("before"))
    edges = ends.unionByName(before).groupBy("block").agg(F.max("ends").alias("ends"), F.max("before").alias("before"))
    found = light.groupBy("block").cogroup(edges.groupBy("block")).applyInArrow(
        _paths,
        "conv string, block bigint, entry int, leave int, begins boolean, goes_on boolean, cost bigint, illegal bigint, audit string",
    )
    return stored(_chosen(stored(found, "paths")), "audits")


def reports(convs: DataFrame, turns: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) per conv_id of ``convs``."""
    def of(fault: int) -> Column:
        return F.count(F.when(F.col("fault") == fault, 1))

    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    counts = turns.groupBy("conv").agg(
        F.coalesce(span, F.lit(0)).cast("bigint").alias("gaps"),
        of(BLANK).alias("blank"),
        of(DUPLICATE).alias("duplicate"),
        of(CUT).alias("truncated"),
    )
    listed = F.sort_array(F.collect_list(F.struct("block", "audit")))
    plans = found.groupBy("conv").agg(
        F.sum("illegal").alias("illegal"),
        F.sum(F.when(F.col("begins"), F.col("cost"))).alias("cost"),
        F.array_join(F.transform(listed, lambda p: p["audit"]), "").alias("audit"),
    )
    everyone = convs.select(conversation_key().alias("conv"), "conv_id").distinct()
    rows = everyone.join(counts, "conv", "left").join(plans, "conv", "left")
    return rows.fillna(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).fillna("", ["audit"])


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, conv_id, seq, role, text, edit): the turns after repair; those of a conversation stand together, in order.

    ``rows`` are the turns that :func:`faults` saw, ``found`` the audits of :func:`pieces`. A conversation is streamed
    through one task, as a digest of it must be, and only its audit is held.
    """
    turns = _filled(rows)
    audits = found.select("conv", "block", "audit")
    audits = audits.select("*", *[F.lit(None).cast(turns.schema[c].dataType).alias(c) for c in ("conv_id", "turn", "role", "text", "key")])
    turns = turns.withColumn("block", F.lit(None).cast("bigint")).withColumn("audit", F.lit(None).cast("string"))
    both = turns.unionByName(audits).withColumn("is_turn", F.col("audit").isNull())
    both = both.repartition("conv").sortWithinPartitions("conv", "is_turn", "block", F.col("turn").asc_nulls_first(), "key")
    both = both.select("conv", "conv_id", "role", "text", "audit")
    schema = T.StructType(
        [*(both.schema[c] for c in ("conv", "conv_id"))]
        + [T.StructField("seq", T.LongType()), *(both.schema[c] for c in ("role", "text")), T.StructField("edit", T.StringType())]
    )
    return both.mapInArrow(_edited, schema)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv = conv_id = None
    audit: list[str] = []
    letters = iter(())
    state = seq = 0
    kind = schema = None

    def turn(role: str, text: str, edit: str) -> tuple:
        nonlocal seq
        seq += 1
        return conv, conv_id, seq - 1, role, text, edit

    def inserted() -> tuple:
        nonlocal state
        state = int(_DUE[state])
        return turn(ROLES[state], "", "I")

    def record(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.string(), kind, pa.int64(), pa.string(), pa.string(), pa.string())
        columns = zip(*rows, strict=True) if rows else [[]] * 6
        names = ("conv", "conv_id", "seq", "role", "text", "edit")
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        out = []
        for name, this, role, text, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if name != conv:
                out += [inserted() for _ in letters]  # only inserts follow the last turn
                conv, audit, letters, state, seq = name, [], iter(()), 0, 0
            if piece is not None:
                audit.append(piece)
                continue
            if audit:
                letters, audit = iter("".join(audit)), []
            conv_id = this
            for letter in letters:
                if letter == "I":
                    out.append(inserted())
                    continue
                if letter == "K":
                    state = int(_KEPT[" sua".index(role[0]), state])
                    out.append(turn(role, text, "K"))
                elif letter == "R":
                    state = int(_DUE[state])
                    out.append(turn(ROLES[state], text, "R"))
                break
        yield record(out)
    if kind is not None:
        yield record([inserted() for _ in letters])


def digests(turns: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of :func:`repaired`: ``role:text`` joined by newlines. Reads its rows in their order."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv", "repaired_sha256"]
        conv = running = None
        for batch in batches:
            out = []
            for name, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != conv:
                    if running is not None:
                        out.append((conv, running.hexdigest()))
                    conv, running = name, hashlib.sha256()
                else:
                    running.update(b"\n")
                running.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(2)], names)
        if running is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([running.hexdigest()])], names)

    return turns.select("conv", "role", "text").mapInArrow(digest, "conv string, repaired_sha256 string")


def repair_report(convs: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """One row per conv_id of ``convs``, for its turns in ``rows`` (``convs`` itself if not given).

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Null is a conversation of its
    own; nulls of role and text are one space; turns that are null come first, and turns of one number are ordered
    by a hash of role and text. Only s, u and a are initials that can be kept, so an empty role cannot.
    A conversation without rows has zeros, an empty audit and the hash of nothing. Empty tables give
    an empty result; other columns are not read.
    """
    rows = convs if rows is None else rows
    turns = faults(rows)
    found = pieces(turns)
    after = digests(repaired(rows, found))
    result = reports(convs, turns, found).join(after, "conv", "left")
    return result.drop("conv").fillna(hashlib.sha256().hexdigest(), ["repaired_sha256"])
