"""Chat formatting with a grammar round trip: what is written is parsed again and must give the turns it came from.

The grammar, in which a backslash before a mark makes it text::

    conversation = turn*
    turn         = "[INST] " text " [/INST]" | "<<SYS>> " text " <</SYS>>" | "<s> " text " </s>"
                 | "[ROLE] " name " [/ROLE] " text " [END]"

User, system and assistant turns have forms of their own, any other role is named. Text and name may hold anything
but a bare mark; n + 1 backslashes before a mark stand for n backslashes and the mark as text, and other backslashes
stand for themselves. So every conversation has one reading, and the parser never looks back. A turn is first
rendered as it is and parsed; where that does not give the turn back, the part that conflicts is escaped and the
turn is parsed again, until it is identical. Turns stand for themselves in the grammar, so a conversation
whose turns come back one by one comes back whole; it is written as one row per turn and never held whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of the template. None holds a blank or ends as another begins.
FORMS = {"user": ("[INST]", "[/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("<s>", "</s>")}
NAME, NAMED, END = "[ROLE]", "[/ROLE]", "[END]"
MARKS = (*(mark for pair in FORMS.values() for mark in pair), NAME, NAMED, END)
#: Turns of this role are what a model learns to say.
LEARNED = "assistant"

_MARK = re.compile("|".join(re.escape(m) for m in MARKS))
_BARE = re.compile(rf"(\\*)({_MARK.pattern})")
_OPENED = {pair[0]: role for role, pair in FORMS.items()}


class NotInGrammar(ValueError):
    """A text that the grammar does not derive."""


def escaped(text: str) -> str:
    """``text`` with a backslash before every mark."""
    return _MARK.sub(lambda m: "\\" + m.group(), text)


def unescaped(text: str) -> str:
    """The reverse of :func:`escaped`: one backslash less before every mark."""
    return _BARE.sub(lambda m: m.group(1)[1:] + m.group(2), text)


def render(role: str, text: str, escape: frozenset[str] = frozenset()) -> str:
    """One turn; the parts named in ``escape`` (``role``, ``text``) are escaped."""
    inner = escaped(text) if "text" in escape else text
    if role in FORMS:
        first, last = FORMS[role]
        return f"{first} {inner} {last}"
    name = escaped(role) if "role" in escape else role
    return f"{NAME} {name} {NAMED} {inner} {END}"


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """The turns of a rendered text: role, text, and where the text stands in it, as written (first, last).

    Raises :class:`NotInGrammar` where the text is not derived by the grammar.
    """
    marks = [(m.start(2), m.group(2)) for m in _BARE.finditer(text) if not m.group(1)]
    turns, at, i = [], 0, 0

    def part(opened: str, closed: str) -> tuple[int, int]:
        """Between an opening mark at ``at`` and the next mark, which must be the closing one."""
        nonlocal at, i
        if i + 1 >= len(marks) or marks[i] != (at, opened) or marks[i + 1][1] != closed:
            raise NotInGrammar(at)
        first, last = at + len(opened) + 1, marks[i + 1][0] - 1
        if first > last or text[first - 1] != " " or text[last] != " ":
            raise NotInGrammar(at)
        at, i = marks[i + 1][0], i + 1
        return first, last

    while at < len(text):
        opened = marks[i][1] if i < len(marks) else ""
        if opened in _OPENED:
            role = _OPENED[opened]
            first, last = part(*FORMS[role])
        else:
            role = unescaped(text[slice(*part(NAME, NAMED))])
            first, last = part(NAMED, END)
            if role in FORMS:
                raise NotInGrammar(at)
        at, i = at + len(marks[i][1]), i + 1
        turns.append((role, unescaped(text[first:last]), first, last))
    return turns


def round_trip(role: str, text: str) -> tuple[str, int, int]:
    """A turn rendered so that the parser gives it back, and where its text stands. Escapes only what conflicts."""
    escape: frozenset[str] = frozenset()
    for conflict in ("", "text", "role"):
        escape |= {conflict}
        written = render(role, text, escape)
        try:
            turns = parse(written)
        except NotInGrammar:
            continue
        if [t[:2] for t in turns] == [(role, text)]:
            return written, turns[0][2], turns[0][3]
    raise AssertionError("a turn that is escaped comes back")  # the tests search for one


def formatted(convs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per turn: conv_id, turn, ``keep``, written, loss_start, loss_end; code points within ``written``.

    The turns of a conversation, in the order of turn (nulls first, then role and text), make up its text. The
    loss mask covers the text of assistant turns, as written; elsewhere its bounds are null. A null text or
    role is an empty one. Other columns are not read, rows that repeat are turns of their own.
    """
    rows = convs.select(
        "conv_id", "turn", *keep, F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = rows.select("conv_id", "turn", *keep, _tie().alias("tie"), "role", "text")
    n = len(rows.columns) - 2

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = (batch.column(i).to_pylist() for i in (n, n + 1))
            done = [(*round_trip(r, t), r == LEARNED) for r, t in zip(roles, texts, strict=True)]
            columns = [batch.column(i) for i in range(n)]
            columns.append(pa.array([d[0] for d in done], pa.string()))
            columns += [pa.array([d[i] if d[3] else None for d in done], pa.int64()) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:n], "written", "loss_start", "loss_end"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n])
    return rows.mapInArrow(write, f"{fields}, written string, loss_start bigint, loss_end bigint")


def _tie() -> Column:
    """Order of turns with one number, as text: role and text by their hash."""
    return F.md5(F.concat_ws("\x00", "role", "text").cast("binary"))


def read_back(written: DataFrame) -> DataFrame:
    """One row per conversation, from the rows of :func:`formatted` alone.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline of each turn), loss_chars and loss_sha256 (code points
    and hash of all that the loss mask covers, unescaped), formatted_chars. Turns come from the parser,
    learned text from the mask. A conversation is streamed through one task, as its digest must be; only
    a batch of turns is held. No rows give no conversation.
    """
    conv = F.struct(F.col("conv_id").isNull(), F.col("conv_id"))
    rows = written.withColumn("conv", F.to_json(conv)).repartition("conv")
    rows = rows.sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "tie")
    rows = rows.select("conv", "conv_id", "written", "loss_start", "loss_end")
    fields = ("n_turns bigint", "turns_sha256 string", "loss_chars bigint", "loss_sha256 string", "formatted_chars bigint")
    kind = rows.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(_read, ", ".join((f"conv_id {kind}", *fields)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    conv = conv_id = kind = None
    n_turns = loss_chars = chars = 0
    turns, loss = hashlib.sha256(), hashlib.sha256()

    def record(rows: list[tuple]) -> pa.RecordBatch:
        types = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        out = []
        for name, this, text, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if name != conv:
                if conv is not None:
                    out.append((conv_id, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                conv, conv_id, n_turns, loss_chars, chars = name, this, 0, 0, 0
                turns, loss = hashlib.sha256(), hashlib.sha256()
            for role, said, _, _ in parse(text):
                turns.update(f"{role}\n{said}\n".encode())
                n_turns += 1
            if first is not None:
                learned = unescaped(text[first:last])
                loss.update(learned.encode())
                loss_chars += len(learned)
            chars += len(text)
        yield record(out)
    if conv is not None:
        yield record([(conv_id, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)])
