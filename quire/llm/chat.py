"""Chat formatting: layouts recognised by a fingerprint of their field paths.

A record is a JSON object.  Its fingerprint is the hash of its sorted nested
field paths (``messages[].role``); a table from fingerprints to declarative
mappings says where turns, roles and texts are found.  Absent optional fields
change a fingerprint, so a mapping registers one fingerprint for each set of
them.  All layouts become canonical turns ``(conv_id, turn, role, text)``.

The template writes a turn as one segment: an opening mark for its role, the
text, a closing mark.  Marks are control strings; where one stands in a text
it gets one backslash more in front of it, and reading back takes one off, so
any text comes back exactly.  A closing mark begins with a blank, so no text
before it can seem to escape it.  The loss mask of a segment is the span of an
assistant's text.  A conversation is its segments in order; they stay rows,
so no conversation has to fit one value or one task's memory, and reading back
streams the turns of a conversation in order.

Edge cases: a null text is empty; long runs of backslashes, with and without a
control string after them, come back like any text; a null role is written as an empty name;
records with an unknown layout or broken JSON give one row with ``layout``
null and no turn (:func:`unmapped` lists them); equal turn numbers are ordered
by role and text, null ones first; repeated rows are turns of their own; a null
conversation id is one conversation; empty tables give empty results; a field
that its mapping does not name makes a layout unknown; other columns beside
the JSON are not read.
"""
from __future__ import annotations

import hashlib
import itertools
import json
import re
from typing import Iterator, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, without


# --- layouts -------------------------------------------------------------

class Mapping(NamedTuple):
    """Where a layout keeps its turns.

    ``turns``: path of the list of turns, or None when the record's own fields
    are turns; ``fields``: ``(role, path)`` in order, where a role of ``"@x"``
    is read from the field ``x`` beside it; ``required`` paths are in every
    record, ``optional`` ones in some; ``number``: field with the turn number."""
    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    turns: str | None
    fields: tuple[tuple[str, str], ...]
    number: str | None = None


#: Names that other layouts use for the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}

LAYOUTS = (
    Mapping("turn rows", ("conv_id",), ("turn", "role", "text"), None, (("@role", "text"),), "turn"),
    Mapping("messages", ("messages[].content", "messages[].role"), ("conv_id",), "messages", (("@role", "content"),)),
    Mapping("from value", ("conversations[].from", "conversations[].value"), ("conv_id",), "conversations", (("@from", "value"),)),
    Mapping("prompt response", ("prompt",), ("conv_id", "system", "response"), None,
            (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt completion", ("prompt", "completion"), ("conv_id", "system"), None,
            (("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Mapping("instruction", ("instruction", "output"), ("conv_id", "system", "input"), None,
            (("system", "system"), ("user", "instruction+input"), ("assistant", "output"))),
    Mapping("question answer", ("question", "answer"), ("conv_id", "system"), None,
            (("system", "system"), ("user", "question"), ("assistant", "answer"))),
)


def paths(value, at: str = "") -> set[str]:
    """Nested field paths of the leaves; a null field is no field."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items()), set())
    if isinstance(value, list):
        return set().union(*(paths(v, f"{at}[]") for v in value), set())
    return set() if value is None else {at}


def fingerprint(found: set[str]) -> str:
    return hashlib.sha1("\n".join(sorted(found)).encode()).hexdigest()


def fingerprints(layouts: tuple[Mapping, ...] = LAYOUTS) -> dict[str, Mapping]:
    """The table from fingerprints to mappings (the first of equal ones counts)."""
    out: dict[str, Mapping] = {}
    for m in layouts:
        for k in range(len(m.optional) + 1):
            for some in itertools.combinations(m.optional, k):
                out.setdefault(fingerprint(set(m.required) | set(some)), m)
    return out


def turns_of(record: dict, m: Mapping) -> list[tuple]:
    """``(turn number or None, role, text)`` of a record."""
    out = []
    for i, part in enumerate(record.get(m.turns) or [] if m.turns else [record]):
        for role, field in m.fields:
            got = [part.get(f) for f in field.split("+")]
            if role[0] == "@":
                role = part.get(role[1:])
                role = ROLES.get(role, role)
            elif all(g is None for g in got):
                continue
            text = "\n".join(g if isinstance(g, str) else json.dumps(g, ensure_ascii=False) for g in got if g is not None)
            out.append((part.get(m.number) if m.number else len(out), role, text))
    return out


def canonical_turns(records: DataFrame, json_col: str = "record", id_col: str = "conv_id",
                    layouts: tuple[Mapping, ...] = LAYOUTS) -> DataFrame:
    """Turns ``(conv_id, turn, role, text, layout)`` of JSON records; a record
    without a known layout is one row with ``layout`` and ``role`` null."""
    prepare(records.sparkSession)
    table = fingerprints(layouts)
    src = records.select(F.col(id_col).cast("long").alias("conv_id"), F.col(json_col).alias("record"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for b in batches:
            rows = []
            for conv, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    record = json.loads(raw) if raw is not None else None
                except ValueError:
                    record = None
                m = table.get(fingerprint(paths(record))) if isinstance(record, dict) else None
                if m is None:
                    rows.append((conv, None, None, raw, None))
                    continue
                rows += [(conv, n, role or "", text, m.name) for n, role, text in turns_of(record, m)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), *[pa.string()] * 3))],
                    names=["conv_id", "turn", "role", "text", "layout"])

    return src.mapInArrow(run, "conv_id long, turn long, role string, text string, layout string")


def unmapped(turns: DataFrame) -> DataFrame:
    """Records that no mapping fits: their id and JSON."""
    return turns.where("layout is null").select("conv_id", F.col("text").alias("record"))


# --- template ------------------------------------------------------------

#: Control strings of the template, and the marks of each role.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE:", "[/ROLE]", "[ASST]")
MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": ("[ASST] ", " </s>")}
_ANY = "|".join(re.escape(c) for c in CONTROLS)
# A run of backslashes is tried once, from its beginning and whole, so long runs cost in proportion to their length.
_ESCAPE = rf"(?<!\\)(\\*+(?:{_ANY}))"
_UNESCAPE = rf"(?<!\\)\\(\\*+(?:{_ANY}))"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1")


def formatted(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per turn: ``conv_id, turn, segment`` (its formatted text),
    ``loss_start, loss_end`` (code points of the segment; equal when nothing of
    it counts) and ``tie``, which orders equal turn numbers."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    opening, closing = F.concat(F.lit("[ROLE:"), F.hex(role), F.lit("] ")), F.lit(" [/ROLE]")
    for name, (a, b) in MARKS.items():
        opening = F.when(role == name, F.lit(a)).otherwise(opening)
        closing = F.when(role == name, F.lit(b)).otherwise(closing)
    body = escaped(text)
    start = F.length(opening)
    return turns.select("conv_id", "turn", F.concat(opening, body, closing).alias("segment"), start.alias("loss_start"),
                        F.when(role == loss_role, start + F.length(body)).otherwise(start).alias("loss_end"),
                        F.concat(role, F.lit("\n"), text).alias("tie"))


def _reader():
    # A control string that no backslash precedes.
    find = re.compile(rf"(?<!\\)(?:{_ANY})").search
    unescape = re.compile(_UNESCAPE)

    def read(segment: str, at: int) -> tuple[str, str, int]:
        """``(role, text, end)`` of the turn that begins at ``at``."""
        for role, (a, b) in MARKS.items():
            if segment.startswith(a, at):
                begin = at + len(a)
                break
        else:
            if not segment.startswith("[ROLE:", at):
                raise ValueError("no turn begins here")
            name = segment[at + 6:segment.index("] ", at)]
            role, b, begin = bytes.fromhex(name).decode(), " [/ROLE]", segment.index("] ", at) + 2
        m = find(segment, begin)
        if m is None or segment[m.start() - 1:m.end()] != b or m.start() - 1 < begin:
            raise ValueError("the turn does not end")
        return role, unescape.sub(r"\1", segment[begin:m.start() - 1]), m.end()
    return read, unescape


def digests(segments: DataFrame) -> DataFrame:
    """Read the formatted text back: one row per conversation with ``n_turns``,
    ``turns_sha256``, ``loss_chars``, ``loss_sha256`` and ``formatted_chars``.

    Segments of a conversation meet in one task, as a digest must see them one
    after the other, but are streamed: only hash states are held."""
    prepare(segments.sparkSession)
    ordered = (segments.select("conv_id", "turn", "tie", "segment", "loss_start", "loss_end")
               .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "tie")
               .select("conv_id", "segment", "loss_start", "loss_end"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        read, unescape = _reader()
        conv, state, rows = None, None, []

        def close():
            if state is not None:
                rows.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def out():
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                               names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            rows.clear()
            return batch

        for b in batches:
            for c, segment, a, z in zip(*(x.to_pylist() for x in b.columns)):
                if state is None or c != conv:
                    close()
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                at = 0
                while at < len(segment):
                    role, text, at = read(segment, at)
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                loss = unescape.sub(r"\1", segment[a:z])
                state[2] += len(loss)
                state[3].update(loss.encode("utf-8", "surrogatepass"))
                state[4] += len(segment)
            if rows:
                yield out()
        close()
        if rows:
            yield out()

    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def assembled(segments: DataFrame) -> DataFrame:
    """``conv_id, text`` and ``loss`` (spans in the text) of whole conversations,
    for those that fit one value."""
    s = F.sort_array(F.collect_list(F.struct("turn", "tie", "segment", "loss_start", "loss_end")))
    g = segments.groupBy("conv_id").agg(s.alias("s"))
    spans = F.expr("""reduce(s, struct(0 as n, cast(array() as array<struct<a:int,z:int>>) as out),
        (acc, x) -> struct(acc.n + length(x.segment) as n,
                           if(x.loss_end > x.loss_start, concat(acc.out, array(struct(acc.n + x.loss_start as a, acc.n + x.loss_end as z))), acc.out) as out),
        acc -> acc.out)""")
    return g.select("conv_id", F.array_join(F.transform("s", lambda x: x.segment), "").alias("text"), spans.alias("loss"))


def rows_as_records(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                    text_col: str = "text") -> DataFrame:
    """A table of turns as JSON records of the ``turn rows`` layout."""
    cols = [F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")]
    return without(turns, ["record"]).select(F.col(id_col).cast("long").alias("conv_id"),
                                             F.to_json(F.struct(F.coalesce(cols[0].cast("string"), F.lit("")).alias("conv_id"), *cols[1:])).alias("record"))
