"""Token counts attributed to fields and sections by character offsets.

A document is encoded once, as a whole, so counts add up to what a model sees;
encoding sections on their own would count other tokens at their borders.
Each token covers the characters that its bytes touch.  Tokens and sections
are both ordered by their first character, so they are joined as intervals in
one merge per document: a binary search of token starts and ends in the
section borders finds every pair that overlaps, without forming others.

A token that crosses a border is allocated by ``rule``:

* ``first``: to the section of its first character;
* ``largest``: to the section with most of its characters, the earliest of equal ones;
* ``share``: to every section by its part of the token's characters.

Characters outside every section belong to a gap section (``section`` null), so
a document's allocations always add up to its tokens.  Rows stay in their
partition: nothing is shuffled, and a task holds one Arrow batch.

A run of blanks of any length is encoded: the splitting pattern's engine ends
at some hundred thousand of them, so runs over ``RUN`` characters are cut out
first, where the pattern would cut them: before the last blank if something
other than a blank follows, else at the end.

Edge cases: a null text is empty; texts of any length are encoded whole; an empty text with sections gives each of
them 0 tokens, without sections no row; sections must be ascending and
disjoint, are clipped to the text, and may be empty (0 tokens); a null list of
sections means the whole text is a gap; a null field is empty; repeated rows
are counted each; an empty table gives an empty result; only the id, text and
section columns are read.
"""
from __future__ import annotations

import base64
import re
from typing import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare

RULES = ("first", "largest", "share")
RUN = 10_000
#: White space as the splitting patterns of public vocabularies read it.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_RUN = re.compile(f"[{_SPACE}]{{{RUN + 1},}}")


class Encoder:
    """A byte-level vocabulary in the ranks format, with the length of each id."""

    def __init__(self, path: str, pattern: str):
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            self.length[i] = len(token)

    def ids(self, text: str) -> np.ndarray:
        parts, at = [], 0
        for m in _LONG_RUN.finditer(text):
            end = m.end() - (m.end() < len(text))
            parts += [self.encoding.encode_ordinary(text[at:m.start()]), self.encoding._encode_single_piece(text[m.start():end])]
            at = end
        if not parts:
            return np.array(self.encoding.encode_ordinary(text), dtype=np.int64)
        parts.append(self.encoding.encode_ordinary(text[at:]))
        return np.concatenate([np.array(x, dtype=np.int64) for x in parts])


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder_for(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def token_spans(raw: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of each token, of which consecutive ones take
    ``lengths`` bytes of the UTF-8 text ``raw``."""
    end = np.cumsum(lengths)
    start = end - lengths
    if raw.isascii():
        return start, end
    lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    char = np.cumsum(lead) - 1                 # character that each byte belongs to
    return char[start], char[end - 1] + 1


def allocate(start: np.ndarray, end: np.ndarray, left: np.ndarray, right: np.ndarray, size: int, rule: str) -> tuple[np.ndarray, float, int]:
    """Tokens of each section ``[left, right)``, of the gaps, and how many
    tokens cross a border."""
    # Cells between borders: cell 2 i + 1 is section i, even ones are gaps.
    border = np.empty(2 * len(left), dtype=np.int64)
    border[0::2], border[1::2] = left, right
    border = np.minimum(border, size)
    a = np.searchsorted(border, start, "right")
    b = np.searchsorted(border, end - 1, "right")
    got = np.zeros(len(border) + 1)
    crossing = np.flatnonzero(a != b)
    if rule == "first":
        np.add.at(got, a, 1.0)
    else:
        plain = a == b
        got += np.bincount(a[plain], minlength=len(got))
        edges = np.concatenate([[0], border, [size]])
        for t in crossing.tolist():
            cells = np.arange(a[t], b[t] + 1)
            part = np.minimum(edges[cells + 1], end[t]) - np.maximum(edges[cells], start[t])
            if rule == "largest":
                got[cells[int(np.argmax(part))]] += 1
            else:
                got[cells] += part / (end[t] - start[t])
    return got[1::2], float(got[0::2].sum()), len(crossing)


def line_borders(text: str) -> np.ndarray:
    """Ends of the lines of a text, each with its line end (no line for an empty text)."""
    sizes = np.array([len(x) + 1 for x in text.split("\n")], dtype=np.int64)
    sizes[-1] -= 1
    return np.cumsum(sizes[:-1] if sizes[-1] == 0 else sizes)


def attribute(docs: DataFrame, vocabulary: str, pattern: str, sections: str | None = None, id_col: str = "doc_id",
              text_col: str = "text", rule: str = "largest") -> DataFrame:
    """One row per section, and one for the gaps where they have tokens:
    ``doc_id, section, char_start, char_end, tokens`` (double), ``crossing``
    (tokens of the document that cross a border) and ``doc_tokens``.

    ``sections`` names a column of structs ``name, start, end`` in characters;
    without it every line, with its line end, is a section named by its number."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if sections is not None:
        s = F.col(sections)
        src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                          F.transform(s, lambda x: x["name"].cast("string")).alias("names"),
                          F.transform(s, lambda x: x["start"].cast("long")).alias("starts"),
                          F.transform(s, lambda x: x["end"].cast("long")).alias("ends"))
    schema = T.StructType([T.StructField("doc_id", src.schema["doc_id"].dataType), T.StructField("section", T.StringType()),
                           *[T.StructField(c, T.LongType()) for c in ("char_start", "char_end")],
                           T.StructField("tokens", T.DoubleType()), T.StructField("crossing", T.LongType()),
                           T.StructField("doc_tokens", T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        enc = encoder_for(vocabulary, pattern)

        def out(keys, lo, counts, names, left, right, got, crossing, tokens):
            each = lambda x: np.repeat(np.array(x, dtype=np.int64), counts)
            place = pa.array(np.repeat(np.arange(lo, lo + len(counts)), counts))
            left, right = np.concatenate(left), np.concatenate(right)
            gap = left < 0
            return pa.RecordBatch.from_arrays(
                [keys.take(place), pa.array(names, pa.string()), pa.array(left, mask=gap), pa.array(right, mask=gap),
                 pa.array(np.concatenate(got)), pa.array(each(crossing)), pa.array(each(tokens))], schema=arrow)

        for batch in batches:
            keys, lo, held = batch.column(0), 0, ([], [], [], [], [], [], [])
            for i in range(batch.num_rows):
                counts, names, left, right, got, crossing, tokens = held
                text = batch.column(1)[i].as_py()
                if sections is None:
                    b = line_borders(text)
                    a, own = np.append(np.zeros(1, np.int64), b)[:len(b)], range(len(b))
                else:
                    own, a, b = (batch.column(j)[i].as_py() or [] for j in (2, 3, 4))
                    a, b = np.array(a, np.int64), np.array(b, np.int64)
                    if len(a) and (np.any(b < a) or np.any(a[1:] < b[:-1]) or a[0] < 0):
                        raise ValueError(f"sections of {keys[i]} are not ascending and disjoint")
                ids = enc.ids(text)
                start, end = token_spans(text.encode(), enc.length[ids])
                x, gap, n = allocate(start, end, a, b, len(text), rule)
                names += map(str, own) if sections is None else own
                if gap:
                    x, a, b = np.append(x, gap), np.append(a, -1), np.append(b, -1)
                    names.append(None)
                for k, v in zip((0, 2, 3, 4, 5, 6), (len(x), np.minimum(a, len(text)), np.minimum(b, len(text)), x, n, len(ids))):
                    held[k].append(v)
                if len(names) >= 50_000:
                    yield out(keys, lo, *held)
                    lo, held = i + 1, ([], [], [], [], [], [], [])
            if held[1]:
                yield out(keys, lo, *held)

    return src.mapInArrow(run, schema)


def field_sections(fields: list[str], separator: str = "\n\n") -> tuple[Column, Column]:
    """A document made of the given columns, and its sections, one per field.
    Separators are gaps."""
    values = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    at, sections = F.lit(0).cast("long"), []
    for f, v in zip(fields, values):
        end = at + F.length(v)
        sections.append(F.struct(F.lit(f).alias("name"), at.alias("start"), end.alias("end")))
        at = end + len(separator)
    return F.concat_ws(separator, *values), F.array(*sections)
