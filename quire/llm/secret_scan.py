"""Secrets in texts: fixed patterns, and windows of high entropy.

Base spans are matches of the patterns of ``BASE_KINDS``: for each kind the
leftmost matches that don't overlap, those that are too short dropped.  A
span is the whole match, in code points, its end exclusive.

The method adds spans of its own.  A candidate is a whole run of at least
``WINDOW`` letters, digits and ``+/_-``.  A window of ``WINDOW`` characters
slides over it, once for each character class: ``base64`` over the run itself,
``hex`` over its runs of hexadecimal digits (a run that is hexadecimal as a
whole is not read as base64).  The window keeps a count for each character of
the class and the sum of ``c * log2(c)`` over these counts; a step changes the
counts of the entering and the leaving character and the sum by their
differences (whole numbers, a millionth of a bit each, so nothing drifts).
The entropy of a window is ``log2(WINDOW)`` less that sum over ``WINDOW``;
windows at or over the class's threshold are united to spans.

Candidates on the allow-list give no span of the method: listed values, and
those that match a listed pattern (no digit or nothing but digits, UUIDs,
sample values).  Base spans are never suppressed.

All of it is built-in column functions on one row: nothing is shuffled.  The
text is searched by two patterns (a third of the kinds' work is done on the
rare candidates alone); candidates go in slices of ``SLICE`` windows, so a
long one costs in proportion to its length.

Edge cases: a null or empty text has no spans (digest of the empty string);
texts of any length are searched whole; repeated rows and ids, null ids and
ties (spans of several kinds with one start go in the order of the kinds) need
no care; an empty table gives an empty result; other columns than the id and
the text are ignored, also under clashing names.
"""
from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns and least lengths of the base kinds, in their order.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE_KINDS = ["assign", "access", "hex"]
_ASSIGN_LEAST = 6                                # of group 2
#: A match with fewer characters than the least length leaves no room for another in the same run, so these find the same.
_ACCESS = "AKIA[A-Z0-9]{16,}"
_HEX = "[0-9a-f]{24,}"

WINDOW = 20
SLICE = 1024             # windows of a candidate judged by one fold
_RUN = "[A-Za-z0-9+/_-]"
_CANDIDATE = f"(?<!{_RUN}){_RUN}{{{WINDOW},}}+"
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Alphabet and least entropy (bits) of a window by class.
CLASSES = {"entropy_base64": (_DIGITS + _LOWER + _UPPER + "+/_-", 3.8), "entropy_hex": (_DIGITS + "abcdefABCDEF", 3.0)}
KINDS = [*BASE_KINDS, *CLASSES]
#: Patterns that no secret has: prose, slugs and paths; numbers and dates; UUIDs; sample values.
ALLOW_PATTERNS = ("^[A-Za-z+/_-]+$", "^[0-9+/_-]+$", "^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
                  "(?i)example|sample|placeholder|0123456789|1234567890|abcdefghij|xxxxxx")
_UNIT = 1 << 20
_MATCHES = "array<struct<at: int, hit: string>>"
_SPANS = "array<struct<start: int, end: int>>"
_BLOCK = 256


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _count_to(n: Column) -> Column:
    """``[0, ..., n - 1]``."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _running(steps: Column) -> Column:
    """Sums of the elements before each one.  Sums run within blocks and over
    the blocks' totals, as a fold copies what it has so far."""
    zero = F.array(F.lit(0))

    def sums(a: Column) -> Column:
        return F.aggregate(a, zero, lambda out, x: F.concat(out, F.array(F.element_at(out, -1) + x)))

    def joined(blocks: Column) -> Column:
        base = sums(F.transform(blocks, lambda b: F.element_at(b, -1)))
        return _let(base, lambda before: F.flatten(F.transform(blocks, lambda b, i: F.transform(
            F.slice(b, F.lit(1), F.size(b) - 1), lambda x: x + F.get(before, i)))))

    numbers = _count_to(F.ceil(F.size(steps) / _BLOCK).cast("int"))
    return _let(F.transform(numbers, lambda b: sums(F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK)))), joined)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost matches that don't overlap, with their places (from 0) in code
    points: what stands between them is what a split at the pattern leaves."""
    def placed(hits: Column) -> Column:
        def at(between: Column) -> Column:
            ends = _running(F.transform(hits, lambda h, k: F.length(h) + F.length(F.get(between, k))))
            return _let(ends, lambda before: F.transform(hits, lambda h, k: F.struct(
                (F.get(before, k) + F.length(F.get(between, k))).alias("at"), h.alias("hit"))))
        return F.when(F.size(hits) == 0, F.array().cast(_MATCHES)).otherwise(_let(F.split(text, pattern, -1), at))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _entropy_spans(run: Column, alphabet: str, least: float, window: int) -> Column:
    """Spans, from the run's start, that high-entropy windows of a run make up."""
    most = int(window * (math.log2(window) - least) * _UNIT)
    weight = F.lit([round(c * math.log2(c) * _UNIT) if c else 0 for c in range(window + 2)])
    empty = F.array().cast(_SPANS)

    def judged(codes: Column) -> Column:
        start = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0).cast("long").alias("sum"),
                         F.lit(-1).alias("first"), F.lit(-1).alias("end"), empty.alias("done"))

        def step(a: Column, i: Column) -> Column:
            enters, leaves = F.get(codes, i), F.when(i >= window, F.get(codes, i - window)).otherwise(-1)
            gains, loses = F.get(a["counts"], enters), F.get(a["counts"], leaves)
            change = F.get(weight, gains + 1) - F.get(weight, gains)
            change = F.when(enters == leaves, F.lit(0)).when(leaves >= 0, change + F.get(weight, loses - 1) - F.get(weight, loses)).otherwise(change)
            counts = F.transform(a["counts"], lambda c, k: c + (k == enters).cast("int") - (k == leaves).cast("int"))

            def after(total: Column) -> Column:
                at = i - (window - 1)
                hit = (at >= 0) & (total <= most)
                new = hit & (at > a["end"])            # it neither overlaps nor touches the open span
                closed = F.when(new & (a["first"] >= 0), F.concat(a["done"], F.array(F.struct(a["first"].alias("start"), a["end"].alias("end")))))
                return F.struct(counts.alias("counts"), total.alias("sum"), F.when(new, at).otherwise(a["first"]).alias("first"),
                                F.when(hit, i + 1).otherwise(a["end"]).alias("end"), closed.otherwise(a["done"]).alias("done"))

            return _let(a["sum"] + change, after)

        def finish(a: Column) -> Column:
            return F.when(a["first"] >= 0, F.concat(a["done"], F.array(F.struct(a["first"].alias("start"), a["end"].alias("end"))))).otherwise(a["done"])

        return F.aggregate(_count_to(F.size(codes)), start, step, finish)

    def one(part: Column, number: Column) -> Column:
        codes = F.transform(F.split(part, ""), lambda c: (F.call_function("instr", F.lit(alphabet), c) - 1).cast("int"))
        return F.transform(_let(codes, judged), lambda s: F.struct((s["start"] + number * SLICE).alias("start"), (s["end"] + number * SLICE).alias("end")))

    # A slice has the characters at which its windows start and those that the last of them reaches.
    pattern = f"(.{{1,{SLICE}}})(?=(.{{0,{window - 1}}}))"
    parts = F.zip_with(F.regexp_extract_all(run, F.lit(pattern), F.lit(1)), F.regexp_extract_all(run, F.lit(pattern), F.lit(2)),
                       lambda own, ahead: F.concat(own, ahead))

    def united(spans: Column) -> Column:
        firsts = F.filter(spans, lambda s, k: (k == 0) | (F.get(spans, k - 1)["end"] < s["start"]))
        lasts = F.filter(spans, lambda s, k: (k == F.size(spans) - 1) | (F.get(spans, k + 1)["start"] > s["end"]))
        return F.zip_with(firsts, lasts, lambda x, y: F.struct(x["start"].alias("start"), y["end"].alias("end")))

    return _let(F.flatten(F.transform(parts, one)), united)


def _span(kind: str, start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(KINDS.index(kind)).alias("order"), end.cast("int").alias("end"))


def _kind(kind: str, found: Column) -> Column:
    return F.transform(found, lambda m: _span(kind, m["at"], m["at"] + F.length(m["hit"])))


def spans(text: Column, allow: Sequence[str] = (), allow_patterns: Sequence[str] = ALLOW_PATTERNS, window: int = WINDOW) -> Column:
    """Array of structs ``start, order, end`` (``order``: number of the kind), ascending."""
    assign = F.filter(matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["hit"], ASSIGN, 2)) >= _ASSIGN_LEAST)

    def of_candidate(c: Column) -> Column:
        def moved(found: Column) -> Column:
            return F.transform(found, lambda m: F.struct((m["at"] + c["at"]).alias("at"), m["hit"].alias("hit")))

        def judged(kind: str, run: Column, at: Column) -> Column:
            return F.transform(_entropy_spans(run, *CLASSES[kind], window), lambda s: _span(kind, s["start"] + at, s["end"] + at))

        allowed = c["hit"].isin(list(allow)) if allow else F.lit(False)
        for p in allow_patterns:
            allowed = allowed | c["hit"].rlike(p)
        none = F.array().cast("array<struct<start: int, order: int, end: int>>")
        runs = matches(c["hit"], f"[0-9A-Fa-f]{{{window},}}")
        hexes = F.flatten(F.transform(runs, lambda m: judged("entropy_hex", m["hit"], m["at"] + c["at"])))
        base64 = F.when(c["hit"].rlike("^[0-9A-Fa-f]+$"), none).otherwise(judged("entropy_base64", c["hit"], c["at"]))
        return F.concat(_kind("access", moved(matches(c["hit"], _ACCESS))), _kind("hex", moved(matches(c["hit"], _HEX))),
                        F.when(allowed, none).otherwise(F.concat(base64, hexes)))

    found = F.flatten(F.transform(matches(text, _CANDIDATE), of_candidate))
    return F.array_sort(F.concat(_kind("assign", assign), found))


def printed(found: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.lit(KINDS)
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["order"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: Sequence[str] = (),
         allow_patterns: Sequence[str] = ALLOW_PATTERNS) -> DataFrame:
    """``doc_id`` and ``found``: the spans of every document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), spans(text, allow, allow_patterns).alias("found"))


def summary(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, digest of the base spans and all spans as a string."""
    found = F.col("found")
    base = F.filter(found, lambda s: s["order"] < len(BASE_KINDS))
    counts = [F.size(F.filter(found, lambda s: s["order"] == k)).cast("long").alias(f"n_{name}") for k, name in enumerate(BASE_KINDS)]
    return scanned.select("doc_id", *counts, F.sha2(printed(base), 256).alias("base_sha256"), printed(found).alias("spans"))
