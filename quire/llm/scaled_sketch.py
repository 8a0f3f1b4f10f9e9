"""Threshold-scaled sketches: every shingle hash below a fixed fraction.

A text's shingles are its runs of ``SIZE`` words (fewer words: the whole
sequence).  Their 64-bit hashes below ``fraction`` of the range form the
sketch.  Membership depends on the hash alone, so the sketch of a union is the
union of the sketches, and containment can be estimated between texts of very
unequal length, which sketches of a fixed number of hashes cannot do.  A
fingerprint also carries the number of shingles and a digest of the whole
sequence, which tells short texts apart whose sketches are empty.

All of it is built-in column functions.  Word hashes are computed once per text
and bound to a lambda variable; shingle hashes combine five of them.

For the next document in ascending order of ids, rows are dealt to parts by
quantiles of the id (a binary search over an array literal), and the smallest
row of each part is also sent to the part before it.  So whole texts are
shuffled once and every part is ordered alone; there is no global window.

Ids may be of any type that can be ordered: parts are cut by a whole number that
never falls as the id rises (of strings the seven bytes after what all ids
begin with), and rows of one part are ordered by the id itself.

Edge cases: a null text is empty, one of any length is sketched whole; an empty text has no shingle, and two of them
are alike (1); null ids come first; repeated ids are ordered by their texts'
hashes and lengths; a single document is its own next one; an empty table gives
an empty result; columns that clash with result columns are replaced.
"""
from __future__ import annotations

import math
import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare

SIZE = 5
FRACTION = 0.25
PARTS_PER_TASK = 3
BLANKS = " \t\n\x0b\x0c\r"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sketch(text: Column, size: int = SIZE, fraction: float = FRACTION) -> Column:
    """Struct of ``n`` (shingles, repeated ones too), ``digest`` and ``hashes``
    (ascending, distinct, below ``fraction`` of the range)."""
    bound = F.lit(int(-(1 << 63) + fraction * (1 << 64)) if fraction < 1 else (1 << 63) - 1)
    low = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(BLANKS))
    words = F.transform(F.split(low, "[ \\t-\\r]+"), lambda w: F.xxhash64(w))
    words = F.when(low == "", F.array().cast("array<bigint>")).otherwise(words)

    def runs(h: Column) -> Column:
        n = F.size(h)
        return (F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)])))
                .when(n > 0, F.array(F.xxhash64(h))).otherwise(h))

    def packed(s: Column) -> Column:
        return F.struct(F.size(s).cast("long").alias("n"), F.xxhash64(s).alias("digest"),
                        F.array_sort(F.array_distinct(F.filter(s, lambda x: x < bound if fraction < 1 else x <= bound))).alias("hashes"))

    return _let(_let(words, runs), packed)


def merged(a: Column, b: Column) -> Column:
    """The sketch hashes of two texts taken together."""
    return F.array_sort(F.array_union(a["hashes"], b["hashes"]))


def _common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a["hashes"], b["hashes"]))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity, 0 to 1."""
    both = _common(a, b)
    either = F.size(a["hashes"]) + F.size(b["hashes"]) - both
    same = (a["n"] == b["n"]) & (a["digest"] == b["digest"])
    return F.when(same, 1.0).when(either == 0, 0.0).otherwise(both / either)


def containment(a: Column, b: Column) -> Column:
    """Estimated part of ``a``'s shingles that ``b`` has (null if the sketch of ``a`` is empty)."""
    n = F.size(a["hashes"])
    return F.when(n > 0, _common(a, b) / n)


def printed(s: Column) -> Column:
    """A fingerprint as a string; its hashes have 16 hexadecimal digits each."""
    return F.concat_ws("-", s["n"].cast("string"), F.hex(s["digest"]),
                       F.array_join(F.transform(s["hashes"], lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def _part(key: Column, bounds: list[int]) -> Column:
    """Number of ``bounds`` (ascending) under ``key``, by binary search."""
    if not bounds:
        return F.lit(0)
    steps = max(1, math.ceil(math.log2(len(bounds) + 1)))
    full = F.lit([*bounds, *[(1 << 63) - 1] * ((1 << steps) - 1 - len(bounds))])
    jumps = F.lit([1 << (steps - 1 - k) for k in range(steps)])
    return F.reduce(jumps, F.lit(0), lambda at, jump: F.when(F.get(full, at + jump - 1) < key, at + jump).otherwise(at))


def _rising(ids: DataFrame) -> Column:
    """A long that does not fall as ``doc_id`` rises (null for null ids)."""
    kind, c = ids.schema["doc_id"].dataType, F.col("doc_id")
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("long")
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        top = float(1 << 62)
        d = c.cast("double")
        whole = F.floor(F.greatest(F.least(d, F.lit(top)), F.lit(-top))).cast("long")
        return F.when(F.isnan(d), F.lit(1 << 62)).when(c.isNotNull(), whole)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, T.StringType):
        ends = ids.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).first()
        raw, begins = c.cast("binary"), len(os.path.commonprefix([(ends.a or "").encode(), (ends.z or "").encode()]))
        digits = F.rpad(F.hex(F.substring(raw, begins + 1, 7)), 14, "0")
        return F.conv(digits, 16, 10).cast("long")
    return F.when(c.isNotNull(), F.lit(0).cast("long"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None,
              columns: dict | None = None) -> DataFrame:
    """``doc_id, text``, the ``columns`` computed from those, and ``next``: a
    struct of the text and columns of the next document."""
    spark = docs.sparkSession
    prepare(spark)
    columns = columns or {}
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key = F.coalesce(_rising(docs.select(F.col(id_col).alias("doc_id"))), F.lit(-(1 << 63)))
    ids = docs.select(F.col(id_col).alias("doc_id")).select(key.alias("k"))
    parts = parts or PARTS_PER_TASK * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = ids.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)] or [0.5], 20 * parts)).first()[0]
    bounds = sorted(set(found or [])) if parts > 1 else []
    # The smallest id of each part (at most one row a part) goes to the part before it, too, the first to the last.
    firsts = sorted((r.p, r.k) for r in ids.groupBy(_part(F.col("k"), bounds).alias("p")).agg(F.min("k").alias("k")).collect())
    heads = [(k, firsts[i - 1][0], int(i == 0)) for i, (_, k) in enumerate(firsts)]
    guards = F.broadcast(spark.createDataFrame(heads, "k long, to int, wrap int"))
    rows = (src.withColumn("k", key).join(guards, "k", "left")
            .withColumn("copies", F.array_compact(F.array(F.struct(_part(F.col("k"), bounds).alias("part"), F.lit(0).alias("wrap"), F.lit(False).alias("guard")),
                                                          F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("part"), F.col("wrap"), F.lit(True).alias("guard"))))))
            .select("doc_id", "k", "text", F.inline("copies")))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(n, "part").withColumns(columns)
    order = Window.partitionBy("part").orderBy("wrap", "k", "doc_id", F.xxhash64("text"), F.length("text"))
    own = F.struct("text", *columns)
    return rows.withColumn("next", F.lead(own).over(order)).where("not guard").select("doc_id", "text", *columns, "next")


def fingerprints_of_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE,
                          fraction: float = FRACTION, parts: int | None = None) -> DataFrame:
    """For every document its sketch, the sketch of its text with the last
    quarter replaced by the beginning of the next document, and likenesses."""
    rows = with_next(docs, id_col, text_col, parts, {"own": sketch(F.col("text"), size, fraction)})
    n = F.length("text").cast("long")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n.cast("int") - cut), F.substring(F.col("next.text"), F.lit(1), cut))
    rows = rows.select("doc_id", n.alias("n_chars"), edited.alias("edited"), "own", F.col("next.own").alias("next_own"))
    return rows.withColumn("edited_own", sketch(F.col("edited"), size, fraction))
