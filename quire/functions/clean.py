"""Content cleaning: comments, empty lines, minify, truncation.

All of it is built from JVM-side expressions, so a cleaning pass stays inside
whole-stage code generation.  Regexes are linear-time rewrites that Java regex
and RE2 read identically.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .text import LINE_END, WS, col, lines
from .tokens import len_chars, tokens_from_len

C_LINE_COMMENT = rf"//[^{LINE_END}]*"
C_BLOCK_COMMENT = r"/\*[\s\S]*?\*/"
# Cut each line from its first '#', unless that '#' starts '#!'.
HASH_COMMENT = r"(?m)^([^#\n\r]*)#(?:[^!\n\r][^\n\r]*)?$"
DOCSTRING_DQ = r'"""[\s\S]*?"""'
DOCSTRING_SQ = r"'''[\s\S]*?'''"


def remove_comments(c, ext) -> Column:
    c, ext = col(c), col(ext)
    c_like = F.regexp_replace(F.regexp_replace(c, C_LINE_COMMENT, ""), C_BLOCK_COMMENT, "")
    hash_like = F.regexp_replace(
        F.regexp_replace(F.regexp_replace(c, HASH_COMMENT, "$1"), DOCSTRING_DQ, '""""""'),
        DOCSTRING_SQ, "''''''")
    return (F.when(ext.isin(K.C_LIKE_EXTENSIONS), c_like)
            .when(ext.isin(K.HASH_LIKE_EXTENSIONS), hash_like)
            .otherwise(c))


def remove_empty_lines(c) -> Column:
    return F.array_join(F.filter(lines(c), lambda l: ~l.rlike(rf"^{WS}*$")), "\n")


def minify(c) -> Column:
    """Per line: keep the indentation, collapse inner whitespace, trim."""
    def one(l):
        indent = F.regexp_extract(l, rf"^({WS}*)", 1)
        rest = F.substring(l, F.length(indent) + 1, F.length(l))
        return F.concat(indent, F.regexp_replace(F.regexp_replace(rest, rf"{WS}+", " "), r" \z", ""))
    return F.array_join(F.transform(lines(c), one), "\n")


def truncation_keep(c, max_tokens, utf16: bool = False) -> Column:
    """Struct ``(truncate, keep_lines, kept_chars)`` for truncating ``c`` to
    ``max_tokens``: whole lines are kept while their running length stays
    within ``floor(max * len / tokens * 0.95)``."""
    c = col(c)
    mx = col(max_tokens) if not isinstance(max_tokens, int) else F.lit(max_tokens)
    n = len_chars(c, utf16)
    tok = tokens_from_len(n)
    target = F.floor(mx.cast("double") * (n / tok) * F.lit(0.95))
    lens = F.transform(lines(c), lambda l: len_chars(l, utf16) + 1)
    acc = F.aggregate(
        lens,
        F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("int").alias("k"),
                 F.lit(0).cast("long").alias("kc")),
        lambda a, x: F.struct(
            (a["s"] + x).alias("s"),
            (a["k"] + F.when(a["s"] + x - 1 <= target, 1).otherwise(0)).alias("k"),
            (a["kc"] + F.when(a["s"] + x - 1 <= target, x).otherwise(0)).alias("kc")))
    return F.struct((tok > mx).alias("truncate"), acc["k"].alias("keep_lines"),
                    acc["kc"].alias("kept_chars"))


def truncate_lines(c, keep) -> Column:
    """First ``keep`` lines followed by the truncation marker."""
    c, keep = col(c), col(keep)
    head = F.array_join(F.slice(lines(c), 1, keep), "\n")
    return F.concat(F.when(keep > 0, F.concat(head, F.lit("\n"))).otherwise(F.lit("")),
                    F.lit(K.TRUNCATION_MARKER))


def truncate_to_tokens(c, max_tokens, utf16: bool = False) -> Column:
    c = col(c)
    t = truncation_keep(c, max_tokens, utf16)
    return F.when(t["truncate"], truncate_lines(c, t["keep_lines"])).otherwise(c)
