"""Token estimates and line classes.

The estimate is ``ceil(chars / 4)``; an exact tokenizer can be supplied as any
``Column -> Column`` function (for example a pandas UDF).
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, col, lines


def len_chars(c, utf16: bool = False) -> Column:
    """Length in characters; ``utf16=True`` counts UTF-16 code units as
    JavaScript does (an astral character counts 2)."""
    c = col(c)
    if utf16:
        return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")
    return F.length(c).cast("long")


def tokens_from_len(n) -> Column:
    return F.coalesce(F.ceil(col(n) / 4), F.lit(0)).cast("long")


def estimate_tokens(c, utf16: bool = False) -> Column:
    return tokens_from_len(len_chars(c, utf16))


def count_tokens(c, tokenizer=None, utf16: bool = False) -> Column:
    """Struct ``(tokens, accurate)``; empty text is 0 tokens and not accurate."""
    c = col(c)
    if tokenizer is None:
        return F.struct(estimate_tokens(c, utf16).alias("tokens"), F.lit(False).alias("accurate"))
    empty = c.isNull() | (c == "")
    return F.struct(F.when(empty, F.lit(0)).otherwise(tokenizer(c)).cast("long").alias("tokens"),
                    (~empty).alias("accurate"))


def tokens_from_bytes(size) -> Column:
    return F.ceil(col(size) / 4).cast("long")


def joined_tokens(sum_len, n_files) -> Column:
    """Tokens of all contents joined with newlines, without building the join."""
    return F.ceil((col(sum_len) + F.greatest(col(n_files) - 1, F.lit(0))) / 4).cast("long")


def line_breakdown(c) -> Column:
    """Struct of code / comment / empty / total line counts."""
    ls = lines(c)
    blank = rf"^{WS}*$"
    comment = rf"^{WS}*(//|#)"
    return F.struct(
        F.size(F.filter(ls, lambda l: ~l.rlike(blank) & ~l.rlike(comment))).cast("long").alias("code_lines"),
        F.size(F.filter(ls, lambda l: l.rlike(comment))).cast("long").alias("comment_lines"),
        F.size(F.filter(ls, lambda l: l.rlike(blank))).cast("long").alias("empty_lines"),
        F.size(ls).cast("long").alias("total_lines"),
    )
