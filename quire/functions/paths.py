"""Path keys, priority, language and type (pure column expressions)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .text import col


def basename(path="path") -> Column:
    return F.substring_index(col(path), "/", -1)


def ext_name(name) -> Column:
    """Extension as a path-module ``extname`` sees it, lower-cased, no dot:
    text after the last dot of the last segment, empty if that dot leads."""
    return F.lower(F.regexp_extract(col(name), r"^.+\.([^.]*)$", 1))


def ext_last(path="path") -> Column:
    """Text after the last dot of the whole path (the path itself if none)."""
    return F.lower(F.element_at(F.split(col(path), r"\.", -1), -1))


def top_dir(path="path") -> Column:
    p = col(path)
    return F.when(F.instr(p, "/") > 0, F.substring_index(p, "/", 1)).otherwise(F.lit("_root"))


def segments(path="path") -> Column:
    return F.split(col(path), "/", -1)


def _map_literal(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def language_of(path="path") -> Column:
    e = ext_last(path)
    return F.coalesce(F.try_element_at(_map_literal(K.LANGUAGE_MAP), e),
                      F.nullif(e, F.lit("")), F.lit("text"))


def type_of(path="path") -> Column:
    return F.coalesce(F.try_element_at(_map_literal(K.TYPE_MAP), ext_last(path)),
                      F.lit(K.TYPE_DEFAULT))


def _rx(pattern: str, ci: bool) -> str:
    return ("(?i)" if ci else "") + pattern


def file_priority(path="path") -> Column:
    """First matching importance pattern (on base name or path) gives its
    index; otherwise substring fallbacks 100/101/200/201, else 150."""
    p, b = col(path), basename(path)
    expr = None
    for i, (pat, ci) in enumerate(K.PRIORITY_PATTERNS):
        cond = b.rlike(_rx(pat, ci)) | p.rlike(_rx(pat, ci))
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    for subs, value in K.PRIORITY_FALLBACK:
        cond = None
        for s in subs:
            c = p.contains(s)
            cond = c if cond is None else (cond | c)
        expr = expr.when(cond, F.lit(value))
    return expr.otherwise(F.lit(K.PRIORITY_DEFAULT)).cast("int")


def custom_sort_key(patterns, path="path", priority="priority") -> Column:
    """User priority list: the first listed pattern contained in the path gives
    ``index - 1000`` (for a repeated pattern, its last index); otherwise the
    file keeps its own priority.  Only the order uses this key."""
    if not patterns:
        return col(priority)
    last_index = {}
    for i, pat in enumerate(patterns):
        last_index[pat] = i
    expr = None
    for pat in dict.fromkeys(patterns):
        cond = col(path).contains(pat)
        v = F.lit(last_index[pat] - 1000)
        expr = F.when(cond, v) if expr is None else expr.when(cond, v)
    return expr.otherwise(col(priority)).cast("int")
