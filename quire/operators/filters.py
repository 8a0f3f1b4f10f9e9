"""File filters B1-B8 and per-corpus ignore rules.

An ignore pattern is tested on the file and on every ancestor directory (an
ignored directory is never entered).  Over all those levels the tests reduce
to a closed form, applied to the whole path at once:

* some segment has a binary extension, or for some pattern ``p``:
* ``path`` contains ``p`` (this subsumes the exact-name, exact-path and
  directory-prefix tests), or
* ``p = '*x'`` and some segment ends with ``x``, or
* ``p = 'x*'`` and some segment starts with ``x``.

So ``dist`` drops ``distance.js`` and ``.env`` drops ``.env.example``:
patterns are literal text, not gitignore globs.
"""
from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.paths import basename, ext_name, segments
from ..functions.text import col
from .joins import null_safe_join


def _segment_regex(patterns: Sequence[str], binary: bool) -> str | None:
    """One regex over the whole path for the segment tests, or None when a
    glob contains '/' (then segments are tested one by one).

    * binary: a segment ``X.ext`` with ``X`` non-empty and ``ext`` listed
      (case-insensitive): ``(^|/)[^/]+\\.(ext|...)(/|$)``;
    * ``*x``: a segment ends with ``x``: ``x(/|$)``;
    * ``x*``: a segment starts with ``x``: ``(^|/)x``.
    """
    import re
    alts = []
    if binary:
        alts.append(r"(?i:(?:^|/)[^/]+\.(?:" + "|".join(re.escape(e) for e in K.BINARY_EXTENSIONS) + r")(?:/|$))")
    for x in patterns:
        if x.startswith("*"):
            if "/" in x[1:]:
                return None
            alts.append(re.escape(x[1:]) + r"(?:/|$)")
        if x.endswith("*"):
            if "/" in x[:-1]:
                return None
            alts.append(r"(?:^|/)" + re.escape(x[:-1]))
    return "|".join(alts) if alts else None


def ignored(path="path", patterns: Sequence[str] = K.DEFAULT_IGNORE, binary: bool = True) -> Column:
    """True when a literal pattern list (or a binary extension) ignores the
    file or one of its ancestor directories.  The segment tests and the
    substring tests form one regex, so the path is read once and the test
    stays inside generated code (also when a filter is pushed below a
    projection that computes the path)."""
    import re
    p = col(path)
    rx = _segment_regex(patterns, binary)
    literals = [re.escape(x) for x in dict.fromkeys(patterns)]
    if rx is not None or not (binary or any(x.startswith("*") or x.endswith("*") for x in patterns)):
        alts = ([rx] if rx else []) + literals
        return p.rlike("|".join(alts)) if alts else F.lit(False)
    cond = F.exists(segments(p), lambda s: _segment_hit(s, patterns, binary))
    for x in dict.fromkeys(patterns):
        cond = cond | p.contains(x)
    return cond


def _segment_hit(s, patterns, binary):
    c = ext_name(s).isin(K.BINARY_EXTENSIONS) if binary else F.lit(False)
    for x in patterns:
        if x.startswith("*"):
            c = c | s.endswith(x[1:])
        if x.endswith("*"):
            c = c | s.startswith(x[:-1])
    return c


def rule_tests(rules: DataFrame) -> DataFrame:
    """``(corpus_id, _has, _ends, _begins)``: a corpus's patterns as the texts
    of its three tests (same closed form as :func:`ignored`).  A partial
    aggregate; a corpus's rule list is the size of its rule files."""
    p = F.col("pattern")
    return (rules.where(p.isNotNull() & (p != "")).groupBy("corpus_id").agg(
        F.collect_set(p).alias("_has"),
        F.collect_set(F.when(p.startswith("*"), F.substring(p, F.lit(2), F.length(p)))).alias("_ends"),
        F.collect_set(F.when(p.endswith("*"), F.substring(p, F.lit(1), F.length(p) - 1))).alias("_begins")))


def with_rule_tests(rows: DataFrame, rules: DataFrame | None) -> DataFrame:
    """``rows`` with the tests of their corpus (see :func:`rule_hit`).
    Callers pass narrow rows: beyond the broadcast threshold this join
    shuffles them on ``corpus_id`` (AQE splits a skewed corpus)."""
    if rules is None:
        return rows
    return null_safe_join(rows, rule_tests(rules), ["corpus_id"], "left")


def rule_hit(path) -> Column:
    """Whether a row's tests ignore ``path`` or a folder above it."""
    p = col(path)
    hit = (F.exists("_has", lambda x: F.contains(p, x))
           | F.exists(segments(p), lambda s: F.exists("_ends", lambda x: F.endswith(s, x)) | F.exists("_begins", lambda x: F.startswith(s, x))))
    return F.coalesce(hit, F.lit(False))


def without_ruled_out(rows: DataFrame, rules: DataFrame | None) -> DataFrame:
    """``rows(corpus_id, path, ...)`` that their corpus's rules do not ignore."""
    if rules is None:
        return rows
    return with_rule_tests(rows, rules).where(~rule_hit("path")).drop("_has", "_ends", "_begins")


def corpus_rules(files: DataFrame, rules: DataFrame | None, use_rule_files: bool) -> DataFrame | None:
    """``rules`` plus those of the rule files at the corpus roots, or None.
    Whether there are such files is looked up first by path alone, so texts
    are read a second time only where a corpus has one."""
    from ..sources.files import read_ignore_rules
    out = None if rules is None else rules.select("corpus_id", "pattern")
    if use_rule_files and files.where(F.col("path").isin(K.RULE_FILES)).select("path").limit(1).count():
        found = read_ignore_rules(files).select("corpus_id", "pattern")
        out = found if out is None else out.unionByName(found)
    return out


def filter_ignored(files: DataFrame, patterns: Sequence[str] = K.DEFAULT_IGNORE,
                   rules: DataFrame | None = None) -> DataFrame:
    """Drop ignored files: literal ``patterns`` for every corpus, plus optional
    per-corpus ``rules(corpus_id, pattern)``."""
    return without_ruled_out(files.where(~ignored("path", patterns)), rules)


def _extension_ok(extensions: Iterable[str] | None) -> Column:
    return ext_name(basename("path")).isin(list(extensions)) if extensions else F.lit(True)


def _size_ok(max_file_size: int | None) -> Column:
    """No cap for None and 0; a file of unknown size is within any cap."""
    return F.coalesce(F.col("size") <= F.lit(int(max_file_size)), F.lit(True)) if max_file_size else F.lit(True)


def _no_nul() -> Column:
    return ~F.coalesce(F.col("content").contains("\x00"), F.lit(False))


def filter_extensions(files: DataFrame, extensions: Iterable[str] | None) -> DataFrame:
    """Allow-list on the lower-cased extension; the list itself is used as given."""
    return files.where(_extension_ok(extensions)) if extensions else files


def filter_max_file_size(files: DataFrame, max_file_size: int | None = None) -> DataFrame:
    """B4, an explicit option (``K.DEFAULT_MAX_FILE_SIZE`` is the usual cap)."""
    return files.where(_size_ok(max_file_size)) if max_file_size else files


def filter_nul(files: DataFrame) -> DataFrame:
    return files.where(_no_nul())


def selected(ignore: Sequence[str] = (), extensions=None, max_file_size: int | None = None) -> Column:
    """B1-B5 and B7 on one row: default ignore list + ``ignore``, extension
    allow-list, size cap, NUL check (per-corpus rules come on top)."""
    return (~ignored("path", list(K.DEFAULT_IGNORE) + list(ignore or [])) & _extension_ok(extensions)
            & _size_ok(max_file_size) & _no_nul())


def select_files(files: DataFrame, ignore: Sequence[str] = (), extensions=None,
                 max_file_size: int | None = None,
                 rules: DataFrame | None = None, use_rule_files: bool = True) -> DataFrame:
    """Selected files with their content.  With per-corpus rules the kept paths
    are found on narrow rows and the content is joined to them by key."""
    out = files.where(selected(ignore, extensions, max_file_size))
    found = corpus_rules(files, rules, use_rule_files)
    if found is None:
        return out
    return null_safe_join(out, without_ruled_out(out.select("corpus_id", "path"), found).distinct(), ["corpus_id", "path"], "left_semi")
