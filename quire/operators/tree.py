"""The directory tree (H1, D5) as rows, and as text where a document needs it.

Nodes are the files and their folders, kept when the ignore rules pass on the
node's own path (extension, size and NUL filters do not apply to the tree).
What the rules ignore they ignore below, too, so of each path the longest part
that is not ignored is kept; the distinct kept paths, in order of their
segments, are the tree.

A line's glyphs say, for the node and each folder above it, whether a sibling
follows.  So kept paths are range-partitioned and sorted, and a slice is read
from its end: a path differs from the one after it in one place, above which
both have the same folders (their flags stand on a stack), at which a sibling
follows, and below which nodes are the last of their folder.  A slice's first
read path is compared with the first path of the next slice, whose flags follow
from the slices' first paths alone: one row a slice, which is all
that reaches the driver.
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from .filters import corpus_rules, ignored, rule_hit, with_rule_tests
from .ordered import slices_for

_MID, _LAST = "├── ", "└── "
_ON, _OFF = "│   ", "    "
LINES_SCHEMA = "corpus_id string, path string, segs array<string>, depth int, is_dir boolean, line string"
_EDGE_SCHEMA = "slice int, last_corpus string, first_corpus string, first array<string>, follows array<boolean>"


def _common(a: list, b: list) -> int:
    n = min(len(a), len(b))
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    return i


def _flags(segs: list, after: list | None, follows: list) -> list:
    """For each depth of ``segs`` whether a sibling follows, from the next path
    of the corpus (None: there is none) and its flags."""
    if after is None:
        return [False] * len(segs)
    c = _common(segs, after)
    flags = follows[:c]
    if c < len(segs):
        # A path that only goes on below ``segs`` is no sibling of it.
        flags = flags + [c < len(after)] + [False] * (len(segs) - c - 1)
    return flags


def _kept_paths(files: DataFrame, patterns: Sequence[str], rules: DataFrame | None) -> DataFrame:
    """Distinct ``corpus_id, segs, is_file``: kept paths, and for ignored ones
    the folders above that are kept."""
    tested = with_rule_tests(files.select("corpus_id", "path"), rules)

    def hit(path) -> Column:
        out = ignored(path, list(patterns))
        return out if rules is None else out | rule_hit(path)

    segs = F.split("path", "/", -1)
    depth = F.size(F.filter(F.sequence(F.lit(1), F.size(segs)), lambda d: ~hit(F.array_join(F.slice(segs, F.lit(1), d), "/"))))
    out = tested.select("corpus_id", hit(F.col("path")).alias("_hit"), segs.alias("_segs"), F.when(hit(F.col("path")), depth).alias("_depth"))
    out = out.select("corpus_id", F.when(F.col("_hit"), F.slice("_segs", F.lit(1), F.col("_depth"))).otherwise(F.col("_segs")).alias("segs"),
                     (~F.col("_hit")).alias("is_file"))
    return out.where(F.size("segs") > 0).groupBy("corpus_id", "segs").agg(F.min("is_file").alias("is_file"))


def _edges(batches):
    """First path of a slice (read from its end), with its flags as far as the
    slice itself tells them, and the corpus of its last path."""
    import pyarrow as pa
    from pyspark import TaskContext
    corpus, after, follows, last, begun = None, None, [], None, False
    for b in batches:
        for c, segs in zip(b.column("corpus_id").to_pylist(), b.column("segs").to_pylist()):
            if not begun:
                begun, last = True, c
            elif c != corpus:
                after = None
            follows = _flags(segs, after, follows)
            corpus, after = c, segs
    if begun:
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([last], pa.string()), pa.array([corpus], pa.string()),
             pa.array([after], pa.list_(pa.string())), pa.array([follows], pa.list_(pa.bool_()))],
            names=["slice", "last_corpus", "first_corpus", "first", "follows"])


def _entries(edges: list) -> dict:
    """For each slice the path that follows it in its last corpus, with that path's flags."""
    out, corpus, after, follows = {}, None, None, []
    for e in sorted(edges, key=lambda e: -e.slice):
        same = after is not None and corpus == e.last_corpus
        out[e.slice] = (list(after), follows) if same else (None, [])
        flags = list(e.follows)
        if same and e.first_corpus == corpus:
            # Siblings that the slice did not see itself may stand after it.
            flags = [x or y for x, y in zip(flags, _flags(list(e.first), after, follows))]
        corpus, after, follows = e.first_corpus, list(e.first), flags
    return out


def _lines(entries: dict):
    """Lines of the nodes that a slice's paths have and the paths after them do not."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        after, follows = entries.get(TaskContext.get().partitionId(), (None, []))
        corpus, begun = None, False
        for b in batches:
            out = []
            for c, segs, is_file in zip(*(b.column(n).to_pylist() for n in ("corpus_id", "segs", "is_file"))):
                if begun and c != corpus:
                    after = None
                corpus, begun = c, True
                known = _common(segs, after) if after is not None else 0
                follows = _flags(segs, after, follows)
                prefix = "".join(_ON if f else _OFF for f in follows[:known])
                for d in range(known, len(segs)):
                    is_dir = d < len(segs) - 1 or not is_file
                    line = f"{prefix}{_MID if follows[d] else _LAST}{segs[d]}{'/' if is_dir else ''}\n"
                    out.append((c, "/".join(segs[:d + 1]), segs[:d + 1], d + 1, is_dir, line))
                    prefix += _ON if follows[d] else _OFF
                after = segs
            if out:
                kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.bool_(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)],
                                                 names=["corpus_id", "path", "segs", "depth", "is_dir", "line"])
    return run


def tree_lines(files: DataFrame, patterns: Sequence[str] = K.DEFAULT_IGNORE,
               rules: DataFrame | None = None, use_rule_files: bool = True, num_slices: int | None = None) -> DataFrame:
    """``(corpus_id, path, segs, depth, is_dir, line)``; sort by ``segs`` for
    the depth-first order with sorted siblings.  Like file selection, the
    rule files at each corpus root add per-corpus patterns."""
    from .pack import checkpoint
    kept = checkpoint(_kept_paths(files, patterns, corpus_rules(files, rules, use_rule_files)))
    n = num_slices or slices_for(kept)
    order = [F.col("corpus_id").desc(), F.col("segs").desc()]
    sliced = checkpoint(kept.repartitionByRange(n, "corpus_id", "segs").sortWithinPartitions(*order))
    entries = _entries(sliced.mapInArrow(_edges, _EDGE_SCHEMA).collect()) if n > 1 else {}
    return sliced.mapInArrow(_lines(entries), LINES_SCHEMA)


def tree_text(lines: DataFrame) -> DataFrame:
    """One tree string per corpus (only for rendering a document)."""
    return lines.groupBy("corpus_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segs", "line"))), lambda x: x["line"]), "")
        .alias("tree"))
