"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item gives windows of ``window`` consecutive words (a shorter
item is one window).  A window's set is its shingles of ``q`` words; a document
contains the window only if it holds all of them, so the necessary prefix is
one shingle: the one that is rarest in the corpus.  Three steps:

1. count how often each benchmark shingle occurs in all documents and order
   every window's shingles by that;
2. join the documents' shingles with the windows' prefix shingles, and keep a
   match only where the window fits: with the shingle at word ``p`` of the
   document and at word ``o`` of the window, the window would span words
   ``p - o`` to ``p - o + length``, which must lie inside the document;
3. verify the candidate span word for word.

Equal benchmark texts are one entry with the ids of their items (a list over
``IDS`` is several entries).  Entries are dealt in running order to blocks of
at most ``BLOCK_BYTES`` of text and ids (a longer text alone), each broadcast
(that bound is its size); documents are never shuffled or grouped, only
scanned: one scan for the counts, one for the join (per block).  Nothing
depends on how often a word, line or passage repeats.

Edge cases: texts of any length are read whole, in pieces of bounded bytes; null
and empty texts have no words and are not contaminated; null
or empty items give no window; items with equal ids are one item with all
their windows (a null id is written as ``null``); repeated documents are judged
one by one; an empty benchmark marks nothing; input columns with the names of
result columns are replaced.
"""
from __future__ import annotations

import hashlib
from typing import Iterator, NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import ordered_scan
from .common import cut, extended, prepare, utf8_buffers, without
from .words import ALNUM, blocks, rolling, words

WINDOW = 13
SHINGLE = 3
BLOCK_BYTES = 4 << 20
IDS = 4096               # item ids of one text in one entry, about

RESULT = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
          T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()),
          T.StructField("contaminated", T.BooleanType()),
          T.StructField("item_ids", T.ArrayType(T.StringType())),
          T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.IntegerType())))]


class Windows(NamedTuple):
    """Distinct windows of a benchmark block.  ``words`` holds the word bytes
    of each window, ``items`` the items it comes from."""
    words: list
    hashes: list
    items: list


def item_windows(rows: list[tuple], window: int) -> Windows:
    """Windows of entries ``(list of item ids, text)``."""
    found: dict[bytes, tuple] = {}
    for items, text in rows:
        raw = (text or "").encode()
        w = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ALNUM)
        low = raw.lower()                  # bytes.lower() folds A-Z alone
        tokens = [low[s:e] for s, e in zip(w.start.tolist(), w.end.tolist())]
        size = min(window, len(tokens))
        for i in range(len(tokens) - size + 1 if tokens else 0):
            key = b" ".join(tokens[i:i + size])
            if key not in found:
                found[key] = (tokens[i:i + size], w.hash[i:i + size], set())
            found[key][2].update(items)
    kept = list(found.values())
    return Windows([k[0] for k in kept], [k[1] for k in kept], [sorted(k[2]) for k in kept])


class _Lookup:
    """Finds which values of an array are among ``keys``: a table of the low
    16 bits first, a binary search for those that pass."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.low = np.zeros(1 << 16, dtype=bool)
        self.low[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(position in h, number of the key)``."""
        at = np.flatnonzero(self.low[(h & np.uint64(0xFFFF)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        ok = self.keys[k] == h[at]
        return at[ok], k[ok]


def _grams(w: Windows, q: int) -> dict[int, list[tuple[int, np.ndarray]]]:
    """By shingle size (``q``, less for windows of fewer words): window number and its shingle hashes."""
    out: dict[int, list] = {}
    for i, h in enumerate(w.hashes):
        size = min(q, len(h))
        out.setdefault(size, []).append((i, rolling(h, size)))
    return out


def _inside(at: np.ndarray, size: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text of each run of ``size`` words, and whether it ends in that text."""
    text = np.searchsorted(first, at, "right") - 1
    return text, at + size <= first[text + 1]


def shingle_counts(docs: DataFrame, text_col: str, keys: dict[int, np.ndarray]) -> dict[int, dict[int, int]]:
    """Occurrences in all documents of the given shingle hashes, by size.
    What comes back is at most one row per given shingle."""
    lookups = {q: _Lookup(k) for q, k in keys.items()}
    schema = "q int, k long, n long"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        n = {q: np.zeros(len(lk.keys), dtype=np.int64) for q, lk in lookups.items()}
        for b in batches:
            for _, _, w in blocks(*utf8_buffers(b.column(0)), ALNUM):
                for q, lk in lookups.items():
                    at, k = lk.find(rolling(w.hash, q))
                    _, ok = _inside(at, q, w.first)
                    n[q] += np.bincount(k[ok], minlength=len(lk.keys))
        for q, c in n.items():
            k = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), q), pa.int32()), pa.array(k, pa.int64()),
                                              pa.array(c[k], pa.int64())], names=["q", "k", "n"])

    total = docs.select(F.col(text_col)).mapInArrow(run, schema).groupBy("q", "k").agg(F.sum("n").alias("n"))
    out: dict[int, dict[int, int]] = {q: {} for q in keys}
    for r in total.collect():
        out[r.q][int(lookups[r.q].keys[r.k])] = r.n
    return out


class Prefixes(NamedTuple):
    """By shingle size: lookup of prefix shingles; per key the windows whose
    prefix it is, as ``(window, offset in the window)``."""
    lookup: dict
    posts: dict


def rarest_prefixes(w: Windows, q: int, counts: dict[int, dict[int, int]]) -> Prefixes:
    posts: dict[int, dict[int, list]] = {}
    for size, rows in _grams(w, q).items():
        n = counts.get(size, {})
        for i, grams in rows:
            order = min(range(len(grams)), key=lambda j: (n.get(int(grams[j]), 0), int(grams[j]), j))
            posts.setdefault(size, {}).setdefault(int(grams[order]), []).append((i, order))
    lookup = {size: _Lookup(np.array(list(p), dtype=np.uint64)) for size, p in posts.items()}
    return Prefixes(lookup, {size: [posts[size][int(k)] for k in lookup[size].keys] for size in posts})


def _matches(w, raw: bytes, win: Windows, pre: Prefixes) -> Iterator[tuple[int, int, int]]:
    """Verified ``(text, first word in the block, window)`` of one block of texts."""
    for size, lk in pre.lookup.items():
        at, k = lk.find(rolling(w.hash, size))
        text, ok = _inside(at, size, w.first)
        for a, t, key in zip(at[ok].tolist(), text[ok].tolist(), k[ok].tolist()):
            for i, offset in pre.posts[size][key]:
                s, tokens = a - offset, win.words[i]
                if s < w.first[t] or s + len(tokens) > w.first[t + 1]:
                    continue
                if not np.array_equal(w.hash[s:s + len(tokens)], win.hashes[i]):
                    continue
                if all(raw[w.start[s + j]:w.end[s + j]].lower() == x for j, x in enumerate(tokens)):
                    yield t, s, i


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def _pass(docs: DataFrame, text_col: str, win: Windows, pre: Prefixes, earlier: bool) -> DataFrame:
    """Judge each document by one block of windows, adding to what earlier blocks found."""
    base = docs if earlier else without(docs, [f.name for f in RESULT])
    schema = docs.schema if earlier else extended(base, RESULT)
    text_at = [c.lower() for c in base.columns].index(text_col.lower())
    shared = docs.sparkSession.sparkContext.broadcast((win, pre))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        win, pre = shared.value
        arrow = to_arrow_schema(schema)
        for b in batches:
            data, offsets = utf8_buffers(b.column(text_at))
            n = b.num_rows
            spans: list[list] = [[] for _ in range(n)]
            items: list[set] = [set() for _ in range(n)]
            count = np.zeros(n, dtype=np.int64)
            if earlier:
                for i, (s, x) in enumerate(zip(b.column("hit_spans").to_pylist(), b.column("item_ids").to_pylist())):
                    spans[i] += [tuple(y) for y in s]
                    items[i] |= set(x)
            for lo, hi, w in blocks(data, offsets, ALNUM):
                count[lo:hi] = np.diff(w.first)
                raw = data[offsets[lo]:offsets[hi]]
                for t, s, i in _matches(w, raw.tobytes() if pre.lookup else b"", win, pre):
                    s -= int(w.first[t])
                    spans[lo + t].append((s, s + len(win.words[i])))
                    items[lo + t].update(win.items[i])
            spans = [_merged(s) for s in spans]
            hit = [sum(y - x for x, y in s) for s in spans]
            ids = [sorted(x) for x in items]
            new = [count.tolist(), hit, [len(x) for x in ids], [_digest(x) for x in ids],
                   [h > 0 and 20 * h >= c for h, c in zip(hit, count.tolist())], ids, spans]
            kept = b.columns[:len(b.columns) - len(RESULT)] if earlier else b.columns
            m = len(kept)
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c, type=arrow.field(m + j).type) for j, c in enumerate(new)]],
                                             schema=pa.schema([*[b.schema.field(j) for j in range(m)], *list(arrow)[m:]]))

    return base.mapInArrow(run, schema)


def _benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int, ids: int = IDS) -> Iterator[list[tuple]]:
    """Entries ``(item ids as strings, text)`` of the benchmark in blocks of
    about ``limit`` bytes (a longer entry alone)."""
    item = F.coalesce(F.col(item_col).cast("string"), F.lit("null"))
    b = benchmark.select(item.alias("i"), F.col(text_col).alias("t")).where("t is not null").distinct()
    many = b.groupBy("t").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > ids)
    part = F.pmod(F.xxhash64("i"), F.ceil(F.coalesce("n", F.lit(1)) / ids).cast("long"))
    entries = b.join(many, "t", "left").groupBy("t", part.alias("part")).agg(F.collect_list("i").alias("items"))
    size = F.octet_length("t") + F.aggregate("items", F.lit(0), lambda n, x: n + F.octet_length(x) + 8) + 64
    entries = cut(entries.withColumn("size", size.cast("long")))
    total = entries.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first().s
    if total <= limit:
        yield [(r.items, r.t) for r in entries.collect()]
        return
    narrow = entries.select(F.lit(0).alias("all"), F.xxhash64("t", "part").alias("h"), "size")
    ends = ordered_scan(narrow, "all", [F.col("h"), F.col("size")], sums=["size"])
    blocks = ends.groupBy("h").agg(F.floor((F.max("cum_size") - 1) / limit).alias("block"))
    dealt = cut(entries.withColumn("h", F.xxhash64("t", "part")).join(blocks, "h"))
    for k in range(-(-int(total) // limit)):
        yield [(r.items, r.t) for r in dealt.where(F.col("block") == k).collect()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, q: int = SHINGLE,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit`` (words inside any occurrence of a
    window), ``n_items``, ``items_sha256``, ``contaminated`` (``n_hit > 0`` and
    ``20 * n_hit >= n_words``), ``item_ids`` and ``hit_spans`` (word spans)."""
    prepare(docs.sparkSession)
    out, earlier = docs, False
    for rows in _benchmark_blocks(benchmark, item_col, item_text, block_bytes):
        win = item_windows(rows, window)
        if not win.words:
            continue
        grams = {size: np.unique(np.concatenate([g for _, g in x])) for size, x in _grams(win, q).items()}
        out = _pass(out, text_col, win, rarest_prefixes(win, q, shingle_counts(docs, text_col, grams)), earlier)
        earlier = True
    none = Windows([], [], [])
    return out if earlier else _pass(out, text_col, none, rarest_prefixes(none, q, {}), False)
