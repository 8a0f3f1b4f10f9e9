"""N-gram Jaccard join as a T-occurrence search (DivideSkip), to components.

Two documents link when their sets of distinct ``size``-word shingles have a
Jaccard similarity of at least ``percent`` / 100.  An overlap of at least
``T`` shingles is then required, and a search merges the short inverted lists
of a set's shingles and probes its long ones by binary search.

1. One scan gives every document's set size and class key (a 64-bit hash of
   its set; copies share a key and are searched once).  Another sends half of
   all shingles, packed to a few bytes each, to find those that only one class
   has.  A class with so many of these that ``T`` shared ones cannot be left
   has no link and is done; the others' sets are gathered.
2. Exact document frequencies of the gathered sets' shingles give an order
   from rare to frequent, so the lists a search must merge are the short ones.
   Sets that link share one of their ``n - ceil(percent * n / 100) + 1`` first
   shingles in that order.  The lists of these are reduced to stars around one
   member; components of the stars are search groups: linked sets are always
   in one group.
3. Groups are cut into parts of at most ``part`` shingles and ``WORK`` entries
   to merge, so a large group of near copies is not one long task.  Each task streams
   its parts, builds the inverted lists of one part at a time and searches
   every set in it.  Sets already connected need no further test, and what
   leaves a part is a forest of links, never all pairs.
4. A group of several parts gets two more searches: one representative per
   component so far against the others', then every set outside the group's
   largest component, as a query stream, against all of its parts.  Pairs
   inside the largest component are connected already, so no link is lost.

Links of all parts are contracted to components.  Equal 64-bit hashes are
taken as equal shingles and sets.

Edge cases: texts without words (null, empty, blanks) have an empty set and
link with nothing; fewer than ``size`` words are one shingle; repeated rows
are copies; rows with a null id take part and have their component's smallest
id; an empty table gives an empty result; only the id and text columns are
read, so other columns cannot clash.
"""
from __future__ import annotations

from typing import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, prepare, utf8_buffers
from .graph import connected_components, smallest_linked
from .words import SPACED, blocks, distinct, mix, shingles

SIZE = 5
PERCENT = 75
MU = 0.01            # weight of a probe against a merge when the long lists are chosen
PART = 1 << 20       # shingles in one part
WORK = 1 << 27       # entries of inverted lists that the search of one part merges, at most about
OFTEN = 64           # frequencies from here on count as equal in the order
_HELD = 1 << 21      # shingles a task holds before it packs them
_BUCKET = 1 << 21    # shingles in a bucket of the packed exchange, on average
_NONE = 0xFFFF


def _ceil(percent: int, n):
    return -(-percent * n // 100)


def _sets(data, offsets, size: int):
    """``(rows of the block, hashes, owner, n by row, key by row)`` of runs of texts."""
    for lo, hi, w in blocks(data, offsets, SPACED):
        h, owner = distinct(*shingles(w, size))
        n = np.bincount(owner, minlength=hi - lo)
        total = np.zeros(len(h) + 1, dtype=np.uint64)
        np.cumsum(mix(h ^ np.uint64(0xA24BAED4963EE407)), out=total[1:])
        end = np.cumsum(n)
        key = mix(total[end] - total[end - n] + n.astype(np.uint64))
        yield lo, hi, h, owner, n, key.view(np.int64)


def _half(h: np.ndarray) -> np.ndarray:
    """The half of all shingles that is looked through for unshared ones."""
    return (h & np.uint64(1)) == 0


def _scan(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, n, half`` (shingles of the set in the half) and ``key`` of every row."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n", T.LongType()),
                           T.StructField("half", T.LongType()), T.StructField("key", T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for b in batches:
            parts = [(n, np.bincount(owner[_half(h)], minlength=len(n)), key)
                     for _, _, h, owner, n, key in _sets(*utf8_buffers(b.column(1)), size)]
            if parts:
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.concatenate(x), pa.int64()) for x in zip(*parts))],
                                                 names=["doc_id", "n", "half", "key"])

    return docs.mapInArrow(run, schema)


def _heads(x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    out[1:] = x[1:] != x[:-1]
    return out


def _shared_counts(docs: DataFrame, size: int, buckets: int) -> DataFrame:
    """``(key, c)``: of each class, shingles in the half that another class has
    too (a count may be too high, never too low).

    A task packs what it holds: shingles that two of its classes have are
    settled there and go out once, without a class, so a shingle that a third
    of all documents have is one entry per pack.  The others go out as 32 bits
    of their hash, dealt to buckets by the other bits, and a 16-bit number of
    their class.  Counts travel packed, too, dealt by their class."""
    import pyarrow as pa
    counted = "bucket int, keys binary, counts binary"

    def dealt(key: np.ndarray, c: np.ndarray):
        """Counts packed by the bucket of their class."""
        to = ((key.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        key, c, to = key[order], c[order], to[order]
        at = np.append(np.flatnonzero(_heads(to)), len(to))
        rows = [(int(to[a]), key[a:z].tobytes(), c[a:z].astype("<u4").tobytes()) for a, z in zip(at[:-1], at[1:])]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))],
                                          names=["bucket", "keys", "counts"])

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa
        held: list[tuple] = []
        total = classes = packs = 0

        def flush():
            h, key = np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])
            held.clear()
            names, own = np.unique(key, return_inverse=True)
            order = np.lexsort((own, h))
            h, own = h[order], own[order]
            new = _heads(h) | _heads(own)
            h, own = h[new], own[new]
            head = _heads(h)
            run = np.diff(np.append(np.flatnonzero(head), len(h)))
            many = np.repeat(run > 1, run)
            k, c = np.unique(own[many], return_counts=True)
            h, own = h[head], np.where(many[head], _NONE, own[head])
            bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            at = np.searchsorted(bucket, np.arange(buckets + 1))        # h is sorted, so its buckets are
            out = [(packs % buckets, b"", c.astype("<u4").tobytes(), names[k].tobytes())] if len(k) else []
            for i in np.flatnonzero(np.diff(at)).tolist():
                x = own[at[i]:at[i + 1]]
                used, x = np.unique(x, return_inverse=True)
                has = len(used) and used[-1] == _NONE
                x = np.where(x == len(used) - 1, _NONE, x) if has else x
                out.append((i, h[at[i]:at[i + 1]].astype("<u4").tobytes(), x.astype("<u2").tobytes(),
                            names[used[:-1] if has else used].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), *[pa.binary()] * 3))],
                                              names=["bucket", "hashes", "owner", "keys"])

        for b in batches:
            for _, _, h, owner, n, key in _sets(*utf8_buffers(b.column(0)), size):
                mine = _half(h)
                # A block has far fewer rows than there are numbers for classes.
                if held and (total >= _HELD or classes + len(n) >= _NONE):
                    if total:
                        yield flush()
                    held.clear()
                    total, classes, packs = 0, 0, packs + 1
                held.append((h[mine], key[owner[mine]]))
                total, classes = total + len(held[-1][0]), classes + len(n)
        if total:
            yield flush()

    def meet(batches: Iterator) -> Iterator:
        import pyarrow as pa
        at, held = None, []

        def close():
            h = np.concatenate([x for x, _ in held])
            key = np.concatenate([y for _, y in held])              # 0 stands for several classes
            order = np.lexsort((key, h))
            h, key = h[order], key[order]
            new = _heads(h) | _heads(key) | (key == 0)
            h, key = h[new], key[new]
            head = np.flatnonzero(_heads(h))
            run = np.diff(np.append(head, len(h)))
            several = np.add.reduceat((key == 0).astype(np.int64), head) > 0 if len(h) else head > 0
            k, c = np.unique(key[np.repeat((run > 1) | several, run) & (key != 0)], return_counts=True)
            return dealt(k, c) if len(k) else None

        for b in batches:
            for bucket, h, owner, keys in zip(*(c.to_pylist() for c in b.columns)):
                names = np.frombuffer(keys, "<i8")
                if not h:
                    yield dealt(names, np.frombuffer(owner, "<u4"))
                    continue
                if bucket != at and held:
                    out = close()
                    held.clear()
                    if out is not None:
                        yield out
                at = bucket
                held.append((np.frombuffer(h, "<u4"), np.append(names, np.zeros(1, np.int64))[np.minimum(np.frombuffer(owner, "<u2"), len(names))]))
        out = close() if held else None
        if out is not None:
            yield out

    def add(batches: Iterator) -> Iterator:
        at, held = None, []

        def close():
            key, c = (np.concatenate(x) for x in zip(*held))
            k, own = np.unique(key, return_inverse=True)
            return _longs(key=k, c=np.bincount(own, weights=c).astype(np.int64))

        for b in batches:
            for bucket, keys, c in zip(*(x.to_pylist() for x in b.columns)):
                if bucket != at and held:
                    yield close()
                    held.clear()
                at = bucket
                held.append((np.frombuffer(keys, "<i8"), np.frombuffer(c, "<u4")))
        if held:
            yield close()

    packed = docs.select("text").mapInArrow(pack, "bucket int, hashes binary, owner binary, keys binary")
    met = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, counted)
    return met.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add, "key long, c long")


def _stars(list_of: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lists given as (list, node) pairs: lists, their smallest nodes, and
    the distinct links of other members to those."""
    order = np.lexsort((node, list_of))
    list_of, node = list_of[order], node[order]
    head = _heads(list_of)
    lead = node[head][np.cumsum(head) - 1]
    off = lead != node
    links = np.unique(np.stack([lead[off], node[off]], axis=1), axis=0) if off.any() else np.zeros((0, 2), node.dtype)
    return list_of[head], node[head], links[:, 0], links[:, 1]


def _longs(**columns):
    import pyarrow as pa
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns.values()], names=list(columns))


def _candidate_links(sets: DataFrame, percent: int) -> DataFrame:
    """Stars ``(u, v)`` over the keys of ``sets`` that share a prefix shingle."""

    def post(batches: Iterator) -> Iterator:
        for b in batches:
            key, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            at, rows = 0, 0
            while at < len(key):
                end = max(at + 1, int(np.searchsorted(np.cumsum(n[at:]), 1 << 19)) + at)
                h = np.concatenate([np.frombuffer(x.as_py(), "<i8") for x in b.column(2).slice(at, end - at)])
                yield _longs(list=h, node=np.repeat(key[at:end], n[at:end]), n=np.repeat(n[at:end], n[at:end]))
                at = end

    def often(batches: Iterator) -> Iterator:
        """From pairs ordered by list: those of lists of two or more, with
        their frequency (``OFTEN`` stands for more).  At most ``OFTEN`` pairs
        of an unfinished list are held."""
        held, known = None, None
        for b in batches:
            x = [c.to_numpy() for c in b.columns]
            if held is not None:
                x = [np.concatenate(y) for y in zip(held, x)]
            if not len(x[0]):
                continue
            head = np.flatnonzero(_heads(x[0]))
            run = np.diff(np.append(head, len(x[0])))
            df = np.minimum(run, OFTEN)
            if known is not None and x[0][0] == known:
                df[0] = OFTEN
            tail = head[-1]
            if df[-1] >= OFTEN:
                known, held, keep = x[0][-1], None, len(x[0])
            else:
                known, held, keep = None, [c[tail:] for c in x], tail
            df = np.repeat(df, run)[:keep]
            ok = df > 1
            yield _longs(node=x[1][:keep][ok], n=x[2][:keep][ok], often=df[ok], list=x[0][:keep][ok])
        if held is not None and len(held[0]) > 1:
            m = len(held[0])
            yield _longs(node=held[1], n=held[2], often=np.full(m, m), list=held[0])

    def prefix(batches: Iterator) -> Iterator:
        """From shared shingles ordered by class and frequency: those among
        the class's first, its unshared ones coming before them."""
        def firsts(x):
            head = np.flatnonzero(_heads(x[0]))
            run = np.diff(np.append(head, len(x[0])))
            rank = np.arange(len(x[0])) - np.repeat(head, run)
            ok = x[1] - np.repeat(run, run) + rank < x[1] - _ceil(percent, x[1]) + 1
            return _longs(list=x[3][ok], node=x[0][ok])

        held = None
        for b in batches:
            x = [c.to_numpy() for c in b.columns]
            if held is not None:
                x = [np.concatenate(y) for y in zip(held, x)]
            if len(x[0]):
                tail = int(np.flatnonzero(_heads(x[0]))[-1])
                held = [c[tail:] for c in x]
                if tail:
                    yield firsts([c[:tail] for c in x])
        if held is not None:
            yield firsts(held)

    def meet(batches: Iterator) -> Iterator:
        last = None
        for b in batches:
            x, y = b.column(0).to_numpy(), b.column(1).to_numpy()
            if last is not None:
                x, y = np.concatenate([last[0], x]), np.concatenate([last[1], y])
            if len(x):
                heads, lead, u, v = _stars(x, y)
                last = heads[-1:], lead[-1:]
                yield _longs(u=u, v=v)

    pairs = (sets.select("key", "n", "hashes").mapInArrow(post, "list long, node long, n long")
             .repartition("list").sortWithinPartitions("list").mapInArrow(often, "node long, n long, often long, list long"))
    first = (pairs.repartition("node").sortWithinPartitions("node", "often", "list").mapInArrow(prefix, "list long, node long"))
    return first.repartition("list").sortWithinPartitions("list", "node").mapInArrow(meet, "u long, v long")


def _bitmap(keys: DataFrame, bits: int = 22) -> np.ndarray:
    """A table of ``2 ** bits`` flags (fixed size) of which cells hold a key."""
    width = 1 << 12

    def mark(batches: Iterator) -> Iterator:
        import pyarrow as pa
        on = np.zeros(1 << bits, dtype=bool)
        for b in batches:
            on[(b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)] = True
        rows = on.reshape(-1, width)
        at = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([np.packbits(rows[i]).tobytes() for i in at], pa.binary())],
                                         names=["cell", "flags"])

    def join(batches: Iterator) -> Iterator:
        import pyarrow as pa
        got: dict[int, np.ndarray] = {}
        for b in batches:
            for cell, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(raw, np.uint8)
                got[cell] = got[cell] | x if cell in got else x
        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int32()), pa.array([x.tobytes() for x in got.values()], pa.binary())],
                                         names=["cell", "flags"])

    out = np.zeros((1 << bits) // width * (width // 8), dtype=np.uint8).reshape(-1, width // 8)
    rows = keys.mapInArrow(mark, "cell int, flags binary").repartition("cell").mapInArrow(join, "cell int, flags binary")
    for r in rows.collect():
        out[r.cell] = np.frombuffer(r.flags, np.uint8)
    return np.unpackbits(out.reshape(-1)).astype(bool)


def _gathered(docs: DataFrame, keys: DataFrame, size: int) -> DataFrame:
    """``(key, n, hashes)`` once for each class in ``keys(key)``.  A table of
    flags keeps most of the others from being sent; the join does the rest."""
    bits = 22
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(keys, bits))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        flags, done = shared.value, set()
        for b in batches:
            for _, _, h, _, n, key in _sets(*utf8_buffers(b.column(0)), size):
                at = np.cumsum(n) - n
                hit = np.flatnonzero(flags[(key.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)] & (n > 0))
                rows = []
                for i in hit.tolist():
                    if int(key[i]) not in done:
                        done.add(int(key[i]))
                        rows.append(i)
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[rows], pa.int64()), pa.array(n[rows], pa.int64()),
                         pa.array([h[at[i]:at[i] + n[i]].tobytes() for i in rows], pa.binary())], names=["key", "n", "hashes"])

    sets = docs.select("text").mapInArrow(run, "key long, n long, hashes binary")
    return sets.join(keys, "key", "left_semi").dropDuplicates(["key"])


class Part:
    """Inverted lists of one part's sets, and the links found in it."""

    def __init__(self, keys: np.ndarray, label: np.ndarray, n: np.ndarray, hashes: np.ndarray, percent: int):
        order = np.argsort(n, kind="stable")
        at = np.cumsum(n) - n
        self.percent, self.key, self.n = percent, keys[order], n[order]
        self.label = np.unique(label[order], return_inverse=True)[1]
        self.labels = {int(x): int(i) for x, i in zip(label[order], self.label)}
        self.now: dict[int, int] = {}                   # labels that were joined to another
        self.m = len(keys)
        flat = hashes[np.repeat(at[order] - (np.cumsum(self.n) - self.n), self.n) + np.arange(len(hashes))]
        owner = np.repeat(np.arange(self.m), self.n)
        by = np.argsort(flat, kind="stable")            # inverted lists, each in ascending order of its sets
        flat = flat[by]
        self.owner = owner[by]
        head = np.ones(len(flat), dtype=bool)
        head[1:] = flat[1:] != flat[:-1]
        self.begin = np.append(np.flatnonzero(head), len(flat))
        self.shingle = flat[head]
        number = np.cumsum(head) - 1
        self.places = number * self.m + self.owner      # (list, set) pairs in one sorted array
        self.lists_of = np.empty(len(flat), dtype=np.int64)
        self.lists_of[by] = number
        self.first = np.append(np.cumsum(self.n) - self.n, len(flat))
        self.links: list[tuple[int, int]] = []

    def _search(self, lists: np.ndarray, n: int, key: int, label: int, below: int) -> int:
        """Link a set of ``n`` shingles, given by its inverted lists, with sets
        numbered under ``below``; returns its label afterwards."""
        need = _ceil(self.percent, n)
        size = self.begin[lists + 1] - self.begin[lists]
        if len(lists) < need:
            return label
        order = np.argsort(size, kind="stable")
        longest = int(size[order[-1]])
        n_long = min(need - 1, int(need / (MU * np.log2(longest + 1) + 1)), len(lists))
        split = len(lists) - n_long
        short, long = lists[order[:split]], lists[order[split:]]
        # Merge of the short lists: sorted runs laid end to end and merged by a stable sort.
        length = self.begin[short + 1] - self.begin[short]
        end = np.cumsum(length)
        run = self.owner[np.repeat(self.begin[short] - (end - length), length) + np.arange(int(end[-1]) if len(end) else 0)]
        run = run[run < below]
        if not len(run):
            return label
        run = run[self.label[run] != label]
        if not len(run):
            return label
        run.sort(kind="stable")
        head = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        found, times = run[head], np.diff(np.append(head, len(run)))
        ok = (times >= need - n_long) & (self.n[found] >= need) & (n >= _ceil(self.percent, self.n[found]))
        found, times = found[ok], times[ok]
        for i in np.argsort(-times, kind="stable").tolist():
            s, got = int(found[i]), int(times[i])
            if self.label[s] == label:
                continue
            want = -(-self.percent * (n + int(self.n[s])) // (100 + self.percent))
            if got + n_long < want:
                continue
            # Binary probe of the set in every long list at once.
            probe = long * self.m + s
            at = np.minimum(np.searchsorted(self.places, probe), len(self.places) - 1)
            got += int(np.count_nonzero(self.places[at] == probe))
            if got >= want:
                self.links.append((key, int(self.key[s])))
                label = self._join(label, int(self.label[s]))
        return label

    def _join(self, a: int, b: int) -> int:
        self.label[self.label == a] = b
        self.now[a] = b
        return b

    def search_all(self) -> None:
        for r in range(self.m):
            lists = self.lists_of[self.first[r]:self.first[r + 1]]
            lists = lists[self.begin[lists + 1] - self.begin[lists] > 1]
            self._search(lists, int(self.n[r]), int(self.key[r]), int(self.label[r]), r)

    def query(self, key: int, label: int, hashes: np.ndarray) -> None:
        """One set of the query stream; ``label`` is its component so far."""
        k = np.minimum(np.searchsorted(self.shingle, hashes), len(self.shingle) - 1)
        own = self.labels.setdefault(label, len(self.labels))
        while own in self.now:
            own = self.now[own]
        self._search(k[self.shingle[k] == hashes], len(hashes), key, own, self.m)


def _searched(rows: DataFrame, percent: int) -> DataFrame:
    """Links found in the parts of ``rows(grp, part, query, key, label, n,
    hashes)``, as stars ``(u, v)`` around the smallest key linked: sets with ``query = 0`` are the part's index and, if
    the part has no queries, are searched against each other."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        state: dict = {"at": None}

        def built():
            if state.get("part") is None and state["index"]:
                key, label, n, raw = (list(x) for x in zip(*state["index"]))
                state["part"] = Part(np.array(key), np.array(label), np.array(n), np.concatenate([np.frombuffer(r, "<u8") for r in raw]), percent)
                state["index"] = []
            return state.get("part")

        def close():
            if state["at"] is None:
                return None
            part = built()
            if part is None:
                return None
            if not state["queried"]:
                part.search_all()
            if not part.links:
                return None
            u, v = smallest_linked(*(np.array(x, dtype=np.int64) for x in zip(*part.links)))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for b in batches:
            for grp, part, query, key, label, n, raw in zip(*(c.to_pylist() for c in b.columns)):
                if state["at"] != (grp, part):
                    out = close()
                    if out is not None:
                        yield out
                    state = {"at": (grp, part), "index": [], "queried": False}
                if not query:
                    state["index"].append((key, label, n, raw))
                else:
                    state["queried"] = True
                    p = built()
                    if p is not None:
                        p.query(key, label, np.frombuffer(raw, "<u8"))
        out = close()
        if out is not None:
            yield out

    cols = ["grp", "part", "query", "key", "label", "n", "hashes"]
    return (rows.select(*cols).repartition("grp", "part").sortWithinPartitions("grp", "part", "query", "n", "key")
            .mapInArrow(run, "u long, v long"))


def _parts(sets: DataFrame, part: int) -> DataFrame:
    """``sets`` with ``parts``, the number of parts of its group, and ``part``.
    A part is bounded by its shingles and by the work of its search: every
    shingle may stand in the lists of all its sets, so ``k`` parts of a group
    have the ``k * k``-th of the group's work each."""
    merged = F.count(F.lit(1)) * F.sum("n")
    parts = F.greatest(F.ceil(F.sum("n") / F.lit(part)), F.ceil(F.sqrt(merged / F.lit(WORK))))
    total = sets.groupBy("grp").agg(parts.cast("int").alias("parts"))
    return (sets.join(total, "grp")
            .withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")))


def linked_classes(docs: DataFrame, classes: DataFrame, size: int, percent: int, part: int) -> DataFrame:
    """``(node, component)`` of classes with a link to another class;
    ``classes`` has ``key, n, half`` once for each."""
    total = classes.agg(F.sum("half").alias("s")).first().s or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // _BUCKET))
    shared = _shared_counts(docs, size, int(buckets))
    left = F.col("n") - F.ceil(F.col("n") * percent / 100)            # unshared shingles a linked set can have
    open_ = classes.join(shared, "key", "left").where(F.col("half") - F.coalesce("c", F.lit(0)) <= left).select("key")
    sets = cut(_gathered(docs, cut(open_), size))
    groups = connected_components(_candidate_links(sets, percent)).withColumnRenamed("node", "key").withColumnRenamed("component", "grp")
    sets = cut(_parts(sets.join(groups, "key"), part))
    alone = sets.withColumn("query", F.lit(0)).withColumn("label", F.col("key"))
    one = cut(_searched(alone.where("parts = 1"), percent))          # a group of one part is searched in full
    stars = one.select(F.col("u").alias("node"), F.col("v").alias("component"))
    big = sets.where("parts > 1")
    if not big.limit(1).count():
        return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())

    def labelled(links: DataFrame) -> DataFrame:
        c = connected_components(links).withColumnRenamed("node", "key").withColumnRenamed("component", "label")
        return big.join(c, "key", "left").withColumn("label", F.coalesce("label", "key"))

    links = cut(_searched(alone.where("parts > 1"), percent))
    heads = _parts(labelled(links).where("label = key").drop("label", "parts", "part"), part)
    links = cut(links.unionByName(_searched(heads.withColumn("query", F.lit(0)).withColumn("label", F.col("key")), percent)))
    now = cut(labelled(links))
    most = (now.groupBy("grp", "label").count().groupBy("grp")
            .agg(F.max(F.struct("count", "label")).getField("label").alias("most")))
    rest = now.join(most, "grp").where("label <> most").drop("most")
    queries = (rest.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
               .withColumn("query", F.lit(1)))
    # A group with a single component has no queries and is searched no more.
    index = now.withColumn("query", F.lit(0)).join(rest.select("grp").distinct(), "grp", "left_semi")
    links = links.unionByName(_searched(index.unionByName(queries.select(*index.columns)), percent))
    return connected_components(links).unionByName(stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct()))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE,
                       percent: int = PERCENT, part: int = PART) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``;
    ``component_id`` is the smallest id reachable by links, its own included."""
    prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = cut(_scan(src, size)).withColumn("key", F.when(F.col("n") > 0, F.col("key")))
    classes = cut(rows.where("key is not null").groupBy("key")
                  .agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("half").alias("half")))
    linked = linked_classes(src.select("text"), classes.drop("least"), size, percent, part)
    classes = classes.select("key", "least")
    known = classes.join(linked.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    by_key = known.select("key", "component").join(least, "component").select("key", "component_id")
    # Classes of several rows or with links only; the others are their own component.
    return (rows.join(by_key, "key", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))
