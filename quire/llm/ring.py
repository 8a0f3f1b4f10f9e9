"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``vnodes`` points on a ring of 64-bit hashes; a key belongs to
the first point clockwise.  A shard that is full passes what its points cannot
take on to the next point clockwise whose shard has room.  With the capacity
of all shards equal to the number of rows (``slack = 0``), every shard ends
exactly full, so counts differ by at most one; with slack, fewer rows move
when a shard is added.

Rows are ordered along the ring once, by a range partition that cuts a hot key
into slices (rows of equal keys share a ring position and stay side by side, in
the order of their ids), which gives each row its rank.  Those rows travel and
are written twice, so callers pass narrow rows: keys as hashes, no texts.  What the driver sees is one
row count per ring point.  It walks the points clockwise and turns them into
rank intervals, each with its shard and first slot; there are at most a few
intervals per point.  Rows look their interval up in that table.

Edge cases: null keys are a key of their own; null ids come first among equal
keys; repeated rows are rows of their own, and equal in
all that orders them they may swap slots; fewer rows than shards leave shards
empty; an empty table gives an empty result; columns that clash with result
columns are replaced.
"""
from __future__ import annotations

import hashlib
from typing import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import ordered_scan
from .common import cut, extended, prepare, without

SHARDS = 8
VNODES = 64


def ring_points(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """``(point, shard)`` in clockwise order; points of a shard do not depend on the others."""
    out = [(int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big", signed=True), s)
           for s in range(shards) for v in range(vnodes)]
    return sorted(out)


def assign(counts: list[int], owners: list[int], capacity: list[int]) -> list[tuple[int, int, int, int]]:
    """Intervals ``(first rank, shard, first slot, rows)`` in order of rank.

    ``counts[a]`` rows stand before point ``a`` and after the one before it.
    First every point's shard takes from its own arcs, clockwise, up to its
    capacity; then what is left of each arc goes on to the next points."""
    left = list(capacity)
    parts: list[list[tuple[int, int]]] = [[] for _ in counts]           # by arc: (rows, shard)
    rest = list(counts)
    for a, s in enumerate(owners):
        take = min(rest[a], left[s])
        if take:
            parts[a].append((take, s))
            rest[a] -= take
            left[s] -= take
    for a in range(len(counts)):
        step = a
        while rest[a]:
            step = (step + 1) % len(counts)
            s = owners[step]
            take = min(rest[a], left[s])
            if take:
                parts[a].append((take, s))
                rest[a] -= take
                left[s] -= take
    used, rank, out = [0] * len(capacity), 0, []
    for arc in parts:
        for rows, s in arc:
            out.append((rank, s, used[s], rows))
            used[s] += rows
            rank += rows
    return out


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """Equal shares, the first shards taking one more; ``slack`` adds that part on top."""
    base, more = divmod(rows, shards)
    even = [base + (s < more) for s in range(shards)]
    return [c + int(np.ceil(c * slack)) for c in even]


def shard(df: DataFrame, keys: list[str], id_col: str = "doc_id", shards: int = SHARDS, vnodes: int = VNODES,
          slack: float = 0.0) -> DataFrame:
    """``df`` with ``shard`` and ``slot`` (gapless from 0 in each shard), by
    the hash of the columns ``keys``."""
    prepare(df.sparkSession)
    base = without(df, ["shard", "slot"])
    points = ring_points(shards, vnodes)
    rows = cut(base.withColumns({"_at": F.xxhash64(*keys), "_ring": F.lit(0)}))
    ranked = ordered_scan(rows, "_ring", [F.col("_at"), *[F.col(k) for k in keys], F.col(id_col)], pos_col="_rank")
    bounds = np.array([p for p, _ in points], dtype=np.int64)

    def arcs(batches: Iterator) -> Iterator:
        import pyarrow as pa
        n = np.zeros(len(bounds), dtype=np.int64)
        for b in batches:
            n += np.bincount(np.searchsorted(bounds, b.column(0).to_numpy(), "left") % len(bounds), minlength=len(bounds))
        k = np.flatnonzero(n)
        if len(k):
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(n[k], pa.int64())], names=["arc", "n"])

    found = {r.arc: r.n for r in rows.select("_at").mapInArrow(arcs, "arc int, n long").groupBy("arc").agg(F.sum("n").alias("n")).collect()}
    # Ranks run from the smallest hash; the arc over the end of the ring has its rows at both ends.
    first = rows.where(F.col("_at") <= int(bounds[0])).count() if found else 0
    counts = [first] + [found.get(a, 0) for a in range(1, len(points))] + [found.get(0, 0) - first]
    owners = [s for _, s in points] + [points[0][1]]
    table = assign(counts, owners, capacities(sum(counts), shards, slack))
    starts, owner, slots = (np.array([t[i] for t in table], dtype=np.int64) for i in range(3))
    names = base.columns
    schema = extended(base, [T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for b in batches:
            rank = b.column(b.num_columns - 1).to_numpy() - 1
            i = np.searchsorted(starts, rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(owner[i], pa.int32()), pa.array(slots[i] + rank - starts[i])],
                                             names=[*names, "shard", "slot"])

    return ranked.select(*names, "_rank").mapInArrow(place, schema)
