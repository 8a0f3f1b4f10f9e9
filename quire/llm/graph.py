"""Connected components of an edge table by alternating star contractions."""
from __future__ import annotations

from typing import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges that one task contracts on its own first.
EDGES_PER_TASK = 1 << 20


def smallest_linked(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(node, component)`` of the nodes that are not the smallest of their component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = np.minimum(new, new[new])
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    off = label != np.arange(len(nodes))
    return nodes[off], nodes[label[off]]


def _contracted(edges: DataFrame, tasks: int) -> DataFrame:
    """Stars ``(u, v)`` of the components within each of ``tasks`` tasks."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        parts = [[c.to_numpy() for c in b.columns] for b in batches]
        if parts:
            node, low = smallest_linked(*(np.concatenate(x) for x in zip(*parts)))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(low, pa.int64())], names=["u", "v"])

    return edges.coalesce(tasks).mapInArrow(run, "u long, v long")


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r.n, r.x


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node with an edge in ``edges(u, v)``;
    the component is its smallest node.

    Tasks first contract their own edges, a bounded number each; a graph that
    fits one task is done with that.  Each round then hangs larger neighbours on the smallest one (large star), then
    smaller ones (small star), until nothing changes; rounds grow with the
    logarithm of the longest path.  Smallest neighbours are aggregated before
    the shuffle, so a node with very many neighbours is no hot group, and each
    round is written to the shared checkpoint folder.
    """
    ordered = (F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u"))
    e = cut(edges.where("u <> v").select(*ordered).distinct())
    tasks = max(1, -(-e.count() // EDGES_PER_TASK))
    e = cut(_contracted(e.select("u", "v"), tasks))
    state = _state(e)
    while tasks > 1:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = cut(small.select("u", F.col("m").alias("v"))
                .unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
                .select(*ordered).distinct())
        now = _state(e)
        if now == state:
            break
        state = now
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
