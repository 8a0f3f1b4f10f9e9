"""Whitening of embeddings through a bidiagonal qd solver.

Entries become whole numbers, so sums, means and deviations are exact.  The
fit list is each distinct vector once.  Its centred rows are reduced by
blockwise QR: every task folds its rows into one triangle, and triangles are
folded in groups of ``FAN_IN`` by further tasks until one is left.  No product
of the rows with themselves is formed, so small singular values keep their
digits.  The last triangle, whose size depends on the dimension alone, is
solved on the driver:

* Householder reflections from both sides make it bidiagonal;
* dqds (differential quotient-difference steps with shifts) finds the singular
  values of the bidiagonal to high relative accuracy;
* twisted factorisations of its Gram matrix, kept in factored form, give each
  singular vector: a stationary and a progressive qd step meet where the
  twisted pivot is smallest.  Vectors of values that agree to four digits are made orthogonal.

A second pass projects rows and measures how far the covariance of the
whitened fit list is from the identity.

Edge cases: rows whose vector is null or has null or non-finite entries are
dropped, also those with an entry of 2**56 or more (its whole number would not
fit) and those whose length differs from the commonest one (ties: the longest);
vectors of length 0 are dropped.  Repeated vectors count once in the fit and
each of their rows is returned, as are null and repeated ids.  Directions
without variance (singular values under ``NOISE`` of the largest) are not
components, so an empty table, a single vector or equal ones give no row.  A
deviation that doesn't fit a long is null.  Other columns than the id and the
vector are ignored, also under clashing names.
"""
from __future__ import annotations

import math
from decimal import Decimal
from typing import Iterator, NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

COMPONENTS = 16
SCALE = 64
OFFSET = 1_000_000
FAN_IN = 16
ROWS = 4096              # rows folded into a triangle at a time
NOISE = 1e-10
_EPS = np.finfo(float).eps


# ---- the solver: dense matrices of the dimension's size ------------------

def _reflection(x: np.ndarray) -> tuple[np.ndarray, float]:
    """``(v, beta)``: ``I - beta v v'`` takes ``x`` to a multiple of the first unit vector."""
    v = x.astype(float).copy()
    size = np.linalg.norm(v)
    if size == 0 or not np.any(v[1:]):
        return v, 0.0
    v[0] += math.copysign(size, v[0])
    return v, 2.0 / float(v @ v)


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Diagonal, superdiagonal and right reflections of a square matrix."""
    a = np.array(r, float)
    d = len(a)
    right = []
    for j in range(d):
        v, beta = _reflection(a[j:, j])
        if beta:
            a[j:, j:] -= beta * np.outer(v, v @ a[j:, j:])
        if j < d - 2:
            v, beta = _reflection(a[j, j + 1:])
            if beta:
                a[j:, j + 1:] -= beta * np.outer(a[j:, j + 1:] @ v, v)
            right.append((v, beta))
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _step(q: list, e: list, shift: float) -> tuple[list, list, float, list]:
    """One dqds step; the last values are the last pivot and all pivots, which
    are positive unless the shift exceeds the smallest value."""
    d = q[0] - shift
    qs, es, pivots = [], [], [d]
    for i in range(len(e)):
        if not d > 0 and i < len(e):
            return qs, es, math.nan, pivots
        s = d + e[i]
        t = q[i + 1] / s
        qs.append(s)
        es.append(e[i] * t)
        d = d * t - shift
        pivots.append(d)
    qs.append(d)
    return qs, es, d, pivots


def squared_singular_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the bidiagonal matrix, descending."""
    if not len(a):
        return np.zeros(0)
    top = max(float(np.max(a * a)), float(np.max(b * b, initial=0.0)))
    if top == 0:
        return np.zeros(len(a))
    tiny = 1e-290
    out: list[float] = []
    blocks = [([max(float(x * x) / top, tiny) for x in a], [float(x * x) / top for x in b], 0.0)]
    while blocks:
        q, e, sigma = blocks.pop()
        safe = 0.0
        while True:
            n = len(q)
            small = [i for i in range(n - 1) if e[i] <= _EPS * _EPS * (sigma + min(q[i], q[i + 1]))]
            if small:                                  # parts that no longer touch
                cuts = [0, *[i + 1 for i in small], n]
                blocks += [(q[x:y], e[x:y - 1], sigma) for x, y in zip(cuts, cuts[1:])]
                break
            if n == 1:
                out.append(sigma + q[0])
                break
            if n == 2:
                total = q[0] + q[1] + e[0]
                large = (total + math.sqrt(max((q[0] - q[1] + e[0]) ** 2 + 4 * q[1] * e[0], 0.0))) / 2
                out += [sigma + large, sigma + q[0] * (q[1] / large)]
                break
            if q[0] * 1.5 < q[-1]:                     # the small end last
                q, e = q[::-1], e[::-1]
            # The smaller eigenvalue of the last two rows is no less than the smallest of all.
            x, y, z = q[-2] + e[-2], q[-1] + 0.0, e[-1]
            x = q[-2] + z
            tail = y * q[-2] / ((x + y + math.sqrt((x - y) ** 2 + 4 * y * z)) / 2)
            tries = [tail * (1 - 1e-2 * min(1.0, z / max(q[-2], tiny)) - 4 * _EPS), tail * 0.9, safe, 0.0]
            for k, shift in enumerate(tries):
                if shift <= safe and k < 2:
                    continue
                qs, es, last, pivots = _step(q, e, shift)
                if last >= 0:
                    break
                if last == last and shift + last > safe:     # only the last pivot failed: it tells the way back
                    back = shift + last * (1 + 1e-8) - 4 * _EPS * shift
                    again = _step(q, e, back)
                    if again[2] >= 0:
                        shift, (qs, es, last, pivots) = back, again
                        break
            sigma += shift
            q, e = [max(v, tiny) for v in qs], es
            # The smallest value is no less than the inverse of the trace of the inverse.
            safe = (1 - 1e-10) / sum(1 / max(p, tiny) for p in pivots) - shift if shift == 0.0 else 0.0
    return np.sort(np.array(out))[::-1] * top


def _twisted(d: np.ndarray, lld: np.ndarray, ld: np.ndarray, value: float, nth: int = 0) -> tuple[np.ndarray, float]:
    """Eigenvector of the tridiagonal ``L D L'`` near ``value`` and the
    correction of the value; ``nth`` takes the pivot that is ``nth`` smallest."""
    n = len(d)
    tiny = 1e-300
    s, up = np.zeros(n), np.zeros(n)
    p, down = np.zeros(n), np.zeros(n)
    s[0] = -value
    for i in range(n - 1):
        pivot = s[i] + d[i] or tiny
        up[i] = ld[i] / pivot
        s[i + 1] = lld[i] * (s[i] / pivot) - value
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):
        pivot = lld[i] + p[i + 1] or tiny
        down[i] = ld[i] / pivot
        p[i] = p[i + 1] * (d[i] / pivot) - value
    twist = s + p + value
    r = int(np.argsort(np.abs(twist), kind="stable")[min(nth, n - 1)])
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -up[i] * z[i + 1]
    for i in range(r + 1, n):
        z[i] = -down[i - 1] * z[i - 1]
    size = float(np.linalg.norm(z))
    return z / size, float(twist[r]) / (size * size)


def bidiagonal_vectors(a: np.ndarray, b: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All squared singular values (descending), and the ``count`` largest with
    the right singular vectors as columns."""
    n = len(a)
    scale = float(max(np.max(np.abs(a), initial=0.0), np.max(np.abs(b), initial=0.0))) or 1.0
    a, b = a / scale, b / scale
    parts = [0, *[i + 1 for i in range(n - 1) if abs(b[i]) <= _EPS * (abs(a[i]) + abs(a[i + 1]))], n]
    found = []
    for lo, hi in zip(parts, parts[1:]):
        x, y = a[lo:hi], b[lo:hi - 1]
        found += [(float(v), lo, hi, k) for k, v in enumerate(squared_singular_values(x, y))]
    found.sort(key=lambda f: -f[0])
    values, vectors = [], []
    for value, lo, hi, _ in found[:count]:
        x = np.where(np.abs(a[lo:hi]) < _EPS * _EPS, _EPS * _EPS, a[lo:hi])
        y = b[lo:hi - 1]
        d, ld, lld = x * x, x[:-1] * y, y * y
        near = [v for w, v, block in vectors if block == lo and abs(w - value) <= 1e-4 * max(w, value)]
        best, size = np.zeros(n), -1.0
        for nth in range(hi - lo):
            z, at = np.zeros(0), value
            for _ in range(3):
                z, change = _twisted(d, lld, ld, at, nth)
                if near or not abs(change) > 2 * _EPS * at:
                    break
                at += change
            full = np.zeros(n)
            full[lo:hi] = z
            for _ in range(2):
                for v in near:
                    full -= v * (v @ full)
            norm = float(np.linalg.norm(full))
            if norm > size:
                best, size = full / (norm or 1.0), norm
            if size > (0.1 if near else 0.0):
                break
        values.append(value)
        vectors.append((value, best, lo))
    columns = np.array([v for _, v, _ in vectors]).T if vectors else np.zeros((n, 0))
    return np.array([f[0] for f in found]) * scale * scale, np.array(values) * scale * scale, columns


def right_singular(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All squared singular values of a square matrix and the ``count`` largest
    with their right singular vectors as columns."""
    a, b, right = bidiagonalise(r)
    every, values, z = bidiagonal_vectors(a, b, count)
    for j in range(len(right) - 1, -1, -1):
        v, beta = right[j]
        if beta:
            z[j + 1:] -= beta * np.outer(v, v @ z[j + 1:])
    return every, values, z / np.maximum(np.linalg.norm(z, axis=0), 1e-300)


# ---- rows ----------------------------------------------------------------

class Model(NamedTuple):
    n: int
    sums: list[int]
    directions: np.ndarray        # dimension x components, divided by the root of the eigenvalue
    explained: list[float]


def whole_numbers(vector: Column) -> Column:
    """The vector's entries as whole numbers; null for vectors that are dropped."""
    fits = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float(1 << 56)))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & fits,
                  F.transform(vector, lambda c: F.floor(c.cast("double") * float(SCALE)) + F.lit(OFFSET).cast("long")))


def _matrix(column, d: int) -> np.ndarray:
    import pyarrow as pa
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S``, exact: 64-bit numbers where all fit, else Python's."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)), 1)
    if n * most + max(map(abs, sums)) < 1 << 62:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _squares(d: np.ndarray) -> list[int | None]:
    if d.dtype != object and len(d) and float(np.abs(d).max()) ** 2 * d.shape[1] < 1 << 62:
        return (d * d).sum(axis=1).tolist()
    exact = (d.astype(object) ** 2).sum(axis=1).tolist() if len(d) else []
    return [v if v < 1 << 63 else None for v in exact]


def _sums(d: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        total, n = [0] * d, 0
        for b in batches:
            x = _matrix(b.column("x"), d)
            n += len(x)
            wide = len(x) * max(int(x.max(initial=0)), -int(x.min(initial=0)), 1) >= 1 << 62
            total = [t + int(v) for t, v in zip(total, (x.astype(object) if wide else x).sum(axis=0))] if len(x) else total
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0)),
                                              pa.array([n] * d, pa.int64())], names=["dim", "s", "n"])

    return run


def _triangles(n: int, sums: list[int]):
    """One triangle of the centred rows of a task."""
    d = len(sums)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext
        r = np.zeros((0, d))
        for b in batches:
            x = _matrix(b.column("x"), d)
            for lo in range(0, len(x), ROWS):
                r = np.linalg.qr(np.vstack([r, _deviations(x[lo:lo + ROWS], n, sums).astype(float) / n]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["part", "r"])

    return run


def _fold(d: int):
    def run(group):
        import pyarrow as pa
        r = np.zeros((0, d))
        for row in sorted(group.to_pylist(), key=lambda row: row["part"]):
            r = np.linalg.qr(np.vstack([r, np.frombuffer(row["r"]).reshape(-1, d)]), mode="r")
        return pa.table({"part": pa.array([group.column("part")[0].as_py() // FAN_IN], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    return run


def fit(vectors: DataFrame, d: int, components: int = COMPONENTS) -> tuple[Model, DataFrame] | None:
    """The model of ``vectors(x)`` of ``d`` whole numbers each, and the fit
    list; None if no direction has variance."""
    rows = cut(vectors.select("x").distinct())
    totals = rows.mapInArrow(_sums(d), "dim int, s decimal(38,0), n long").groupBy("dim").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("dim").collect()
    if not totals:
        return None
    n, sums = int(totals[0].n), [int(t.s) for t in totals]
    parts = cut(rows.mapInArrow(_triangles(n, sums), "part long, r binary"))
    while parts.limit(2).count() > 1:
        # Numbered anew in each round, so that groups have FAN_IN rows but for numbers without a row.
        parts = cut(parts.groupBy((F.col("part") / FAN_IN).cast("long")).applyInArrow(_fold(d), "part long, r binary"))
    last = parts.first()
    r = np.frombuffer(last.r).reshape(-1, d)
    square = np.zeros((d, d))
    square[:len(r)] = r
    every, values, z = right_singular(square, min(components, d))
    keep = values > NOISE * NOISE * values[:1]
    if not keep.any():
        return None
    values, z = values[keep], z[:, keep]
    return Model(n, sums, z / np.sqrt(values / n), (values / every.sum()).tolist()), rows


def _whitened(x: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    dev = _deviations(x, model.n, model.sums)
    return dev, (dev.astype(float) / model.n) @ model.directions


def identity_error(rows: DataFrame, model: Model) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    d, m = model.directions.shape

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        both, one = np.zeros((m, m)), np.zeros(m)
        for b in batches:
            _, w = _whitened(_matrix(b.column("x"), d), model)
            both += w.T @ w
            one += w.sum(axis=0)
        flat = np.concatenate([both.ravel(), one])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], names=["at", "v"])

    sums = rows.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    flat = np.array([s.v for s in sums]) / model.n
    mean = flat[m * m:]
    return float(np.abs(flat[:m * m].reshape(m, m) - np.outer(mean, mean) - np.eye(m)).max())


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``
    of every row that is not dropped and every component."""
    kind = table.schema[id_col].dataType
    out = T.StructType([T.StructField("vec_id", kind), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
                        T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()),
                        T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])
    spark = table.sparkSession
    rows = table.select(F.col(id_col).alias("vec_id"), whole_numbers(F.col(vector_col)).alias("x")).where("x is not null")
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.size("x") == common.d) if common else rows
    fitted = fit(rows, common.d, components) if common else None
    if fitted is None:
        return spark.createDataFrame([], out)
    model, distinct = fitted
    error, d, m = identity_error(distinct, model), common.d, len(model.explained)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                dev, w = _whitened(_matrix(part.column("x"), d), model)
                k = len(w)
                row = pa.array(np.repeat(np.arange(k), m))
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id").take(row), pa.array(np.tile(np.arange(1, m + 1), k), pa.int32()), pa.array(np.full(k * m, model.n), pa.int64()),
                     pa.array(_squares(dev), pa.int64()).take(row), pa.array(w.ravel()), pa.array(np.tile(model.explained, k)),
                     pa.array(np.full(k * m, error))], names=out.names)

    return rows.mapInArrow(run, out)
