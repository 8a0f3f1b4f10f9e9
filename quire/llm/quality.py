"""Quality classifier: random Fourier features over document statistics, ridge
scores from partition-summed normal equations, isotonic calibration.

Statistics are read off a whole text's bytes and word hashes (character
classes, word lengths, repeated words and pairs, lines).  The features
``cos(W z + b)`` of the standardized statistics ``z`` approximate a Gaussian
kernel (``W`` and ``b`` drawn from a fixed seed).  Every task adds up
``phi' phi`` and ``phi' y`` of its labelled rows; sums are added in a fixed
number of groups, so the driver gets ``GROUPS`` matrices of fixed size and
solves one ridge system.  Raw scores of the labelled rows are counted in
``BINS`` cells, and pool-adjacent-violators over those cells (weighted by
count) gives the calibration curve.  All labelled rows outside the held-out
fold are used; nothing is sampled.

Edge cases: null and empty texts have all statistics 0 and get a score; null
labels are ignored; several labels of one id count as their mean; a label of
an id that has no document is ignored, and repeated documents each take the
label; without labels every score is 0.5, and where all labels agree it is
their value; an empty table gives an empty result; input columns with the
names of result columns are replaced.
"""
from __future__ import annotations

from typing import Iterator, NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, extended, prepare, utf8_buffers, without
from .words import SPACED, blocks, rolling

FEATURES = 384       # random Fourier features
WIDTH = 1.0          # kernel width, in units of sqrt(number of statistics)
RIDGE = 1.0
BINS = 2048
GROUPS = 16
SEED = 11
ROWS = 1024          # rows whose features are held at a time
THRESHOLD = 0.3


def _classes() -> np.ndarray:
    """256 x classes: upper, lower, digit, blank, line end, sentence mark, comma, quote, other sign, beyond ASCII (lead byte)."""
    sets = [range(65, 91), range(97, 123), range(48, 58), b" \t", b"\n\r", b".!?", b",;:", b"'\"()-"]
    out = np.zeros((256, len(sets) + 2))
    for j, s in enumerate(sets):
        out[list(s), j] = 1
    signs = [b for b in range(33, 127) if not out[b].any()]
    out[signs, -2] = 1
    out[0xC0:, -1] = 1
    return out


_CLASSES = _classes()
_SIGN = (_CLASSES[:, -2] > 0) | (_CLASSES[:, 5] > 0)
N_STATS = _CLASSES.shape[1] + 12


def _by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def _different(h: np.ndarray, text: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """By text: number of different hashes, and occurrences of the commonest."""
    key = np.sort((text.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    own = (key[head] >> np.uint64(40)).astype(np.int64)
    run = np.diff(np.append(head, len(key)))
    most = np.zeros(m)
    np.maximum.at(most, own, run)
    return np.bincount(own, minlength=m), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows x ``N_STATS`` statistics of the texts ``data[offsets[i]:offsets[i + 1]]``."""
    out = np.zeros((len(offsets) - 1, N_STATS), dtype=np.float32)
    for lo, hi, w in blocks(data, offsets, SPACED):
        m = hi - lo
        raw = data[offsets[lo]:offsets[hi]]
        size = np.diff(offsets[lo:hi + 1])
        text = np.repeat(np.arange(m), size)
        hist = np.bincount(text * 256 + raw, minlength=m * 256).reshape(m, 256)
        chars = np.maximum(size, 1)[:, None]
        share = hist @ _CLASSES / chars
        count = np.diff(w.first)
        n = np.maximum(count, 1)
        owner = np.repeat(np.arange(m), count)
        length = (w.end - w.start).astype(float)
        mean = _by_text(length, w.first) / n
        spread = np.sqrt(np.maximum(_by_text(length * length, w.first) / n - mean * mean, 0))
        same = np.zeros(len(w.hash))
        if len(w.hash) > 1:
            same[1:] = (w.hash[1:] == w.hash[:-1]) & (owner[1:] == owner[:-1])
        words, most = _different(w.hash, owner, m)
        pair = rolling(w.hash, 2)
        inside = owner[1:] == owner[:-1]
        pairs, _ = _different(pair[inside], owner[1:][inside], m)
        ends = raw[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
        alone = (length == 1) & _SIGN[ends] if len(ends) else length
        lines = hist[:, 10]
        out[lo:hi] = np.column_stack([
            np.sqrt(share), np.log1p(count) / 4, mean / 8, spread / 4, words / n, most / n, _by_text(same, w.first) / n,
            pairs / np.maximum(count - 1, 1), _by_text(_SIGN[ends].astype(float), w.first) / n,
            _by_text(alone.astype(float), w.first) / n, _by_text((length <= 3).astype(float), w.first) / n,
            _by_text((length >= 14).astype(float), w.first) / n, np.log1p(count / (lines + 1)) / 4])
        out[lo:hi][size == 0] = 0
    return out


class Model(NamedTuple):
    center: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    weights: np.ndarray
    curve_x: np.ndarray
    curve_y: np.ndarray

    def phi(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.center) / self.scale, -6, 6)
        return np.column_stack([np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b)), z / 10, np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float).reshape(-1, N_STATS)
        return np.concatenate([self.phi(x[i:i + ROWS]) @ self.weights for i in range(0, max(len(x), 1), ROWS)])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.curve_x, self.curve_y), 0, 1)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, stats`` for every row."""
    prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("doc_id", src.schema["doc_id"].dataType),
                           T.StructField("stats", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for b in batches:
            x = statistics(*utf8_buffers(b.column(1)))
            places = pa.array(np.arange(0, x.size + 1, N_STATS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(places, pa.array(x.reshape(-1)))],
                                             names=["doc_id", "stats"])

    return src.mapInArrow(run, schema)


def _matrix(col) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, N_STATS)


def _summed(rows: DataFrame, size: int, terms) -> np.ndarray:
    """Sum over all rows of ``terms(stats, y)``, a vector of ``size``: by task,
    then in ``GROUPS`` groups, then here."""
    def part(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext
        total = np.zeros(size)
        for b in batches:
            x, y = _matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False)
            for i in range(0, len(y), ROWS):
                total += terms(x[i:i + ROWS], y[i:i + ROWS])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % GROUPS], pa.int32()),
                                          pa.array([total.tobytes()], pa.binary())], names=["g", "s"])

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa
        total = None
        for b in batches:
            for raw in b.column(1).to_pylist():
                total = np.frombuffer(raw) + (0 if total is None else total)
        if total is not None:              # tasks without a group send nothing
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["g", "s"])

    kind = "g int, s binary"
    groups = rows.select("stats", "y").mapInArrow(part, kind).repartition(GROUPS, "g").mapInArrow(add, kind)
    return sum((np.frombuffer(r.s) for r in groups.collect()), np.zeros(size))


def isotonic(weight: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """The non-decreasing values nearest to ``mean`` in weighted squares."""
    stack: list[list[float]] = []
    for w, y in zip(weight.tolist(), mean.tolist()):
        stack.append([w, y, 1])
        while len(stack) > 1 and stack[-2][1] >= stack[-1][1]:
            b, a = stack.pop(), stack.pop()
            stack.append([a[0] + b[0], (a[0] * a[1] + b[0] * b[1]) / (a[0] + b[0]), a[2] + b[2]])
    return np.concatenate([np.full(int(k), y) for _, y, k in stack]) if stack else np.zeros(0)


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", features: int = FEATURES,
        width: float = WIDTH, ridge: float = RIDGE, seed: int = SEED) -> Model:
    """Fit on rows ``doc_id, stats`` that have a label."""
    marks = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("doc_id")).agg(F.avg(F.col(label_col).cast("double")).alias("y")))
    rows = cut(stats.join(marks, "doc_id").select("stats", "y"))
    first = _summed(rows, 2 * N_STATS + 2, lambda x, y: np.concatenate([x.sum(0), (x * x).sum(0), [len(y), y.sum()]]))
    n, prior = first[-2], (first[-1] / first[-2] if first[-2] else 0.5)
    center = first[:N_STATS] / max(n, 1)
    scale = np.sqrt(np.maximum(first[N_STATS:-2] / max(n, 1) - center ** 2, 0))
    scale[scale < 1e-6] = 1.0
    rnd = np.random.default_rng(seed)
    w = rnd.normal(size=(N_STATS, features)) / (width * np.sqrt(N_STATS))
    b = rnd.uniform(0, 2 * np.pi, features)
    k = features + N_STATS + 1
    model = Model(center, scale, w, b, np.zeros(k), np.zeros(1), np.full(1, prior))
    if n == 0 or prior in (0.0, 1.0):
        return model

    def normal(x, y):
        p = model.phi(x)
        return np.concatenate([(p.T @ p).reshape(-1), p.T @ (y - prior)])

    total = _summed(rows, k * k + k, normal)
    a, c = total[:k * k].reshape(k, k), total[k * k:]
    model = model._replace(weights=np.linalg.solve(a + ridge * np.eye(k), c))

    def cells(x, y):
        at = np.clip(((model.raw(x) + 1.5) / 3 * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS)])

    counted = _summed(rows, 2 * BINS, cells)
    weight, ones = counted[:BINS], counted[BINS:]
    at = np.flatnonzero(weight)
    middle = (at + 0.5) / BINS * 3 - 1.5
    return model._replace(curve_x=middle, curve_y=isotonic(weight[at], ones[at] / weight[at]))


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold``)."""
    return _scored(docs, text_col, model, threshold, lambda col: statistics(*utf8_buffers(col)))


def score_statistics(stats: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The same for rows that :func:`document_statistics` gave."""
    return _scored(stats, "stats", model, threshold, _matrix)


def _scored(df: DataFrame, col: str, model: Model, threshold: float, read) -> DataFrame:
    prepare(df.sparkSession)
    base = without(df, ["score", "predicted"])
    at = [c.lower() for c in base.columns].index(col.lower())
    schema = extended(base, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for b in batches:
            s = shared.value.score(read(b.column(at))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))],
                                             names=[*b.schema.names, "score", "predicted"])

    return base.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
