"""Next-fit chunking split across tasks (F4 for corpora of any size).

Next-fit is sequential, but a slice of a corpus only needs its *entry state*
(how full the chunk left open by earlier slices is) to finish independently.

1. Rows are range-partitioned on ``(corpus_id, pos)`` into slices and written
   once (with the corpus-wide running token sum ``P``).
2. Pass 1, per slice and corpus segment: for every possible entry state, where
   the first chunk boundary falls and what the segment then hands on (chunk
   starts counted, exit state).  Entry states that lead to the same result form
   runs; the runs are keyed by the free room ``v = limit - open tokens``.
3. Only corpora that cross a slice boundary need chaining, and each slice holds
   at most two segments of such.  Their summaries are streamed in order, one at
   a time, by a task per corpus, which emits each segment's entry state and the
   number of chunks started before it: a few scalars per segment, at most
   ``2 * slices`` rows, which is what bounds the broadcast of that table.
4. Pass 2, per slice: chunk ids from the entry state, vectorised.

Slices hold about ``SLICE_ROWS`` narrow rows however many rows there are.
Boundaries inside a segment come from ``searchsorted`` on prefix sums; where
each start leads is found by pointer doubling, without a loop over rows.
"""
from __future__ import annotations

from typing import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import null_safe_join
from .ordered import SLICE_ROWS

_BLK = "_nf_blk"
NEG = -1  # free room of a closed chunk: the next file always starts one


def _segments(k: np.ndarray):
    """Start/end (exclusive) indices of runs of equal keys in a sorted batch."""
    if len(k) == 0:
        return []
    cut = np.flatnonzero(k[1:] != k[:-1]) + 1
    starts = np.concatenate([[0], cut])
    ends = np.concatenate([cut, [len(k)]])
    return list(zip(starts, ends))


def _next(t: np.ndarray, Q: np.ndarray, limit: int) -> np.ndarray:
    """f(i): start of the chunk after one starting at i (segment-local index;
    len(t) means "beyond the segment")."""
    Qprev = Q - t
    f = np.searchsorted(Q, Qprev + limit, side="right")
    over = t > limit
    f[over] = np.arange(len(t))[over] + 1
    return np.minimum(f, len(t))


def _first_boundary(v: int, t: np.ndarray, Q: np.ndarray, limit: int) -> int:
    """Index of the first chunk start for free room ``v`` (len(t): none)."""
    if v < 0:
        return 0
    over = np.flatnonzero(t > limit)
    j = int(np.searchsorted(Q, v, side="right"))
    if len(over):
        j = min(j, int(over[0]))
    return min(j, len(t))


def _orbits(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each start: the last start that follows from it inside the segment,
    and how many starts there are, itself included (pointer doubling)."""
    m = len(f)
    last, cnt, jump = np.arange(m), np.ones(m, dtype=np.int64), f.copy()
    while True:
        on = np.flatnonzero(jump < m)
        if not len(on):
            return last, cnt
        to = jump[on]
        last[on], cnt[on], jump[on] = last[to], cnt[on] + cnt[to], jump[to]


def _starts(f: np.ndarray, j: int) -> np.ndarray:
    """The starts that follow from ``j``, itself included (path doubling)."""
    m = len(f)
    step = np.append(f, m)
    found = np.array([j] if j < m else [], dtype=np.int64)
    while len(found):
        ahead = step[found]
        ahead = ahead[ahead < m]
        if not len(ahead) or ahead[-1] == found[-1]:
            break
        found = np.concatenate([found, ahead])
        step = step[step]
    return found


def _collect_frames(batches: Iterable[pd.DataFrame]) -> pd.DataFrame:
    frames = [b for b in batches if len(b)]
    return pd.concat(frames, ignore_index=True) if frames else None


def _summaries(limit: int, key: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # One slice: bounded by the slice size chosen for the range partition.
        pdf = _collect_frames(batches)
        if pdf is None:
            return
        k = pdf[key].to_numpy(dtype=object)
        out = []
        for s, e in _segments(k):
            t = pdf["tokens"].to_numpy(dtype=np.int64)[s:e]
            Q = np.cumsum(t)
            m = len(t)
            f = _next(t, Q, limit)
            last, cnt = _orbits(f)
            over = np.flatnonzero(t > limit)
            first_over = int(over[0]) if len(over) else m
            # candidates: first boundaries reachable from some entry state
            cand_end = min(int(np.searchsorted(Q, limit, side="right")), first_over, m - 1) + 1
            new = np.ones(cand_end, dtype=bool)
            new[1:] = (cnt[1:cand_end] != cnt[:cand_end - 1]) | (last[1:cand_end] != last[:cand_end - 1])
            at = np.flatnonzero(new)
            L = last[at]
            open_ = t[L] <= limit
            qlo, cnts, eopen = np.where(at == 0, NEG, Q[at - 1]), cnt[at], open_
            ecur = np.where(open_, Q[-1] - (Q[L] - t[L]), 0)
            passthrough = first_over == m            # no oversize: a roomy entry crosses the segment
            out.append((k[s], int(pdf[_BLK].iat[s]), int(pdf["pos"].iat[s]), int(Q[-1]), passthrough,
                        qlo, cnts, eopen, ecur))
        if out:
            yield pd.DataFrame(out, columns=[key, _BLK, "first_pos", "total", "passthrough",
                                             "qlo", "cnt", "exit_open", "exit_cur"])
    return run


SUMMARY_SCHEMA = ("corpus_id string, _nf_blk int, first_pos long, total long, passthrough boolean, "
                  "qlo array<long>, cnt array<long>, exit_open array<boolean>, exit_cur array<long>")


ENTRY_SCHEMA = "corpus_id string, _nf_blk int, is_open boolean, cur long, started long"


def _chain(limit: int):
    """Streams summaries ordered by (corpus, position) to entry states."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        corpus, is_open, cur, started, begun = None, False, 0, 0, False
        for b in batches:
            out = []
            for i in range(b.num_rows):
                c, blk, _, total, through = (b.column(j)[i].as_py() for j in range(5))
                if not begun or c != corpus:
                    corpus, is_open, cur, started, begun = c, False, 0, 0, True
                out.append((c, blk, is_open, cur, started))
                v = (limit - cur) if is_open else NEG
                if through and is_open and v >= total:
                    cur += total
                    continue
                qlo, cnt, exit_open, exit_cur = (b.column(j)[i].values.to_numpy(zero_copy_only=False) for j in range(5, 9))
                at = int(np.searchsorted(qlo, v, side="right")) - 1
                started, is_open, cur = started + int(cnt[at]), bool(exit_open[at]), int(exit_cur[at])
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, k) for x, k in zip(zip(*out), (pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()))],
                    names=["corpus_id", "_nf_blk", "is_open", "cur", "started"])
    return run


def _assign(limit: int, key: str, entries: dict, out_cols):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = _collect_frames(batches)
        if pdf is None:
            return
        k = pdf[key].to_numpy(dtype=object)
        chunk = np.zeros(len(pdf), dtype=np.int64)
        tt = pdf["tokens"].to_numpy(dtype=np.int64)
        blk = int(pdf[_BLK].iat[0])
        for s, e in _segments(k):
            t = tt[s:e]
            Q = np.cumsum(t)
            is_open, cur, started = entries.get((k[s], blk), (False, 0, 0))
            v = (limit - cur) if is_open else NEG
            j = _first_boundary(v, t, Q, limit)
            f = _next(t, Q, limit)
            starts = np.zeros(len(t), dtype=np.int64)
            starts[_starts(f, j)] = 1
            chunk[s:e] = started + np.cumsum(starts)
        yield pdf.assign(chunk=chunk)[out_cols]
    return run


def chunks_by_tokens_sliced(files: DataFrame, limit: int, num_slices: int | None = None) -> DataFrame:
    """Next-fit chunk ids (``chunk``, 1-based per corpus) for rows with
    ``corpus_id, pos, tokens``; other columns are carried through."""
    from .pack import checkpoint
    spark = files.sparkSession
    n = num_slices or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-files.count() // SLICE_ROWS))
    sliced = checkpoint(files.repartitionByRange(n, "corpus_id", "pos")
                        .sortWithinPartitions("corpus_id", "pos")
                        .withColumn(_BLK, F.spark_partition_id()))
    summ = checkpoint(sliced.select("corpus_id", "pos", "tokens", _BLK).mapInPandas(_summaries(int(limit), "corpus_id"), SUMMARY_SCHEMA))
    spanning = summ.groupBy("corpus_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("corpus_id")
    chained = (null_safe_join(summ, spanning, ["corpus_id"], "left_semi").repartition("corpus_id").sortWithinPartitions("corpus_id", "first_pos")
               .mapInArrow(_chain(int(limit)), ENTRY_SCHEMA))
    entries = {(r.corpus_id, r._nf_blk): (r.is_open, r.cur, r.started) for r in chained.collect()}
    out_cols = files.columns + ["chunk"]
    schema = T.StructType(files.schema.fields + [T.StructField("chunk", T.LongType())])
    return sliced.sortWithinPartitions("corpus_id", "pos").mapInPandas(
        _assign(int(limit), "corpus_id", entries, out_cols), schema)
