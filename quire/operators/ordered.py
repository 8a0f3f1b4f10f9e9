"""Skew-safe per-key ranking and running sums.

A window ``partitionBy(key)`` puts a whole key in one task, and one corpus may
hold a third of all rows.  Instead the rows are range-partitioned on
``(key, order...)`` so a hot key is cut into contiguous slices across tasks:

1. ``repartitionByRange(n, key, *order)``; each slice is sorted and scanned
   locally (Arrow batches, vectorised cumulative sums) giving a local rank and
   local running sums.
2. The sliced scan is checkpointed (range bounds are sampled, so the
   exchange must not be evaluated twice).  Per ``(slice, key)`` block totals
   are a small partial aggregate of it.  Only a key
   that continues from an earlier slice needs an offset, and each slice
   starts with at most one such key, so the offset table has at most ``n - 1``
   rows: that bound is what makes it safe to broadcast.
3. Local values plus offsets are the global rank and running sums.

The explicit partition count keeps AQE from coalescing the range exchange.
The order must be total within a key.
"""
from __future__ import annotations

from typing import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLK = "_q_blk"


#: Narrow rows that a slice holds about.
SLICE_ROWS = 200_000


def _num_slices(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def slices_for(written: DataFrame) -> int:
    """Slices for the rows of a table that is cheap to count (a written one)."""
    return max(_num_slices(written), -(-written.count() // SLICE_ROWS))


def _key_changes(k) -> np.ndarray:
    """``k[i] != k[i-1]`` for i >= 1 on an Arrow array, NULL equal to NULL."""
    import pyarrow as pa
    import pyarrow.compute as pc
    a, b = k.slice(1), k.slice(0, len(k) - 1)
    ne = pc.fill_null(pc.not_equal(a, b), True)
    both_null = pc.and_(pc.is_null(a), pc.is_null(b))
    return pc.if_else(both_null, pa.scalar(False), ne).to_numpy(zero_copy_only=False)


def _local_scan(key: str, sums: Sequence[str], pos_col: str, cum_cols: Sequence[str], out_schema):
    """Per slice: local rank and running sums, restarting at each key.
    Arrow batches in and out; only the key and the summed columns are
    converted, other columns pass through untouched."""
    def run(batches):
        import pyarrow as pa
        arrow_schema = None
        last_key, carry_n, carry = object(), 0, np.zeros(len(sums), dtype=np.int64)
        for rb in batches:
            m = rb.num_rows
            if m == 0:
                continue
            if arrow_schema is None:
                from pyspark.sql.pandas.types import to_arrow_schema
                arrow_schema = to_arrow_schema(out_schema)
            k = rb.column(rb.schema.get_field_index(key))
            new = np.empty(m, dtype=bool)
            k0 = k[0].as_py()
            new[0] = not (k0 == last_key)
            if m > 1:
                new[1:] = _key_changes(k)
            seg = np.cumsum(new)
            idx = np.arange(m, dtype=np.int64)
            start = np.maximum.accumulate(np.where(new, idx, 0))
            rn = idx - start + 1
            cont = seg == 0
            rn[cont] += carry_n
            cols = list(rb.columns) + [pa.array(rn, type=pa.int64())]
            for j, c in enumerate(sums):
                v = rb.column(rb.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64)
                cs = np.cumsum(v)
                base = np.where(start > 0, cs[start - 1], 0)
                loc = cs - base
                loc[cont] += carry[j]
                carry[j] = loc[-1]
                cols.append(pa.array(loc, type=pa.int64()))
            carry_n = int(rn[-1])
            last_key = k[m - 1].as_py()
            yield pa.RecordBatch.from_arrays(cols, schema=arrow_schema)
    return run


def ordered_scan(df: DataFrame, key: str, order: Sequence[Column], sums: Sequence[str] = (),
                 pos_col: str = "pos", cum_prefix: str = "cum_",
                 num_slices: int | None = None) -> DataFrame:
    """Add ``pos`` (1-based rank of each row within ``key`` by ``order``) and an
    inclusive running sum ``cum_<c>`` for each column in ``sums`` (non-null
    integers)."""
    n = num_slices or _num_slices(df)
    cum_cols = [cum_prefix + c for c in sums]
    sliced = df.repartitionByRange(n, F.col(key), *order).withColumn(_BLK, F.spark_partition_id())
    out_schema = T.StructType(sliced.schema.fields + [T.StructField(pos_col, T.LongType())]
                              + [T.StructField(c, T.LongType()) for c in cum_cols])
    local = (sliced.sortWithinPartitions(F.col(key), *order)
             .mapInArrow(_local_scan(key, list(sums), pos_col, cum_cols, out_schema), out_schema))
    # Range bounds come from sampling, so two evaluations of the exchange may
    # slice differently: the local scan is written once and both the block
    # totals and the final rows read that one copy.
    local = _materialize(local)

    blocks = local.groupBy(_BLK, key).agg(
        F.count(F.lit(1)).alias("_q_bn"), *[F.sum(c).cast("long").alias(f"_q_bs_{c}") for c in sums])
    w = Window.partitionBy(key).orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (blocks
               .select(_BLK, F.col(key).alias("_q_key"), F.sum("_q_bn").over(w).alias("_q_on"),
                       *[F.sum(f"_q_bs_{c}").over(w).alias(f"_q_os_{c}") for c in sums])
               .where(F.col("_q_on").isNotNull()))
    joined = local.join(F.broadcast(offsets),
                        (local[_BLK] == offsets[_BLK]) & local[key].eqNullSafe(offsets["_q_key"]),
                        "left")
    cols = [local[c] for c in df.columns]
    cols.append((local[pos_col] + F.coalesce(offsets["_q_on"], F.lit(0))).alias(pos_col))
    for c, cc in zip(sums, cum_cols):
        cols.append((local[cc] + F.coalesce(offsets[f"_q_os_{c}"], F.lit(0))).cast("long").alias(cc))
    return joined.select(*cols)


def _materialize(df: DataFrame) -> DataFrame:
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
