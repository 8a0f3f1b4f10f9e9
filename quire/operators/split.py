"""Splitting a packed corpus into chunks.

Input is the ordered narrow rows of :func:`quire.operators.pack.pack`
(``corpus_id, path, size, len, tokens, priority, pos``).  Output is
``chunk_files(corpus_id, chunk, pos, q, path, tokens, size, is_overlap)``;
stats and listings are aggregates over it, so no chunk is ever held as one
value unless a caller asks for a rendered document.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.models import model_context
from ..functions.paths import top_dir, type_of
from ..functions.text import js_round
from .joins import null_safe_join
from .ordered import ordered_scan


def default_chunk_tokens(model: str | None, max_tokens: int | None = None) -> int:
    if max_tokens:
        return int(max_tokens)
    ctx = model_context(model or K.DEFAULT_MODEL)
    return int(np.floor(ctx * 0.85)) if ctx is not None else K.UNKNOWN_MODEL_CHUNK_TOKENS


def chunks_by_tokens(files: DataFrame, limit: int) -> DataFrame:
    """next-fit chunk ids, split across tasks so a hot corpus is not one
    task (see :mod:`quire.operators.nextfit`)."""
    from .nextfit import chunks_by_tokens_sliced
    return chunks_by_tokens_sliced(files, limit)


def chunks_by_files(files: DataFrame, per_chunk: int | None = None) -> DataFrame:
    """``ceil(pos / n)``."""
    n = int(per_chunk or K.DEFAULT_FILES_PER_CHUNK)
    return files.withColumn("chunk", (F.floor((F.col("pos") - 1) / n) + 1).cast("long"))


def chunks_by_key(files: DataFrame, key_col) -> DataFrame:
    """One chunk per key value, chunks in order of first appearance.  The
    key table is a partial aggregate (one row per corpus and key)."""
    df = files.withColumn("_key", key_col)
    first = df.groupBy("corpus_id", "_key").agg(F.min("pos").alias("_first"))
    first = first.withColumn("chunk", F.row_number().over(
        Window.partitionBy("corpus_id").orderBy("_first")).cast("long"))
    return null_safe_join(df, first.select("corpus_id", "_key", "chunk"), ["corpus_id", "_key"]).drop("_key")


def assign_chunks(files: DataFrame, strategy: str = "by_tokens", model: str | None = None,
                  max_tokens_per_chunk: int | None = None, max_files_per_chunk: int | None = None) -> DataFrame:
    if strategy == "by_tokens":
        return chunks_by_tokens(files, default_chunk_tokens(model, max_tokens_per_chunk))
    if strategy == "by_files":
        return chunks_by_files(files, max_files_per_chunk)
    if strategy == "by_directory":
        return chunks_by_key(files, top_dir("path"))
    if strategy == "by_type":
        return chunks_by_key(files, type_of("path"))
    raise ValueError(f"Unknown strategy: {strategy}")


def with_overlap(chunked: DataFrame, overlap_files: int | None = K.DEFAULT_OVERLAP_FILES,
                 contiguous: bool = False) -> DataFrame:
    """chunk i >= 2 is prefixed with the last ``k`` files of the already
    extended chunk i-1.  In the concatenation order ``q`` (chunk, then pos)
    that is exactly ``q`` in ``[start_i - k, start_i - 1]``; ``k = 0`` means
    every earlier file.  Overlap rows are generated with ``sequence`` and
    equi-joined on ``(corpus_id, q)`` (no range join)."""
    k = K.DEFAULT_OVERLAP_FILES if overlap_files is None else int(overlap_files)
    if contiguous:
        base = chunked.withColumn("q", F.col("pos"))
    else:
        base = ordered_scan(chunked, "corpus_id", [F.col("chunk"), F.col("pos")], pos_col="q")
    base = base.withColumn("is_overlap", F.lit(False))
    starts = base.groupBy("corpus_id", "chunk").agg(F.min("q").alias("_start")).where(F.col("chunk") >= 2)
    lo = F.lit(1) if k == 0 else F.greatest(F.col("_start") - k, F.lit(1))
    want = starts.select("corpus_id", "chunk", F.explode(F.sequence(lo.cast("long"), F.col("_start") - 1)).alias("q"))
    src = base.drop("chunk", "is_overlap")
    extra = null_safe_join(want, src, ["corpus_id", "q"]).withColumn("is_overlap", F.lit(True))
    return base.unionByName(extra)


def chunk_stats(chunk_files: DataFrame) -> DataFrame:
    """Files (overlap counted again), tokens, size (bytes, else chars)."""
    sz = F.when(F.coalesce(F.col("size"), F.lit(0)) != 0, F.col("size")).otherwise(F.col("len"))
    return chunk_files.groupBy("corpus_id", "chunk").agg(
        F.count(F.lit(1)).cast("long").alias("files"),
        F.sum("tokens").cast("long").alias("tokens"),
        F.sum(sz).cast("long").alias("size"))


def all_overlap_stats(chunked: DataFrame) -> DataFrame:
    """E4 for an overlap of whole chunks (``overlap_files = 0``: every chunk
    repeats all files before it): the chunks' own sums added up, so no file is
    repeated in a row."""
    own = chunk_stats(chunked.where(~F.col("is_overlap")) if "is_overlap" in chunked.columns else chunked)
    summed = ordered_scan(own, "corpus_id", [F.col("chunk")], sums=["files", "tokens", "size"], pos_col="_at")
    return summed.select("corpus_id", "chunk", *[F.col(f"cum_{c}").alias(c) for c in ("files", "tokens", "size")])


def chunk_listing(chunk_files: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` paths of each chunk in chunk order, plus how many
    more there are.  Only ``n`` rows per chunk are collected."""
    order = "q" if "q" in chunk_files.columns else "pos"
    w = Window.partitionBy("corpus_id", "chunk").orderBy(order, F.col("is_overlap").desc())
    head = chunk_files.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    listing = head.groupBy("corpus_id", "chunk").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "path"))), lambda x: x["path"]),
                     "\n").alias("first_paths"))
    counts = chunk_files.groupBy("corpus_id", "chunk").agg(F.count(F.lit(1)).alias("_n"))
    return null_safe_join(listing, counts, ["corpus_id", "chunk"]).select(
        "corpus_id", "chunk", "first_paths", F.greatest(F.col("_n") - n, F.lit(0)).cast("long").alias("more"))


def split_stats(stats: DataFrame, packed_summary: DataFrame) -> DataFrame:
    """E5: total files (unique), total tokens (overlap included), rounded
    average, max and min per chunk.  Empty input gives NULLs."""
    agg = stats.groupBy("corpus_id").agg(
        F.count(F.lit(1)).cast("long").alias("total_chunks"),
        F.sum("tokens").cast("long").alias("total_tokens"),
        F.max("tokens").cast("long").alias("max_tokens_in_chunk"),
        F.min("tokens").cast("long").alias("min_tokens_in_chunk"))
    agg = agg.withColumn("avg_tokens_per_chunk", js_round(F.col("total_tokens") / F.col("total_chunks")))
    return (null_safe_join(packed_summary.select("corpus_id", "total_files"), agg, ["corpus_id"], "left")
            .withColumn("total_chunks", F.coalesce("total_chunks", F.lit(0)).cast("long")))


def split_context(files: DataFrame, strategy: str = "by_tokens", model: str | None = None,
                  max_tokens_per_chunk: int | None = None, max_files_per_chunk: int | None = None,
                  overlap: bool = False, overlap_files: int = K.DEFAULT_OVERLAP_FILES) -> DataFrame:
    """assign chunks, then add overlap rows when asked."""
    chunked = assign_chunks(files, strategy, model, max_tokens_per_chunk, max_files_per_chunk)
    if overlap:
        return with_overlap(chunked, overlap_files, contiguous=strategy in ("by_tokens", "by_files"))
    return chunked.withColumn("q", F.col("pos")).withColumn("is_overlap", F.lit(False)) \
        if strategy in ("by_tokens", "by_files") else \
        ordered_scan(chunked, "corpus_id", [F.col("chunk"), F.col("pos")], pos_col="q").withColumn(
            "is_overlap", F.lit(False))


def suggest_split(summary: DataFrame, model: str = K.DEFAULT_MODEL) -> DataFrame:
    """I2 from per-file token totals."""
    ctx = model_context(model)
    t = F.col("tokens")
    if ctx is None:
        return summary.select(
            "corpus_id", F.lit(model).alias("model"), (t > K.UNKNOWN_MODEL_CHUNK_TOKENS).alias("needs_split"),
            F.lit(None).cast("long").alias("tokens"), F.lit(None).cast("long").alias("context_limit"),
            F.ceil(t / K.UNKNOWN_MODEL_CHUNK_TOKENS).cast("long").alias("suggested_chunks"),
            F.lit(None).cast("long").alias("tokens_per_chunk"), F.lit(None).cast("double").alias("context_usage"),
            F.lit(K.SPLIT_UNKNOWN).alias("recommendation"), F.lit(None).cast("array<string>").alias("strategies"))
    safe = F.lit(float(ctx)) * F.lit(0.85)
    needs = t > safe
    chunks = F.ceil(t / safe).cast("long")
    return summary.select(
        "corpus_id", F.lit(model).alias("model"), needs.alias("needs_split"), t.cast("long").alias("tokens"),
        F.when(needs, F.lit(ctx)).cast("long").alias("context_limit"),
        F.when(needs, chunks).alias("suggested_chunks"),
        F.when(needs, F.ceil(t / chunks)).cast("long").alias("tokens_per_chunk"),
        F.when(~needs, t / F.lit(ctx)).alias("context_usage"),
        F.when(needs, F.concat(F.lit("Split into "), chunks.cast("string"), F.lit(" chunks of ~"),
                               F.format_number(F.ceil(t / chunks).cast("long"), 0), F.lit(" tokens each")))
        .otherwise(F.lit(K.SPLIT_FITS)).alias("recommendation"),
        F.when(needs, F.array(*[F.lit(x) for x in K.SPLIT_STRATEGIES])).alias("strategies"))
