"""Fitting a corpus to a token budget.

Phase 1 cleans every file with column expressions.  Phase 2 (proportional
truncation of low-importance files) is a true recurrence, the running total
feeds the next file's allowance, so it is a streamed per-corpus fold over
narrow rows (lengths and line lengths, never content).  Phase 3 (drop the
least important files until the budget holds) has a closed form: one ordered
running sum.  Content is rebuilt from the fold's decisions with expressions.
"""
from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.clean import minify, remove_comments, remove_empty_lines, truncate_lines, truncation_keep
from ..functions.models import model_context
from ..functions.paths import ext_last
from ..functions.text import col, js_round
from ..functions.tokens import joined_tokens, len_chars
from .joins import null_safe_join
from .ordered import ordered_scan, slices_for

MARKER_LEN = len(K.TRUNCATION_MARKER)


def clean_steps(df: DataFrame, src: str, prefix: str, *, remove_comments_: bool, remove_empty_lines_: bool,
                minify_: bool, utf16: bool = False, only_where=None) -> DataFrame:
    """One cleaning pass as separate columns ``<prefix>_content`` and
    ``<prefix>_strategies``; each step is its own column so no regex runs twice.
    With ``only_where`` the pass runs only on rows meeting it (NULL elsewhere)."""
    cur, cur_len = src, f"{prefix}_l0"
    df = df.withColumn(cur_len, len_chars(src, utf16))
    flags = []
    if only_where is not None:
        orig = {"c": remove_comments, "e": remove_empty_lines, "m": minify}

        def gate(fn):
            return lambda c: F.when(only_where, fn(c))
        steps_fns = (gate(lambda c: orig["c"](c, ext_last("path"))), gate(orig["e"]), gate(orig["m"]))
    else:
        steps_fns = (lambda c: remove_comments(c, ext_last("path")), remove_empty_lines, minify)
    steps = [(remove_comments_, K.STRATEGY_REMOVE_COMMENTS, steps_fns[0]),
             (remove_empty_lines_, K.STRATEGY_REMOVE_EMPTY_LINES, steps_fns[1]),
             (minify_, K.STRATEGY_MINIFY, steps_fns[2])]
    for i, (on, name, fn) in enumerate(steps):
        if not on:
            continue
        nc, nl = f"{prefix}_c{i}", f"{prefix}_l{i + 1}"
        df = df.withColumn(nc, fn(F.col(cur))).withColumn(nl, len_chars(nc, utf16))
        flags.append(F.when(F.col(nl) < F.col(cur_len), F.lit(name)))
        cur, cur_len = nc, nl
    strategies = F.filter(F.array(*flags), lambda x: x.isNotNull()) if flags else F.array().cast("array<string>")
    df = df.withColumn(f"{prefix}_content", F.col(cur)).withColumn(f"{prefix}_len", F.col(cur_len)) \
           .withColumn(f"{prefix}_strategies", strategies)
    keep = {f"{prefix}_content", f"{prefix}_len", f"{prefix}_strategies"}
    drop = [c for c in df.columns if (c.startswith(prefix + "_c") or c.startswith(prefix + "_l")) and c not in keep]
    return df.drop(*drop)


def optimize_files(files: DataFrame, *, remove_comments_: bool = True, remove_empty_lines_: bool = True,
                   minify_: bool = False, max_tokens_per_file: int | None = None,
                   utf16: bool = False) -> DataFrame:
    """C14 per file: ``content`` cleaned, ``original_size`` (bytes, else
    chars), ``optimized_size`` (chars), ``strategies``."""
    df = clean_steps(files, "content", "_o", remove_comments_=remove_comments_,
                     remove_empty_lines_=remove_empty_lines_, minify_=minify_, utf16=utf16)
    strategies = F.col("_o_strategies")
    content = F.col("_o_content")
    if max_tokens_per_file:
        t = truncation_keep("_o_content", int(max_tokens_per_file), utf16)
        df = df.withColumn("_t", t)
        content = F.when(F.col("_t.truncate"), truncate_lines("_o_content", F.col("_t.keep_lines"))).otherwise(content)
        strategies = F.when(F.col("_t.truncate"), F.array_append(strategies, F.lit(K.STRATEGY_TRUNCATE_LARGE))) \
            .otherwise(strategies)
    size0 = F.when(F.coalesce(F.col("size"), F.lit(0)) != 0, F.col("size")).otherwise(len_chars("content", utf16))
    df = (df.withColumn("original_size", size0.cast("long")).withColumn("content", content)
          .withColumn("strategies", strategies).withColumn("optimized_size", len_chars("content", utf16)))
    return df.drop(*[c for c in df.columns if c.startswith("_o_") or c == "_t"])


def drop_low_priority(files: DataFrame, max_tokens, len_col: str = "len", num_slices: int | None = None) -> DataFrame:
    """files leave in order (priority desc, pos asc) while the joined token
    count of the files still present exceeds ``max_tokens``.  Removing file r
    (0-based) happens iff ``ceil((T - before_r + n - r - 1) / 4) > max``, where
    ``before_r`` is the length already removed; one ordered running sum."""
    n_t = files.groupBy("corpus_id").agg(F.sum(len_col).cast("long").alias("_T"), F.count(F.lit(1)).alias("_n"))
    ranked = ordered_scan(files.withColumn("_dl", F.col(len_col).cast("long")), "corpus_id",
                          [F.col("priority").desc(), F.col("pos")], sums=["_dl"], pos_col="drop_rank", num_slices=num_slices)
    out = null_safe_join(ranked, n_t, ["corpus_id"])
    before = F.col("cum__dl") - F.col("_dl")
    rest = F.col("_T") - before + F.col("_n") - F.col("drop_rank")
    mx = F.lit(float(max_tokens))
    return (out.withColumn("dropped", F.ceil(rest / 4) > mx)
            .drop("_T", "_n", "cum__dl", "_dl"))


def _fold_block(L: int, len1, len2, offs, cum, max_tokens: float):
    """Vectorised exact fold over one block of candidate rows: the running
    total ``L_i`` before each row is guessed, every allowance and new length is
    computed at once, ``L_i`` is rebuilt by a cumulative sum, and this repeats
    until nothing changes.  Row i is exact once rows < i are, so at most one
    round per row is needed, and a few where truncations barely move the
    allowances."""
    m = len(len1)
    Ls = np.full(m, L, dtype=np.int64)
    tok2 = -(-len2 // 4)
    for _ in range(m + 1):
        stop = np.flatnonzero(-(-Ls // 4) <= max_tokens)
        n = int(stop[0]) if len(stop) else m
        a = np.floor((len1[:n] / Ls[:n]) * max_tokens * 0.5).astype(np.int64)
        trunc = (a > 0) & (tok2[:n] > a)
        nl = len2[:n].copy()
        keep = np.full(n, -1, dtype=np.int64)
        if trunc.any():
            idx = np.flatnonzero(trunc)
            target = np.floor(a[idx] * (len2[idx] / tok2[idx]) * 0.95).astype(np.int64)
            # lines of row r are cum[offs[r]:offs[r+1]] (running length incl. newline)
            lo, hi = offs[idx], offs[idx + 1]
            k = _segmented_count(cum, lo, hi, target)
            kept = np.where(k > 0, cum[np.maximum(lo + k - 1, 0)], 0)
            keep[idx] = k
            nl[idx] = kept + MARKER_LEN
        newLs = np.empty(m, dtype=np.int64)
        newLs[0] = L
        if m > 1:
            delta = np.concatenate([nl - len1[:n], np.zeros(m - n, dtype=np.int64)])
            newLs[1:] = L + np.cumsum(delta)[:-1]
        if np.array_equal(newLs[:n + 1 if n < m else m], Ls[:n + 1 if n < m else m]):
            Lend = int(Ls[n - 1] - len1[n - 1] + nl[n - 1]) if n > 0 else L
            return n, a, keep, nl, Lend
        Ls = newLs
    raise RuntimeError("fold did not converge")


def _segmented_count(cum, lo, hi, target):
    """For each row r: how many of cum[lo_r:hi_r] satisfy cum - 1 <= target_r
    (each segment is increasing), in one searchsorted over a shifted key."""
    lens = hi - lo
    rows = np.repeat(np.arange(len(lo)), lens)
    pos = np.concatenate([np.arange(l, h) for l, h in zip(lo, hi)]) if len(lo) else np.zeros(0, dtype=np.int64)
    big = int(max(int(cum.max()) if len(cum) else 0, int(target.max()) if len(target) else 0)) + 2
    key = rows.astype(np.int64) * big + (cum[pos] - 1)
    q = np.arange(len(lo), dtype=np.int64) * big + target
    starts = np.concatenate([[0], np.cumsum(lens)[:-1]]) if len(lens) else lens
    return np.searchsorted(key, q, side="right") - starts


_FOLD = "_fold_blk"
BLOCK = 1024         # rows solved at once


def _fold_rows(L: int, pdf: pd.DataFrame, max_tokens: float):
    """Fold a run of rows of one corpus, entered with the total ``L``: arrays
    of the decisions, and the total handed on."""
    m = len(pdf)
    visited = np.zeros(m, dtype=bool)
    allow, keep = np.zeros(m, dtype=np.int64), np.full(m, -1, dtype=np.int64)
    new_len = pdf["_len2"].to_numpy(dtype=np.int64).copy()
    len1, lines = pdf["_len1"].to_numpy(dtype=np.int64), pdf["_lines"].to_numpy()
    for i in range(0, m, BLOCK):
        j = min(i + BLOCK, m)
        ls = [np.asarray(x, dtype=np.int64) for x in lines[i:j]]
        offs = np.concatenate([[0], np.cumsum([len(x) for x in ls])]).astype(np.int64)
        cum = np.concatenate([np.cumsum(x + 1) for x in ls]) if offs[-1] else np.zeros(0, np.int64)
        n, a, kp, nl, L = _fold_block(L, len1[i:j], new_len[i:j], offs, cum, max_tokens)
        visited[i:i + n], allow[i:i + n], keep[i:i + n], new_len[i:i + n] = True, a, kp, nl
        if n < j - i:
            break
    return visited, allow, keep, new_len, L


def _runs(pdf: pd.DataFrame):
    """Runs of one corpus in a batch of a slice, whose order is checked."""
    k = pdf["corpus_id"].to_numpy(dtype=object)
    cut = np.flatnonzero(k[1:] != k[:-1]) + 1
    pri, pos = pdf["priority"].to_numpy(dtype=np.int64), pdf["pos"].to_numpy(dtype=np.int64)
    same = k[1:] == k[:-1]
    if np.any(same & ((pri[1:] > pri[:-1]) | ((pri[1:] == pri[:-1]) & (pos[1:] <= pos[:-1])))):
        raise RuntimeError("rows of a corpus are not in the order of the fold")
    for a, z in zip([0, *cut], [*cut, len(k)]):
        yield k[a], pdf.iloc[a:z]


def _fold_slices(entries: dict, max_tokens: float, decisions: bool):
    """Over the batches of a slice: per row its decisions, or per corpus in the
    slice the change of the total.  ``entries`` has the total with which a
    corpus enters the slice; a corpus without one starts from its ``_L0``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        corpus, begun, L, first, blk = None, False, 0, 0, 0
        sums = []
        for pdf in batches:
            if not len(pdf):
                continue
            blk = int(pdf[_FOLD].iat[0])
            for k, part in _runs(pdf):
                if not begun or k != corpus:
                    if begun:
                        sums.append((corpus, blk, L - first))
                    corpus, begun = k, True
                    L = first = entries.get((k, blk), int(part["_L0"].iat[0]))
                visited, allow, keep, new_len, L = _fold_rows(L, part, max_tokens)
                if decisions:
                    yield pd.DataFrame({"corpus_id": part["corpus_id"].to_numpy(), "pos": part["pos"].to_numpy(), "visited": visited,
                                        "allowance": allow, "keep_lines": keep, "new_len": new_len})
        if begun and not decisions:
            sums.append((corpus, blk, L - first))
            yield pd.DataFrame(sums, columns=["corpus_id", _FOLD, "delta"])
    return run


def truncate_low_priority(cand: DataFrame, max_tokens: float, num_slices: int | None = None) -> DataFrame:
    """F8 on narrow candidate rows (``corpus_id, pos, priority, _len1, _len2,
    _lines, _L0``): decisions for the rows that proportional truncation visits.

    What a file may keep depends on the earlier files of its corpus only
    through their running total.  So candidates are range-partitioned in fold
    order, a hot corpus into many slices, and every slice is folded from a
    guess of the total it is entered with.  The slices' changes give better
    guesses for the slices after them, until no guess changes: then every
    slice was folded from the exact total.  Only corpora that cross a slice
    border have guesses (at most two per slice, one number each, which is all
    that reaches the driver), and at most one round per slice is needed."""
    from .pack import checkpoint
    n = num_slices or int(cand.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("corpus_id"), F.col("priority").desc(), F.col("pos")]
    sliced = checkpoint(cand.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(_FOLD, F.spark_partition_id()))
    seen = sliced.groupBy("corpus_id", _FOLD).agg(F.first("_L0").alias("_L0"))
    spanning = seen.groupBy("corpus_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("corpus_id")
    spread = sorted(((r.corpus_id, r[_FOLD], r._L0) for r in null_safe_join(seen, spanning, ["corpus_id"], "left_semi").collect()),
                    key=lambda x: (x[0] is not None, x[0] or "", x[1]))
    entries: dict = {}
    if spread:
        while True:
            found = sliced.mapInPandas(_fold_slices(entries, max_tokens, False), f"corpus_id string, {_FOLD} int, delta long")
            deltas = {(r.corpus_id, r[_FOLD]): r.delta for r in null_safe_join(found, spanning, ["corpus_id"], "left_semi").collect()}
            guess, at, corpus = {}, 0, spread
            for k, blk, start in spread:
                at = start if k != corpus else at
                corpus = k
                guess[k, blk] = at
                at += deltas[k, blk]
            if guess == entries:
                break
            entries = guess
    schema = "corpus_id string, pos long, visited boolean, allowance long, keep_lines long, new_len long"
    return sliced.mapInPandas(_fold_slices(entries, max_tokens, True), schema).where("visited")


def target_tokens_for(model: str | None, target_tokens=None, command: bool = False):
    """Budget: explicit target, else ``floor(0.85 * context)`` (command) or
    ``0.9 * context`` (library), else 100,000 for an unknown model."""
    if target_tokens:
        return target_tokens
    ctx = model_context(model or K.DEFAULT_MODEL)
    if ctx is None:
        return None if command else K.UNKNOWN_MODEL_TARGET_TOKENS
    return math.floor(ctx * 0.85) if command else ctx * 0.9


def optimize_context(files: DataFrame, *, target_tokens=None, model: str = K.DEFAULT_MODEL,
                     remove_comments_: bool = True, remove_empty_lines_: bool = True, minify_: bool = False,
                     preserve_priority: int = K.PRESERVE_PRIORITY, reclean: dict | None = None,
                     command: bool = False, utf16: bool = False) -> DataFrame:
    """F9 over packed files with content (``corpus_id, path, content, size,
    priority, pos``).  ``reclean`` holds the cleaning flags the caller passed
    explicitly (phase 2 re-cleans with exactly those; the command passes all
    three).  Returns one row per file with ``content`` (final), ``dropped``,
    ``strategies``, ``original_size``, ``optimized_size``, ``len``."""
    max_tokens = target_tokens_for(model, target_tokens, command)
    if reclean is None:
        reclean = {"remove_comments_": remove_comments_, "remove_empty_lines_": remove_empty_lines_,
                   "minify_": minify_} if command else {}
    rc = {"remove_comments_": bool(reclean.get("remove_comments_")),
          "remove_empty_lines_": bool(reclean.get("remove_empty_lines_")),
          "minify_": bool(reclean.get("minify_"))}
    size0 = F.when(F.coalesce(F.col("size"), F.lit(0)) != 0, F.col("size")).otherwise(len_chars("content", utf16))
    p1 = clean_steps(files.withColumn("original_size", size0.cast("long")), "content", "_p1",
                     remove_comments_=remove_comments_, remove_empty_lines_=remove_empty_lines_,
                     minify_=minify_, utf16=utf16)
    # The cleaned texts are written once: what follows reads the lengths of all
    # files, the texts of what may be truncated, and at the end those of all.
    from .pack import checkpoint, stored
    p1 = stored(p1.drop("content"))
    lengths = p1.select("corpus_id", "pos", "priority", F.col("_p1_len").alias("_len1"))
    tot = lengths.groupBy("corpus_id").agg(
        (F.sum("_len1") + F.greatest(F.count(F.lit(1)) - 1, F.lit(0))).cast("long").alias("_L0"))
    # Corpora within the budget have nothing to truncate, and only the others' lines are looked at.
    over = tot.where(F.ceil(F.col("_L0") / 4) > F.lit(float(max_tokens)))
    cand = null_safe_join(p1.where(F.col("priority") > preserve_priority).select("corpus_id", "path", "pos", "priority", "_p1_content", F.col("_p1_len").alias("_len1")),
                          over, ["corpus_id"])
    cand = clean_steps(cand, "_p1_content", "_p2", **rc, utf16=utf16)
    cand = cand.select("corpus_id", "pos", "priority", "_len1", F.col("_p2_len").alias("_len2"),
                       F.transform(F.split("_p2_content", "\n", -1), lambda l: len_chars(l, utf16)).alias("_lines"), "_L0")
    cand = checkpoint(cand)
    fold = truncate_low_priority(cand, float(max_tokens), slices_for(cand))
    # The fold's columns ride through the drop step (its ordered scan keeps
    # every column), so the fold runs once.
    final_len = checkpoint(null_safe_join(lengths, fold, ["corpus_id", "pos"], "left")
                           .select("corpus_id", "pos", "priority", "visited", "keep_lines", "new_len",
                                   F.when(F.coalesce("visited", F.lit(False)), F.col("new_len")).otherwise(F.col("_len1"))
                                   .cast("long").alias("len")))
    decisions = drop_low_priority(final_len, max_tokens, "len", slices_for(final_len)).drop("len", "priority")
    # Final content: phase 1 for every kept row, the second pass only where
    # the fold visited the file.
    visited = F.coalesce(F.col("visited"), F.lit(False))
    df = clean_steps(null_safe_join(p1, decisions, ["corpus_id", "pos"]), "_p1_content", "_p2", **rc, utf16=utf16,
                     only_where=visited)
    truncated = F.col("keep_lines") >= 0
    content2 = F.when(truncated, truncate_lines("_p2_content", F.col("keep_lines"))).otherwise(F.col("_p2_content"))
    strat2 = F.when(truncated & (F.col("new_len") < F.col("_p2_len")),
                    F.array_append(F.col("_p2_strategies"), F.lit(K.STRATEGY_TRUNCATE_LARGE))) \
        .otherwise(F.col("_p2_strategies"))
    df = (df.withColumn("content", F.when(visited, content2).otherwise(F.col("_p1_content")))
          .withColumn("strategies", F.when(visited, strat2).otherwise(F.col("_p1_strategies")))
          .withColumn("len", F.when(visited, F.col("new_len")).otherwise(F.col("_p1_len")).cast("long"))
          .withColumn("optimized_size", F.col("len"))
          .withColumn("truncated", visited & truncated))
    df = df.drop(*[c for c in df.columns if c.startswith("_p1_") or c.startswith("_p2_")],
                 "visited", "new_len", "allowance", "keep_lines")
    return df.withColumn("target_tokens", F.lit(float(max_tokens)))


def strategies_used(optimized: DataFrame) -> DataFrame:
    """Distinct strategy names over the files that remain (sorted)."""
    kept = optimized.where(~F.col("dropped"))
    ex = kept.select("corpus_id", F.explode("strategies").alias("s"))
    return ex.groupBy("corpus_id").agg(F.array_join(F.array_sort(F.collect_set("s")), ", ").alias("strategies"))


def optimize_summary(optimized: DataFrame, initial: DataFrame) -> DataFrame:
    """Initial tokens (per-file sum), final tokens (joined), reduction,
    files left and dropped.  ``initial`` is a pack summary (``tokens``)."""
    agg = optimized.groupBy("corpus_id").agg(
        F.count_if(~F.col("dropped")).cast("long").alias("files"),
        F.count_if(F.col("dropped")).cast("long").alias("dropped_files"),
        F.coalesce(F.sum(F.when(~F.col("dropped"), F.col("len"))), F.lit(0)).cast("long").alias("_chars"),
        F.coalesce(F.sum(F.when(~F.col("dropped"), F.col("optimized_size"))), F.lit(0)).cast("long").alias("total_size"),
        F.first("target_tokens").alias("target_tokens"))
    agg = agg.withColumn("final_tokens", joined_tokens("_chars", "files")).drop("_chars")
    out = null_safe_join(initial.select("corpus_id", F.col("tokens").alias("initial_tokens")), agg, ["corpus_id"])
    red = F.col("initial_tokens") - F.col("final_tokens")
    return out.withColumn("reduction", red.cast("long")).withColumn(
        "reduction_pct", F.try_divide(red * 100.0, F.col("initial_tokens")))


def get_suggestions(summary: DataFrame, model: str = K.DEFAULT_MODEL) -> DataFrame:
    """I1 from joined tokens (E3) and the large-file count."""
    ctx = model_context(model)
    t = F.col("tokens_joined")
    rows = []
    if ctx is not None:
        err = F.when(t > F.lit(ctx), F.struct(
            F.lit("error").alias("severity"),
            F.concat(F.lit("Content ("), F.format_number(t, 0), F.lit(f" tokens) exceeds {model} context ("),
                     F.lit(f"{ctx:,}"), F.lit(")")).alias("message"),
            F.lit("Run optimize command to fit within limit").alias("action")))
        warn = F.when((t <= F.lit(ctx)) & (t > F.lit(float(ctx)) * F.lit(0.9)), F.struct(
            F.lit("warning").alias("severity"),
            F.concat(F.lit("Using "), js_round(t / F.lit(ctx) * 100).cast("string"),
                     F.lit(f"% of {model} context")).alias("message"),
            F.lit("Consider optimizing to leave room for output").alias("action")))
        rows += [err, warn]
    info = F.when(F.col("large_files") > 0, F.struct(
        F.lit("info").alias("severity"),
        F.concat(F.col("large_files").cast("string"), F.lit(" large files detected")).alias("message"),
        F.lit("Consider using --max-file-size flag").alias("action")))
    rows.append(info)
    arr = F.filter(F.array(*rows), lambda x: x.isNotNull())
    return summary.select("corpus_id", F.posexplode(arr).alias("n", "s")).select(
        "corpus_id", F.col("n").cast("int").alias("n"), "s.severity", "s.message", "s.action")


def dropped_preview(optimized: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` dropped paths in drop order, and how many more."""
    from pyspark.sql import Window
    d = optimized.where("dropped")
    w = Window.partitionBy("corpus_id").orderBy("drop_rank")
    head = d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    first = head.groupBy("corpus_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "path"))), lambda x: x["path"]), "\n")
        .alias("first_dropped"))
    cnt = d.groupBy("corpus_id").agg(F.count(F.lit(1)).cast("long").alias("dropped_files"))
    return null_safe_join(first, cnt, ["corpus_id"]).withColumn("more", F.greatest(F.col("dropped_files") - n, F.lit(0)))
