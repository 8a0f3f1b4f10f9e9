"""Keeping packed corpora current from a change feed.

``changes(corpus_id, path, op, ts, seq, content, size)`` with ``op`` in
add / change / unlink.  A plain file-stream source sees neither deletes nor
rewrites, so operations are explicit rows.  Each operator has a batch twin
with identical semantics (used for checks).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators.joins import null_safe_join


def watch_filter(changes: DataFrame, output_name: str | None = None) -> DataFrame:
    """The watcher's own ignore regexes (dotfiles, node_modules, .git,
    dist, build, and the output file's name), tested on the corpus-relative
    path.  These are regexes, not ignore rules."""
    pats = list(K.WATCH_IGNORE_REGEXES)
    if output_name:
        pats.append(output_name.replace(".", r"\."))
    cond = F.lit(False)
    for p in pats:
        cond = cond | F.col("path").rlike(p)
    return changes.where(~cond)


def _gap(ms: int) -> str:
    return f"{int(ms)} milliseconds"


def debounce(changes: DataFrame, debounce_ms: int = K.DEFAULT_DEBOUNCE_MS,
             stability_ms: int = 0, watermark: str | None = None) -> DataFrame:
    """J3 + J6: one repack per burst of events in a corpus.  A burst ends when
    no event follows within ``debounce_ms`` (+ ``stability_ms``); the burst
    reports its last event.  Works on batch and streaming frames (append mode
    emits a burst once the watermark passes its end)."""
    gap = int(debounce_ms) + int(stability_ms)
    df = changes
    if watermark:
        df = df.withWatermark("ts", watermark)
    last = F.struct("ts", "seq")
    return (df.groupBy("corpus_id", F.session_window("ts", _gap(gap)).alias("burst"))
            .agg(F.count(F.lit(1)).cast("long").alias("events"),
                 F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
                 F.max_by("op", last).alias("last_op"), F.max_by("path", last).alias("last_path"))
            .select("corpus_id", "first_ts", "last_ts", "events", "last_op", "last_path",
                    F.col("burst.end").alias("repack_at")))


def debounce_batch(changes: DataFrame, debounce_ms: int = K.DEFAULT_DEBOUNCE_MS,
                   stability_ms: int = 0) -> DataFrame:
    """Batch twin of :func:`debounce` that does not put a corpus in one task.
    Events are range-partitioned by ``(corpus, ts, seq)``; each slice folds its
    sorted events into bursts in one streamed pass, so what leaves it is one
    row per burst.  Only a burst at a slice's edge can go on in the next
    slice; those (at most two per slice and corpus run) are merged by the same
    fold over the burst rows, whose number the events no longer determine."""
    from ..operators.ordered import _materialize
    gap_us = (int(debounce_ms) + int(stability_ms)) * 1000
    spark = changes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = changes.where(F.col("ts").isNotNull()).select("corpus_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "seq", "op", "path")
    schema = "corpus_id string, first_us long, last_us long, seq long, events long, op string, path string, slice int"

    def fold(batches):
        import pyarrow as pa
        import numpy as np
        from pyspark import TaskContext
        piece, held = TaskContext.get().partitionId(), None

        def out(rows):
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            rows = list(rows)
            return pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(zip(*rows), kinds)], pa.array([piece] * len(rows), pa.int32())],
                                              names=["corpus_id", "first_us", "last_us", "seq", "events", "op", "path", "slice"])

        for b in batches:
            if not b.num_rows:
                continue
            us, key = b.column(1).to_numpy(), b.column(0)
            first = np.ones(len(us), dtype=bool)
            codes = key.dictionary_encode().indices.fill_null(-1).to_numpy()
            first[1:] = (codes[1:] != codes[:-1]) | (us[1:] - us[:-1] > gap_us)
            start = np.flatnonzero(first)
            end = np.append(start[1:], len(us)) - 1
            take = lambda c, i: b.column(c).take(pa.array(i)).to_pylist()
            rows = [list(r) for r in zip(take(0, start), us[start].tolist(), us[end].tolist(), take(2, end), (end - start + 1).tolist(),
                                         take(3, end), take(4, end))]
            if held is not None:
                if rows[0][0] == held[0] and rows[0][1] - held[2] <= gap_us:
                    rows[0][1], rows[0][4] = held[1], rows[0][4] + held[4]
                else:
                    rows.insert(0, held)
            held = rows.pop()
            if rows:
                yield out(rows)
        if held is not None:
            yield out([held])

    sliced = (cols.repartitionByRange(n, "corpus_id", "us", "seq").sortWithinPartitions("corpus_id", "us", "seq")
              .mapInArrow(fold, schema))
    # The slices' bounds come from a sample, so the fold is evaluated once.
    bursts = _materialize(sliced)
    # First and last burst of each corpus in each slice; those that meet the next slice's are one.
    edge = (bursts.groupBy("corpus_id", "slice").agg(F.min("first_us").alias("a"), F.max("last_us").alias("z"), F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy("corpus_id").orderBy("slice")
    edge = edge.withColumn("joins", F.coalesce(F.col("a") - F.lag("z").over(w) <= F.lit(gap_us), F.lit(False)))
    # A chain ends where a slice does not join the one before, or holds several bursts.
    start = F.when(F.col("joins"), F.lit(0)).otherwise(F.lit(1))
    split = F.when(F.lag("n").over(w) > 1, F.lit(1)).otherwise(F.lit(0))
    edge = edge.withColumn("chain", F.sum(F.greatest(start, split)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    chained = null_safe_join(bursts, edge.select("corpus_id", "slice", "a", "z", "joins", "n", "chain",
                                                 F.lead("joins").over(w).alias("goes_on")), ["corpus_id", "slice"])
    # A burst belongs to the chain before it (its slice's first), after it (the last), or stands alone.
    first, last = F.col("first_us") == F.col("a"), F.col("last_us") == F.col("z")
    group = (F.when(first & F.col("joins"), F.struct(F.col("chain").alias("c"), F.lit(0).cast("long").alias("u")))
             .when(last & F.coalesce("goes_on", F.lit(False)), F.struct((F.col("chain") + F.when(F.col("n") > 1, 1).otherwise(0)).alias("c"), F.lit(0).cast("long").alias("u")))
             .otherwise(F.struct(F.lit(-1).cast("long").alias("c"), F.col("first_us").alias("u"))))
    at = F.struct("last_us", "seq")
    out = chained.withColumn("g", group).groupBy("corpus_id", "g").agg(
        F.sum("events").alias("events"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"),
        F.max_by("op", at).alias("last_op"), F.max_by("path", at).alias("last_path"))
    kind = changes.schema["ts"].dataType
    stamp = lambda c: F.timestamp_micros(c).cast(kind)
    return out.select("corpus_id", stamp(F.col("first_us")).alias("first_ts"), stamp(F.col("last_us")).alias("last_ts"),
                      F.col("events").cast("long").alias("events"), "last_op", "last_path",
                      stamp(F.col("last_us") + F.lit(gap_us)).alias("repack_at"))


def burst_cells(changes: DataFrame, gap_ms: int, watermark: str) -> DataFrame:
    """First stage of the streaming debounce: events of a corpus by cells of
    time as wide as the gap.  Events of one cell are always of one burst, so a
    cell is one row of a windowed aggregate: a corpus's events are counted where
    they arrive, and its state is a row for each open cell."""
    last = F.struct("ts", "seq")
    return (changes.where(F.col("ts").isNotNull()).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
            .groupBy("corpus_id", F.window("ts", _gap(gap_ms)).alias("cell"))
            .agg(F.count(F.lit(1)).cast("long").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
                 F.max_by("op", last).alias("op"), F.max_by("path", last).alias("path"))
            .select("corpus_id", F.col("cell.end").alias("cell_end"), F.unix_micros("first_ts").alias("first_us"),
                    F.unix_micros("last_ts").alias("last_us"), "events", "op", "path"))


_BURST = {"corpus_id": "string", "first_us": "long", "last_us": "long", "events": "long", "op": "string", "path": "string"}
#: Hash buckets of corpora whose open bursts are one state each.
BURST_BUCKETS = 1024


def bursts_of_cells(cells: DataFrame, gap_ms: int, delay_ms: int) -> DataFrame:
    """Second stage: neighbouring cells of a corpus whose events are no further
    apart than the gap are one burst.  Corpora share ``BURST_BUCKETS`` states, so
    that a batch costs a call for each bucket, not for each corpus; what the
    state holds of a corpus is its open burst, five values; event time closes it
    when no cell that could go on with it can come any more."""
    from pyspark.sql.streaming.state import GroupStateTimeout
    gap_us, names = int(gap_ms) * 1000, list(_BURST)

    def merge(key, frames, state):
        import numpy as np
        import pandas as pd
        held = [pd.DataFrame(dict(zip(names, state.get)))] if state.exists else []
        rows = pd.concat([*held, *([] if state.hasTimedOut else frames)], ignore_index=True)[names]
        corpus = pd.factorize(rows["corpus_id"])[0]
        order = np.lexsort((rows["first_us"].to_numpy(), corpus))
        rows, corpus = rows.iloc[order], corpus[order]
        first_us, last_us = rows["first_us"].to_numpy(np.int64), rows["last_us"].to_numpy(np.int64)
        first = np.ones(len(rows), dtype=bool)
        first[1:] = (corpus[1:] != corpus[:-1]) | (first_us[1:] - last_us[:-1] > gap_us)
        start = np.flatnonzero(first)
        end = np.append(start[1:], len(rows)) - 1
        bursts = rows.iloc[end].assign(first_us=first_us[start], events=np.add.reduceat(rows["events"].to_numpy(np.int64), start))
        # A corpus's last burst may go on: an event within the gap stands in a cell that ends at most two gaps later.
        now, over = state.getCurrentWatermarkMs(), last_us[end] // 1000 + 2 * int(gap_ms) + 1
        is_open = (np.append(corpus[end][1:] != corpus[end][:-1], True)) & (over >= now)
        left = bursts[is_open]
        if len(left):
            state.update(tuple(left[c].tolist() for c in names))
            state.setTimeoutTimestamp(max(int(over[is_open].min()), now + 1))
        elif state.exists:
            state.remove()
        yield bursts[~is_open]

    schema = ", ".join(f"{c} {k}" for c, k in _BURST.items())
    kept = ", ".join(f"{c} array<{k}>" for c, k in _BURST.items())
    stamp = lambda c: F.timestamp_micros(c)
    bucket = F.pmod(F.xxhash64("corpus_id"), F.lit(BURST_BUCKETS))
    out = (cells.withWatermark("cell_end", _gap(delay_ms)).withColumn("bucket", bucket).groupBy("bucket")
           .applyInPandasWithState(merge, schema, kept, "append", GroupStateTimeout.EventTimeTimeout))
    return out.select("corpus_id", stamp(F.col("first_us")).alias("first_ts"), stamp(F.col("last_us")).alias("last_ts"), "events",
                      F.col("op").alias("last_op"), F.col("path").alias("last_path"), stamp(F.col("last_us") + gap_us).alias("repack_at"))


def debounce_stream(changes: DataFrame, path: str, debounce_ms: int = K.DEFAULT_DEBOUNCE_MS, stability_ms: int = 0,
                    watermark: str = "10 minutes", available_now: bool = True) -> list:
    """J3 + J6 as two streaming queries under ``path``: cells of events, and the
    bursts they make up (``path/bursts``, appended when they are over).  Each
    stage has its checkpoint and its sink's log, so a restart goes on where it
    was, each row once.  Events later than the watermark are not counted.  With
    ``available_now`` both read what is there and end; a burst is over when
    later events of any corpus say so."""
    spark = changes.sparkSession
    gap = int(debounce_ms) + int(stability_ms)

    def start(df: DataFrame, name: str):
        w = (df.writeStream.format("parquet").option("path", f"{path}/{name}").option("checkpointLocation", f"{path}/{name}-checkpoint")
             .outputMode("append"))
        q = (w.trigger(availableNow=True) if available_now else w).start()
        if available_now:
            q.awaitTermination()
        return q

    cells = burst_cells(changes, gap, watermark)
    first = start(cells, "cells")
    # The sink's log shows whole batches, and all new ones are read at once, so no cell comes after a later batch's.
    second = start(bursts_of_cells(spark.readStream.schema(cells.schema).parquet(f"{path}/cells"), gap, gap), "bursts")
    return [first, second]


def _last_events(changes: DataFrame) -> DataFrame:
    key = F.struct("ts", "seq")
    last = changes.groupBy("corpus_id", "path").agg(
        F.max_by(F.struct("op", "ts", "seq", "content", "size"), key).alias("e"))
    return last.select("corpus_id", "path", "e.*")


def latest_state(changes: DataFrame) -> DataFrame:
    """The current file set: the last event per (corpus, path) by
    ``(ts, seq)``, unlinked files removed.  Later-arriving old events cannot
    regress a path because the order is by event time, not arrival."""
    return _last_events(changes).where(F.col("op") != "unlink")


def stream_changes(spark: SparkSession, folder: str, schema: str, glob: str | None = None,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming read of change rows landing as parquet files."""
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return r.parquet(folder)


def incremental_repack(stream: DataFrame, state_path: str, out_path: str, checkpoint: str,
                       summarize, trigger_once: bool = True, buckets: int = 64):
    """Per micro-batch, recompute the corpora it touched.

    The state is the last event of every (corpus, path), unlinks included (a
    late older event must not bring a file back), in hash buckets of the
    corpus.  A batch reads the folders of the buckets it touches, merges its
    own events and writes those buckets anew under its batch id; a table of
    the current version of each bucket (``buckets`` rows) is written beside.
    So a batch costs what its buckets hold, not the history, and a replay
    overwrites only its own folders.

    ``summarize(files) -> DataFrame`` maps the current files of the touched
    corpora to rows keyed by ``corpus_id``.  A corpus that has no file left
    gets a row flagged ``emptied`` that hides its older ones."""
    def each(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        own = batch.persist()
        try:
            b = _last_events(own).withColumn("bucket", F.pmod(F.xxhash64("corpus_id"), F.lit(int(buckets))).cast("int"))
            touched = sorted(r.bucket for r in b.select("bucket").distinct().collect())      # at most `buckets`
            if not touched:
                b = b.limit(0)
            version = {r.bucket: r.batch for r in spark.read.parquet(f"{state_path}/versions/{batch_id - 1}").collect()} if batch_id else {}
            old = [f"{state_path}/rows/{version[k]}/bucket={k}" for k in touched if k in version]
            events = b.drop("bucket")
            if old:
                events = events.unionByName(spark.read.schema(events.schema).parquet(*old))
            bucket = F.pmod(F.xxhash64("corpus_id"), F.lit(int(buckets))).cast("int")
            rows = f"{state_path}/rows/{batch_id}"
            (_last_events(events).withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64("path"), F.lit(8)))
             .write.mode("overwrite").partitionBy("bucket").parquet(rows))
            version.update({k: int(batch_id) for k in touched})
            spark.createDataFrame(list(version.items()), "bucket int, batch int").coalesce(1) \
                .write.mode("overwrite").parquet(f"{state_path}/versions/{batch_id}")
            corpora = own.select("corpus_id").distinct()
            now = (spark.read.schema(events.schema).parquet(rows).join(corpora, "corpus_id", "left_semi")
                   .where(F.col("op") != "unlink"))
            res = summarize(now).withColumn("emptied", F.lit(False))
            gone = corpora.join(now.select("corpus_id").distinct(), "corpus_id", "left_anti").withColumn("emptied", F.lit(True))
            (res.unionByName(gone, allowMissingColumns=True).withColumn("batch_id", F.lit(int(batch_id)))
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out_path))
        finally:
            own.unpersist()

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()


def current_output(spark: SparkSession, out_path: str) -> DataFrame:
    """The newest recomputed row per corpus across micro-batches; corpora that
    were emptied have none.  A partial aggregate, no window per corpus."""
    res = spark.read.parquet(out_path)
    cols = [c for c in res.columns if c != "batch_id"]
    last = res.groupBy(F.col("corpus_id").alias("_c")).agg(F.max_by(F.struct(*cols), "batch_id").alias("r"))
    return last.select("r.*").where(~F.col("emptied")).drop("emptied")


#: What a file adds to its corpus: files there are, files kept and their sums.
DELTAS = ["present", "total_files", "total_size", "tokens", "total_chars", "large_files"]


def contributions(changes: DataFrame, ignore=(), extensions=None, max_file_size: int | None = None) -> DataFrame:
    """``corpus_id, path, ts, seq`` and what each event's file adds (``DELTAS``):
    nothing after an unlink, only its presence where the rules ignore it."""
    from ..functions.tokens import len_chars, tokens_from_len
    from ..operators.filters import selected
    there = F.col("op") != "unlink"
    kept = there & F.coalesce(selected(ignore, extensions, max_file_size), F.lit(True))
    chars = F.coalesce(len_chars("content"), F.lit(0)).cast("long")
    values = {"present": there.cast("long"), "total_files": kept.cast("long"), "total_size": F.coalesce("size", F.lit(0)).cast("long"),
              "tokens": tokens_from_len(chars).cast("long"), "total_chars": chars, "large_files": (F.col("size") > K.LARGE_FILE_BYTES).cast("long")}
    return changes.select("corpus_id", "path", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("seq").cast("long").alias("seq"),
                          *[(v if k in ("present", "total_files") else F.when(kept, F.coalesce(v, F.lit(0))).otherwise(F.lit(0))).cast("long").alias(k)
                            for k, v in values.items()])


#: The last event of a (corpus, path): its time and what it adds.
_LAST = ["us", "seq", *DELTAS]


def _newest_versions(state_path: str, batch_id: int) -> dict[int, str]:
    """Folder of each bucket's newest version before ``batch_id``.  Older ones are
    removed: the batch before has ended, so nothing reads them again."""
    from pyarrow import fs as pafs

    from ..sources.files import _filesystem
    fsys, base = _filesystem(state_path)
    found = {f.path.rstrip("/") for f in fsys.get_file_info(pafs.FileSelector(base, allow_not_found=True, recursive=True)) if f.path.rsplit("/", 1)[-1].startswith("bucket=")}
    versions = sorted((int(f.split("/")[-1][7:]), int(f.split("/")[-2]), f) for f in found)
    newest = {k: v for k, v, _ in versions if v < batch_id}
    for k, v, f in versions:
        if v < newest.get(k, 0):
            fsys.delete_dir(f)
    return {k: f"{state_path}/{v}/bucket={k}" for k, v in newest.items()}


def signed_deltas(rows: DataFrame, state_path: str, batch_id: int, buckets: int = 64) -> DataFrame:
    """``corpus_id`` and the change of its sums, one row for each file that a
    batch changed: what its new event adds less what its last one had added.
    The state has one row for each (corpus, path): its last event's time and
    contribution, also after an unlink, so that an older event that comes later
    changes nothing.

    ``rows`` are a batch's ``contributions``.  The state lies in hash buckets of
    (corpus, path); a batch reads the buckets it touches and writes them anew
    under its own number, so a replay reads what the first attempt read and
    overwrites only its own folder."""
    spark = rows.sparkSession
    kinds = [f"{c} long" for c in _LAST]
    last = f"struct<{', '.join(k.replace(' ', ': ') for k in kinds)}>"
    bucket = F.pmod(F.xxhash64("corpus_id", "path"), F.lit(int(buckets))).cast("int")
    events = (rows.groupBy("corpus_id", "path").agg(F.max(F.struct(*_LAST)).alias("now"))
              .select("corpus_id", "path", "now", F.lit(None).cast(last).alias("was"), bucket.alias("bucket"))).persist()
    try:
        touched = [r.bucket for r in events.select("bucket").distinct().collect()]              # at most `buckets`
        newest = _newest_versions(state_path, int(batch_id))
        both = events
        if old := [newest[k] for k in touched if k in newest]:
            state = spark.read.schema(", ".join(["corpus_id string", "path string", *kinds])).parquet(*old)
            both = events.unionByName(state.select("corpus_id", "path", F.lit(None).cast(last).alias("now"), F.struct(*_LAST).alias("was"), bucket.alias("bucket")))
        both = both.repartition("bucket").groupBy("bucket", "corpus_id", "path").agg(F.max("now").alias("now"), F.max("was").alias("was"))
        newer = F.col("was").isNull() | (F.struct("now.us", "now.seq") > F.struct("was.us", "was.seq"))
        changed = F.col("now").isNotNull() & newer
        kept = F.when(changed, F.col("now")).otherwise(F.col("was"))
        (both.select("bucket", "corpus_id", "path", *[kept[c].alias(c) for c in _LAST], changed.alias("changed"),
                     *[(F.col("now")[c] - F.coalesce(F.col("was")[c], F.lit(0))).alias(f"{c}_delta") for c in DELTAS])
         .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{state_path}/{int(batch_id)}"))
    finally:
        events.unpersist()
    written = spark.read.schema(", ".join(["corpus_id string", "changed boolean", *[f"{c}_delta long" for c in DELTAS]])).parquet(f"{state_path}/{int(batch_id)}")
    return written.where("changed").select("corpus_id", *[F.col(f"{c}_delta").alias(c) for c in DELTAS])


def incremental_totals(changes: DataFrame, path: str, trigger_once: bool = True, buckets: int = 64, **selection):
    """J5 by signed deltas: totals of every corpus, kept by a streaming query
    that costs a batch its own rows and the buckets of the state they touch
    (``signed_deltas``, under ``path/state``).  A batch appends one row
    for each corpus it touches under ``path/deltas``; a replay overwrites only
    its own.  ``current_totals`` adds them up, ``fold_totals`` shortens them.

    Rules are those that a row meets on its own (the default list and
    ``selection``); rule files inside a corpus need :func:`incremental_repack`."""
    def each(batch: DataFrame, batch_id: int):
        deltas = signed_deltas(batch, f"{path}/state", batch_id, buckets)
        sums = deltas.groupBy("corpus_id").agg(*[F.sum(c).cast("long").alias(c) for c in DELTAS])
        sums.write.mode("overwrite").parquet(f"{path}/deltas/batch={int(batch_id)}")

    w = contributions(changes, **selection).writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/checkpoint")
    return (w.trigger(availableNow=True) if trigger_once else w).start()


_DELTA_SCHEMA = "corpus_id string, " + ", ".join(f"{c} long" for c in DELTAS) + ", batch int"


def _delta_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows that still count: the last fold and the batches after it."""
    rows = spark.read.schema(_DELTA_SCHEMA).option("recursiveFileLookup", "false").parquet(f"{path}/deltas")
    folded = _folds(path)
    if not folded:
        return rows
    base = spark.read.schema(_DELTA_SCHEMA).parquet(f"{path}/folds/{folded[-1]}").withColumn("batch", F.lit(folded[-1]))
    return rows.where(F.col("batch") > folded[-1]).unionByName(base)


def _folds(path: str) -> list[int]:
    """Batches up to which folds are whole."""
    from pyarrow import fs as pafs

    from ..sources.files import _filesystem
    fsys, base = _filesystem(f"{path}/folds")
    found = fsys.get_file_info(pafs.FileSelector(base, allow_not_found=True, recursive=True))
    return sorted(int(f.path.split("/")[-2]) for f in found if f.path.endswith("/_SUCCESS"))


def current_totals(spark: SparkSession, path: str) -> DataFrame:
    """Totals of every corpus that has a file, as a full pack gives them."""
    from ..functions.tokens import joined_tokens
    sums = _delta_rows(spark, path).groupBy("corpus_id").agg(*[F.sum(c).cast("long").alias(c) for c in DELTAS])
    return (sums.where("present > 0").drop("present").withColumn("tokens_joined", joined_tokens("total_chars", "total_files")))


def fold_totals(spark: SparkSession, path: str) -> None:
    """Write the sums of all batches so far as one; readers then take that and
    the batches after it.  Batches that an older fold has are removed."""
    from ..sources.files import _filesystem
    from pyarrow import fs as pafs
    rows = _delta_rows(spark, path)
    top = rows.agg(F.max("batch").alias("b")).first().b
    folded = _folds(path)
    if top is None or (folded and folded[-1] >= top):
        return
    sums = rows.where(F.col("batch") <= top).groupBy("corpus_id").agg(*[F.sum(c).cast("long").alias(c) for c in DELTAS])
    sums.write.mode("overwrite").parquet(f"{path}/folds/{int(top)}")
    if folded:
        # One fold is kept behind, for readers that have begun; what is before it is done with.
        fsys, base = _filesystem(path)
        for f in fsys.get_file_info(pafs.FileSelector(f"{base}/deltas", allow_not_found=True)):
            name = f.path.rsplit("/", 1)[-1]
            if name.startswith("batch=") and int(name[6:]) <= folded[-1]:
                fsys.delete_dir(f.path)


def changes_between(old: DataFrame, new: DataFrame, ts, key: str = "content_key") -> DataFrame:
    """J1 from two listings: ``corpus_id, path, op`` of every file that was
    added, changed (another ``key``) or unlinked, with ``ts`` and the columns
    of ``new``.  Both have one row a file; nothing is compared but ``key``."""
    before = old.select("corpus_id", "path", F.col(key).alias("_old"), F.lit(True).alias("_was"))
    cond = F.col("corpus_id").eqNullSafe(F.col("_c")) & F.col("path").eqNullSafe(F.col("_p"))
    both = new.withColumn("_is", F.lit(True)).join(before.withColumnsRenamed({"corpus_id": "_c", "path": "_p"}), cond, "full")
    op = F.when(F.col("_was").isNull(), "add").when(F.col("_is").isNull(), "unlink").when(~F.col(key).eqNullSafe(F.col("_old")), "change")
    gone = F.col("_is").isNull()
    return (both.withColumn("op", op).where("op is not null")
            .withColumn("corpus_id", F.when(gone, F.col("_c")).otherwise(F.col("corpus_id"))).withColumn("path", F.when(gone, F.col("_p")).otherwise(F.col("path")))
            .withColumn("ts", F.lit(ts).cast("timestamp")).drop("_c", "_p", "_old", "_was", "_is"))


class DirectoryFeed:
    """J1 on a directory tree: each :meth:`poll` lists it by tasks, compares the
    listing with the last one by name, length and time of change, reads only
    files that are new or changed, and lands the changes as a batch that
    :func:`stream_changes` reads.

    Polls are numbered and write under ``path``, in this order: what they
    listed, the changes, and the listing that ends the poll.  One that was cut
    short is gone on with by the next, from what it had listed, and changes
    that were landed are not landed again.  The first poll adds every file."""

    def __init__(self, spark: SparkSession, root: str, path: str, corpus_depth: int = 1):
        self.spark, self.root, self.path, self.depth = spark, root, path.rstrip("/"), corpus_depth

    def _whole(self, folder: str) -> list[int]:
        """Numbers under ``folder`` that were written to their end."""
        from pyarrow import fs as pafs

        from ..sources.files import _filesystem
        fsys, base = _filesystem(f"{self.path}/{folder}")
        found = fsys.get_file_info(pafs.FileSelector(base, allow_not_found=True, recursive=True))
        return sorted(int(f.path.split("/")[-2].split("=")[-1]) for f in found if f.path.endswith("/_SUCCESS"))

    @property
    def changes(self) -> str:
        return f"{self.path}/changes"

    def poll(self, now) -> int:
        """Land the changes since the last poll, stamped ``now``; their number."""
        from ..sources.files import list_files, read_listed, with_corpus
        spark, last = self.spark, max(self._whole("listings"), default=0)
        listed_path, landed = f"{self.path}/listed/{last + 1}", f"{self.changes}/poll={last + 1}"
        if last + 1 not in self._whole("listed"):
            listed = with_corpus(list_files(spark, self.root), self.depth)
            (listed.withColumn("content_key", F.concat_ws("/", F.col("length").cast("string"), F.col("changed").cast("string")))
             .write.mode("overwrite").parquet(listed_path))
        listed = spark.read.parquet(listed_path)
        old = spark.read.parquet(f"{self.path}/listed/{last}") if last else listed.limit(0)
        if last + 1 not in self._whole("changes"):
            found = changes_between(old, listed, now)
            rows = read_listed(found.where("op <> 'unlink'"), self.root, ["op", "ts"])
            gone = found.where("op = 'unlink'").select("corpus_id", "path", F.lit(None).cast("string").alias("content"), F.lit(None).cast("long").alias("size"), "op", "ts")
            out = rows.unionByName(gone).withColumn("seq", F.lit(last + 1).cast("long"))
            out.select("corpus_id", "path", "op", "ts", "seq", "content", "size").write.mode("overwrite").parquet(landed)
        n = spark.read.schema(CHANGES_SCHEMA).parquet(landed).count()
        spark.createDataFrame([(n,)], "changes long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/listings/{last + 1}")
        return n


CHANGES_SCHEMA = "corpus_id string, path string, op string, ts timestamp, seq long, content string, size long"
