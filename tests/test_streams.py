"""Streaming debounce, totals by signed deltas and the directory feed, over several batches and restarts."""
import datetime as dt
import os
import random
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from quire.operators.pack import pack
from quire.streaming import watch as W

BASE = dt.datetime(2024, 5, 1)
SCHEMA = "corpus_id string, path string, op string, ts timestamp, seq long, content string, size long"


def _land(spark, folder, rows):
    df = spark.createDataFrame([(c, p, op, BASE + dt.timedelta(seconds=s), n, t, None if t is None else len(t.encode())) for c, p, op, s, n, t in rows], SCHEMA)
    df.coalesce(1).write.mode("append").parquet(folder)
    time.sleep(0.05)


def _bursts(df):
    return sorted((r.corpus_id or "", r.first_ts, r.last_ts, r.events, r.last_op, r.last_path, r.repack_at) for r in df.collect())


def test_debounce_over_batches_late_rows_and_a_restart(spark):
    rnd = random.Random(3)
    rows, t = [], 0.0
    for n in range(260):
        t += rnd.choice([0.2, 1, 4, 9, 11, 30])
        rows.append((rnd.choice(["hot", "hot", "hot", "b", "c", None]), f"p{n % 7}", rnd.choice(["add", "change", "unlink"]), round(t, 3), n, None))
    folder, out = tempfile.mkdtemp(prefix="quire-ev-"), tempfile.mkdtemp(prefix="quire-bursts-")
    end = int(t)
    mixed = rows[:]
    for i in range(0, len(mixed) - 3, 9):
        mixed[i], mixed[i + 2] = mixed[i + 2], mixed[i]             # out of order, within the watermark
    markers = [("zz", "m", "end", end + 200, 900, None), ("zz", "m", "end", end + 2000, 901, None)]
    stream = W.stream_changes(spark, folder, spark.createDataFrame([], SCHEMA).schema, max_files_per_trigger=1)
    landed = [mixed[i:i + 40] for i in range(0, len(mixed), 40)]
    for part in landed[:4]:
        _land(spark, folder, part)
    W.debounce_stream(stream, out, 10_000, watermark="90 seconds")  # ends, and is started again from its checkpoint
    early = spark.read.parquet(f"{out}/bursts").count()
    for part in [*landed[4:], markers]:
        _land(spark, folder, part)
    _land(spark, folder, [("hot", "late", "change", 1, 999, None)])  # long after the watermark: not counted
    _land(spark, folder, [("zz", "m", "end", end + 4000, 902, None)])
    W.debounce_stream(stream, out, 10_000, watermark="90 seconds")
    batch = spark.createDataFrame([(c, p, op, BASE + dt.timedelta(seconds=s), n, None, None) for c, p, op, s, n, _ in rows], SCHEMA)
    got = _bursts(spark.read.parquet(f"{out}/bursts").where("corpus_id is null or corpus_id <> 'zz'"))
    assert got == _bursts(W.debounce_batch(batch, 10_000)) and 0 < early < len(got)


def test_corpora_share_the_states_of_their_open_bursts(spark, monkeypatch):
    monkeypatch.setattr(W, "BURST_BUCKETS", 2)
    rnd = random.Random(9)
    rows, t = [], 0.0
    for n in range(240):
        t += rnd.choice([0.1, 0.5, 1, 3])
        rows.append((rnd.choice([None, *[f"c{i}" for i in range(25)]]), rnd.choice([None, "p"]), rnd.choice([None, "add", "unlink"]), round(t, 3), n, None))
    folder, out = tempfile.mkdtemp(prefix="quire-ev-"), tempfile.mkdtemp(prefix="quire-bursts-")
    stream = W.stream_changes(spark, folder, spark.createDataFrame([], SCHEMA).schema)
    _land(spark, folder, rows[:200])
    second = W.debounce_stream(stream, out, 10_000, watermark="5 seconds")[1]
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in second.recentProgress) <= 2
    early = spark.read.parquet(f"{out}/bursts").count()
    _land(spark, folder, rows[200:] + [("zz", "m", "end", int(t) + s, 900 + s, None) for s in (200, 2000)])
    W.debounce_stream(stream, out, 10_000, watermark="5 seconds")
    batch = spark.createDataFrame([(c, p, op, BASE + dt.timedelta(seconds=s), n, None, None) for c, p, op, s, n, _ in rows], SCHEMA)
    key = lambda df: sorted(map(tuple, df.where("corpus_id is null or corpus_id <> 'zz'").collect()), key=repr)
    got = key(spark.read.parquet(f"{out}/bursts"))
    assert got == key(W.debounce_batch(batch, 10_000)) and 0 < early < len(got)


def _packed(spark, rows):
    """A full pack of what the events leave."""
    last = {}
    for c, p, op, s, n, text in rows:
        if (c, p) not in last or (s, n) > last[c, p][:2]:
            last[c, p] = (s, n, op, text)
    files = [(c, p, v[3]) for (c, p), v in last.items() if v[2] != "unlink"]
    df = spark.createDataFrame(files, "corpus_id string, path string, content string").withColumn("size", F.octet_length("content").cast("long"))
    cols = ["corpus_id", "total_files", "total_size", "tokens", "total_chars", "large_files", "tokens_joined"]
    return sorted((tuple(r) for r in pack(df).summary.select(*cols).collect()), key=repr) if files else []


def test_totals_by_deltas_equal_a_full_pack_after_every_batch(spark):
    rnd = random.Random(5)
    folder, out = tempfile.mkdtemp(prefix="quire-ev-"), tempfile.mkdtemp(prefix="quire-totals-")
    stream = W.stream_changes(spark, folder, spark.createDataFrame([], SCHEMA).schema, max_files_per_trigger=1)
    rows = []
    for batch in range(4):
        new = []
        for n in range(40):
            op = rnd.choice(["add", "change", "change", "unlink"])
            path = rnd.choice(["a.js", "b/c.md", "big.txt", "node_modules/x.js", "d.png", "é.py"])
            text = rnd.choice(["x" * 12000, "é\n" * rnd.randint(0, 30), "", None, "nul\x00"]) if op != "unlink" else None
            new.append((rnd.choice(["A", "B", None]), path, op, rnd.randint(0, 400), batch * 100 + n, text))     # many arrive out of order
        if batch == 2:
            new += [("B", p, "unlink", 500, 990 + i, None) for i, p in enumerate(["a.js", "b/c.md", "big.txt", "node_modules/x.js", "d.png", "é.py"])]
        if batch == 3:
            new = [r for r in new if r[0] != "B"]
        rows += new
        _land(spark, folder, new)
        W.incremental_totals(stream, out).awaitTermination()
        now = W.current_totals(spark, out)
        got = sorted((tuple(r[c] for c in ["corpus_id", "total_files", "total_size", "tokens", "total_chars", "large_files", "tokens_joined"]) for r in now.collect()), key=repr)
        assert got == _packed(spark, rows), batch
        if batch in (0, 1, 2):
            W.fold_totals(spark, out)
            W.fold_totals(spark, out)
    assert len([d for d in os.listdir(f"{out}/deltas") if d.startswith("batch=")]) < 4      # folded batches are removed
    assert "B" not in {r.corpus_id for r in W.current_totals(spark, out).collect()}


def test_a_batch_sends_deltas_of_its_own_files_alone(spark):
    folder, out = tempfile.mkdtemp(prefix="quire-ev-"), tempfile.mkdtemp(prefix="quire-totals-")
    stream = W.stream_changes(spark, folder, spark.createDataFrame([], SCHEMA).schema)
    _land(spark, folder, [("A", f"f{i}.txt", "add", i, i, "four") for i in range(50)])
    W.incremental_totals(stream, out).awaitTermination()
    _land(spark, folder, [("A", "f7.txt", "change", 100, 100, "four more"), ("A", "f8.txt", "unlink", 100, 101, None), ("A", "f9.txt", "change", 0, 0, "older")])
    W.incremental_totals(stream, out).awaitTermination()
    rows = [r for r in spark.read.parquet(f"{out}/deltas").orderBy("batch").collect() if r.present or r.total_size]
    assert [(r.total_files, r.total_size) for r in rows] == [(50, 200), (-1, 5 - 4)]


def test_deltas_need_no_call_for_each_file_and_a_replay_changes_nothing(spark):
    state = tempfile.mkdtemp(prefix="quire-state-")

    def batch(n, rows):
        df = spark.createDataFrame([(c, p, op, BASE + dt.timedelta(seconds=s), q, t, None if t is None else len(t)) for c, p, op, s, q, t in rows], SCHEMA)
        return W.signed_deltas(W.contributions(df), state, n, buckets=4)

    first = [(c, f"f{i}.txt", "add", i, i, "four") for c in ("A", None) for i in range(30)]
    assert batch(0, first).count() == 60
    second = [("A", "f1.txt", "unlink", 100, 100, None), ("A", "f1.txt", "change", 99, 99, "longer"), (None, None, "add", 1, 1, "x"), (None, "f2.txt", "add", 0, 0, "older")]
    for _ in range(2):                        # the second time as a replay
        deltas = batch(1, second)
        assert sorted(((r.corpus_id or "", r.present, r.total_files, r.total_size) for r in deltas.collect())) == [("", 1, 1, 1), ("A", -1, -1, -4)]
    assert "InPandas" not in deltas._jdf.queryExecution().executedPlan().toString()
    for n in range(2, 6):
        assert batch(n, first).count() == 0
    kept = [f for d, _, fs in os.walk(state) for f in fs if f.endswith(".parquet")]
    assert len(kept) <= 2 * 4                 # a bucket's old versions are removed


def _put(root, rel, data):
    p = os.path.join(root, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "wb") as f:
        f.write(data)


def test_a_directory_feeds_its_changes(spark):
    root, state = tempfile.mkdtemp(prefix="quire-tree-"), tempfile.mkdtemp(prefix="quire-feed-")
    _put(root, "p/a.txt", b"one")
    _put(root, "p/.hidden/_x.md", b"two")
    _put(root, "q/b.txt", b"three")
    feed = W.DirectoryFeed(spark, root, state)
    assert feed.poll(BASE) == 3 and feed.poll(BASE + dt.timedelta(seconds=1)) == 0
    _put(root, "p/a.txt", b"one, changed \xff")
    _put(root, "p/new.txt", b"")
    os.remove(f"{root}/q/b.txt")
    # A poll that was cut short after it landed its changes is not landed twice.
    real = type(spark).createDataFrame

    def ends_here(self, data, schema=None, *a, **k):
        if schema == "changes long":
            raise RuntimeError("lost")
        return real(self, data, schema, *a, **k)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(spark), "createDataFrame", ends_here)
        with pytest.raises(RuntimeError):
            W.DirectoryFeed(spark, root, state).poll(BASE + dt.timedelta(seconds=2))
    assert W.DirectoryFeed(spark, root, state).poll(BASE + dt.timedelta(seconds=3)) == 3
    rows = sorted((r.seq, r.corpus_id, r.path, r.op, r.content) for r in spark.read.parquet(feed.changes).collect())
    assert rows == [(1, "p", ".hidden/_x.md", "add", "two"), (1, "p", "a.txt", "add", "one"), (1, "q", "b.txt", "add", "three"),
                    (3, "p", "a.txt", "change", "one, changed �"), (3, "p", "new.txt", "add", ""), (3, "q", "b.txt", "unlink", None)]
    stream = W.stream_changes(spark, f"{feed.changes}/*", W.CHANGES_SCHEMA)
    out = tempfile.mkdtemp(prefix="quire-totals-")
    W.incremental_totals(stream, out).awaitTermination()
    assert {(r.corpus_id, r.total_files, r.total_chars) for r in W.current_totals(spark, out).collect()} == {("p", 3, 3 + len("one, changed �"))}
