"""Ordered scan under skew against a window; next-fit and drop by their defining properties."""
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators.optimize import drop_low_priority
from quire.operators.ordered import ordered_scan
from quire.operators.split import chunks_by_files, chunks_by_key, chunks_by_tokens, with_overlap, split_stats, chunk_stats


def window_scan(df, key, order, sums):
    """The same ranks and sums with one window per key."""
    w = Window.partitionBy(key).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select("*", F.row_number().over(w).alias("pos"), *[F.sum(c).over(run).alias(f"cum_{c}") for c in sums])


def test_ordered_scan_hot_key(spark):
    rnd = random.Random(3)
    rows = [("hot" if i % 3 == 0 else f"k{rnd.randint(0, 40)}", i, rnd.randint(0, 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    a = {(r.k, r.o): (r.pos, r.cum_v) for r in ordered_scan(df, "k", [F.col("o").desc()], ["v"], num_slices=13).collect()}
    b = {(r.k, r.o): (r.pos, r.cum_v) for r in window_scan(df, "k", [F.col("o").desc()], ["v"]).collect()}
    assert a == b


def assert_next_fit(rows, limit):
    """``rows`` of ``(corpus, pos, tokens, chunk)``: the properties that fix the
    chunks.  Chunks are numbered runs in order; a file over the limit is alone;
    other chunks keep the limit; and no chunk could have taken the file that
    follows it."""
    by = {}
    for corpus, pos, tokens, chunk in sorted(rows):
        by.setdefault(corpus, {}).setdefault(chunk, []).append((pos, tokens))
    for chunks in by.values():
        assert list(chunks) == list(range(1, len(chunks) + 1))
        flat = [x for c in chunks.values() for x in c]
        assert [p for p, _ in flat] == list(range(1, len(flat) + 1))
        runs = list(chunks.values())
        for run, after in zip(runs, runs[1:] + [None]):
            total = sum(t for _, t in run)
            alone = len(run) == 1 and total > limit
            assert alone or total <= limit
            if after is not None:
                assert alone or after[0][1] > limit or total + after[0][1] > limit


def test_next_fit(spark):
    rnd = random.Random(5)
    rows = [(f"c{c}", i + 1, rnd.choice([0, 1, 5, 20, 40, 95, 120])) for c in range(6) for i in range(rnd.randint(1, 400))]
    df = spark.createDataFrame(rows, "corpus_id string, pos long, tokens long")
    got = [(r.corpus_id, r.pos, r.tokens, r.chunk) for r in chunks_by_tokens(df, 100).collect()]
    assert sorted(g[:3] for g in got) == sorted(rows)
    assert_next_fit(got, 100)


def model_overlap(chunks, k):
    out = [list(chunks[0])] if chunks else []
    for i in range(1, len(chunks)):
        prev = out[i - 1]
        head = prev[-k:] if k else prev[:]
        out.append(head + list(chunks[i]))
    return out


def test_overlap_closed_form(spark):
    rnd = random.Random(11)
    for k in (0, 1, 2, 7):
        rows, chunks_model = [], {}
        for c in range(4):
            n = rnd.randint(1, 30)
            d = [rnd.choice(["a", "b", "c", "d"]) for _ in range(n)]
            for i in range(n):
                rows.append((f"c{c}", f"{d[i]}/f{i}", i + 1, 1, 1, 1))
            groups = {}
            for i in range(n):
                groups.setdefault(d[i], []).append(f"{d[i]}/f{i}")
            chunks_model[f"c{c}"] = model_overlap(list(groups.values()), k)
        df = spark.createDataFrame(rows, "corpus_id string, path string, pos long, tokens long, size long, len long")
        ch = chunks_by_key(df, F.split("path", "/")[0])
        got = {}
        for r in with_overlap(ch, k).collect():
            got.setdefault((r.corpus_id, r.chunk), []).append((r.q, r.is_overlap, r.path))
        for c, chunks in chunks_model.items():
            for i, files in enumerate(chunks, 1):
                assert [p for _, _, p in sorted(got[(c, i)], key=lambda x: (x[0], not x[1]))] == files


def test_drop_low_priority(spark):
    rnd = random.Random(2)
    rows = []
    for c in range(5):
        limit = rnd.randint(0, 4000)
        rows += [(f"c{c}", f"f{i}", i + 1, rnd.choice([0, 2, 100, 150, 200]), rnd.randint(0, 500), limit) for i in range(rnd.randint(1, 60))]
    df = spark.createDataFrame(rows, "corpus_id string, path string, pos long, priority int, len long, lim long")
    tokens = lambda lens: -(-(sum(lens) + max(len(lens) - 1, 0)) // 4)
    for c, limit in sorted({(r[0], r[-1]) for r in rows}):
        got = drop_low_priority(df.where((F.col("corpus_id") == c)), limit).collect()
        order = sorted(got, key=lambda r: (-r.priority, r.pos))       # least important first
        n = sum(r.dropped for r in order)
        assert [r.dropped for r in order] == [True] * n + [False] * (len(order) - n)
        lens = [r.len for r in order]
        assert tokens(lens[n:]) <= limit or n == len(order)           # enough is dropped,
        assert n == 0 or tokens(lens[n - 1:]) > limit                 # and not a file more


def test_split_stats_by_files(spark):
    rows = [("c", f"f{i}", i, 10 * i, i, i) for i in range(1, 46)]
    df = spark.createDataFrame(rows, "corpus_id string, path string, pos long, tokens long, size long, len long")
    ch = chunks_by_files(df, 20).withColumn("q", F.col("pos")).withColumn("is_overlap", F.lit(False))
    summary = spark.createDataFrame([("c", 45)], "corpus_id string, total_files long")
    st = split_stats(chunk_stats(ch), summary).first()
    assert (st.total_chunks, st.total_tokens, st.max_tokens_in_chunk, st.min_tokens_in_chunk) == (3, 10350, 6100, 2100)
    assert st.avg_tokens_per_chunk == 3450


def test_next_fit_sliced_hot_corpus(spark):
    from quire.operators.nextfit import chunks_by_tokens_sliced
    rnd = random.Random(12)
    for trial in range(4):
        limit = rnd.choice([1, 10, 100, 1000])
        sizes = [0, 0, 1, 3, limit // 3 + 1, limit // 2, limit, limit + 1, 7 * limit]
        rows = [(f"c{c}", i + 1, rnd.choice(sizes)) for c in range(5) for i in range(3000 if c == 0 else rnd.randint(1, 200))]
        df = spark.createDataFrame(rows, "corpus_id string, pos long, tokens long")
        got = [(r.corpus_id, r.pos, r.tokens, r.chunk) for r in chunks_by_tokens_sliced(df, limit, num_slices=17).collect()]
        assert sorted(g[:3] for g in got) == sorted(rows)
        assert_next_fit(got, limit)


def test_ordered_scan_null_key(spark):
    rows = [(None if i % 2 else "k", i, i % 5) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    a = {(r.k, r.o): (r.pos, r.cum_v) for r in ordered_scan(df, "k", [F.col("o")], ["v"], num_slices=7).collect()}
    b = {(r.k, r.o): (r.pos, r.cum_v) for r in window_scan(df, "k", [F.col("o")], ["v"]).collect()}
    assert a == b


def test_next_fit_equal_one_token_files(spark):
    """Every entry state leads to other boundaries: the longest summaries."""
    df = spark.range(60_000).selectExpr("'c' AS corpus_id", "id + 1 AS pos", "1L AS tokens")
    from quire.operators.nextfit import chunks_by_tokens_sliced
    got = chunks_by_tokens_sliced(df, 7001, num_slices=9)
    assert got.where("chunk <> floor((pos - 1) / 7001) + 1").count() == 0 and got.count() == 60_000
