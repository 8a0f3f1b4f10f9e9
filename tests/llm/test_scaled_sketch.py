import random

import pytest
from pyspark.sql import functions as F
from quire.llm import scaled_sketch as k


def shingles(text):
    w = (text or "").lower().split()
    return [tuple(w[i:i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else ([tuple(w)] if w else [])


def docs(n=60, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        out.append((i * 7 - 100, " ".join(rnd.choice("abcdefgh") + str(rnd.randint(0, 60)) for _ in range(rnd.choice([3, 30, 400])))))
    return out + [(1000, None), (1001, ""), (1002, " \n"), (1003, "ÄÖ 🌍 x"), (1004, "word " * 30000), (1005, "é" * 9), (None, "no id here at all")]


def jaccard(a, b):
    a, b = set(shingles(a)), set(shingles(b))
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("parts", [1, 9, 300])
def test_edits_and_exact_likeness_of_whole_sketches(spark, parts):
    rows = docs()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS next", "2 AS k").repartition(5)
    out = k.fingerprints_of_edits(df, fraction=1.0, parts=parts)
    got = {r.doc_id: r for r in out.select("doc_id", "n_chars", "edited", k.likeness(F.col("own"), F.col("edited_own")).alias("e"),
                                           k.likeness(F.col("own"), F.col("next_own")).alias("n")).collect()}
    assert len(got) == len(rows)
    for i, (d, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        m = len(text) // 4
        edited = text[:len(text) - m] + after[:m]
        r = got[d]
        assert (r.n_chars, r.edited) == (len(text), edited), d
        assert abs(r.e - jaccard(text, edited)) < 1e-9 and abs(r.n - jaccard(text, after)) < 1e-9, d


def test_sketch_is_the_part_below_the_bound_and_merges(spark):
    a = " ".join(f"w{i}" for i in range(3000))
    b = a + " " + " ".join(f"v{i}" for i in range(9000))
    df = spark.createDataFrame([(a, b)], "a string, b string")
    full, part = (lambda c: k.sketch(F.col(c), fraction=1.0)), (lambda c: k.sketch(F.col(c)))
    r = df.select(full("a").alias("fa"), part("a").alias("a"), part("b").alias("b"), k.containment(part("a"), part("b")).alias("ab"),
                  k.containment(part("b"), part("a")).alias("ba"), k.merged(part("a"), part("b")).alias("m")).first()
    bound = -(1 << 63) + (1 << 62)
    assert list(r.a.hashes) == [x for x in r.fa.hashes if x < bound] and r.fa.n == 2996
    assert r.m == sorted(set(r.a.hashes) | set(r.b.hashes))
    assert r.ab == 1.0 and abs(r.ba - 2996 / 11996) < 0.04
    assert abs(len(r.a.hashes) / 2996 - 0.25) < 0.04


def test_equal_texts_have_equal_fingerprints_and_short_ones_differ(spark):
    texts = ["a b c d e f", "A  b\nc d e f", "x", "y", "", None, "  "]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    p = [r.p for r in df.select("i", k.printed(k.sketch(F.col("t"))).alias("p")).orderBy("i").collect()]
    assert p[0] == p[1] and p[2] != p[3] and p[4] == p[5] == p[6]
    s = k.sketch(F.lit("x"))
    assert df.select(k.likeness(k.sketch(F.col("t")), s).alias("l"), "i").orderBy("i").collect()[2].l == 1.0
    assert df.select(k.likeness(k.sketch(F.col("t")), s).alias("l"), "i").orderBy("i").collect()[3].l == 0.0


def test_repeated_ids_and_small_tables(spark):
    one = k.fingerprints_of_edits(spark.createDataFrame([(4, "abcdefgh")], "doc_id long, text string")).first()
    assert one.edited == "abcdefab"
    same = k.fingerprints_of_edits(spark.createDataFrame([(1, "aaaa"), (1, "bbbb"), (1, "aaaa"), (2, "cccc")], "doc_id long, text string"), parts=3)
    assert same.count() == 4
    assert k.fingerprints_of_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0




def test_a_printed_fingerprint_has_whole_hashes(spark):
    s = k.sketch(F.lit(" ".join(map(str, range(60)))), fraction=0.25)
    r = spark.range(1).select(s["hashes"].alias("h"), k.printed(s).alias("p")).first()
    tail = r.p.split("-")[-1]
    assert r.h and [int(tail[i:i + 16], 16) for i in range(0, len(tail), 16)] == [x % (1 << 64) for x in r.h]


@pytest.mark.parametrize("kind,ids", [
    ("string", ["doc-0007", "doc-0010", "doc-01", "doc-0100", "doc-é", "doc-", None]), ("double", [-2.5, -2.25, 0.0, 1e300, 7.0, None]),
    ("decimal(30,2)", ["-1.50", "2.25", "2.50", "99999999999999999999.10"]), ("date", ["2024-01-02", "2023-12-31", "2024-01-01"])])
@pytest.mark.parametrize("parts", [1, 4])
def test_ids_of_other_types(spark, kind, ids, parts):
    rows = [(None if i is None else str(i), f"text of {i}") for i in ids]
    df = spark.createDataFrame(rows, "doc_id string, text string").withColumn("doc_id", F.col("doc_id").cast(kind)).repartition(3)
    order = [r.text for r in df.orderBy("doc_id").collect()]
    got = {r.text: r.next.text for r in k.with_next(df, parts=parts).collect()}
    assert got == {t: order[(i + 1) % len(order)] for i, t in enumerate(order)}
