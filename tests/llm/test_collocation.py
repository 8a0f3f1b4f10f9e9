import random
import re
from collections import Counter

import numpy as np
import pytest
from quire.llm import collocation as k
from quire.llm import queries

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, support, top):
    """From the contract's words: rows of (text, lang)."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            lang = lang if lang is not None else "und"
            n[lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i:i + m])] += 1
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= support}
    gone = {(lang, q[i:i + m]) for (lang, q), a in candidates.items() for m in range(2, len(q)) for i in range(len(q) - m + 1)
            if 100 * a >= 80 * f[lang, q[i:i + m]]}
    out = {}
    for (lang, p), a in candidates.items():
        if (lang, p) not in gone:
            cuts = [(2000000 * a // (f[lang, p[:c]] + f[lang, p[c:]]), c) for c in range(1, len(p))]
            score, c = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:c]], f[lang, p[c:]]))
    return sorted((lang, i, p.decode(), -a, x, y, n[lang], -s) for lang, ps in out.items()
                  for i, (s, a, p, x, y) in enumerate(sorted(ps)[:top], 1))


def texts(seed, n=120):
    rnd = random.Random(seed)
    vocabulary = ["the", "Of", "and", "ß", "Émile", "x1", "a-b", "'s"]
    phrase = ["New York city hall", "in spite of", "a b a b a b", "x x x x x x"]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rnd.randint(0, 40)):
            parts.append(rnd.choice(vocabulary if rnd.random() < .6 else phrase))
            parts.append(rnd.choice([" ", " ", "  ", "\t", ", ", ".\n", "\x0b", "!?"]))
        out.append(("".join(parts), rnd.choice(["en", "en", "de", None, "und"])))
    return out


def got(spark, rows, **kw):
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    return sorted(tuple(r) for r in k.mine(df, **kw).collect())


@pytest.mark.parametrize("seed,support,top,block", [(1, 3, 2000, 1 << 20), (2, 30, 2000, 300), (3, 2, 7, 40)])
def test_as_brute_force(spark, seed, support, top, block):
    rows = texts(seed)
    assert got(spark, rows, support=support, top=top, block=block) == brute(rows, support, top)


def test_a_long_text_without_a_break_is_cut_without_loss(spark):
    rnd = random.Random(5)
    rows = [(" ".join(rnd.choice("abc") * rnd.randint(1, 3) for _ in range(4000)), "en"), ("q" * 5000 + " z" * 50, "en")]
    assert got(spark, rows, support=30, block=256) == brute(rows, 30, 2000)


def test_nulls_empties_repeats_and_other_columns(spark):
    rows = [(None, None), ("", "en"), (" .,\n", "en")] + [("same old Story. same old", None)] * 40
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, n int, word string")
    assert sorted(tuple(r) for r in k.mine(df).collect()) == brute(rows, 30, 2000)
    assert brute(rows, 30, 2000)[0][:4] == ("und", 1, "same old", 80)
    assert got(spark, [("a b", "en")]) == [] and got(spark, []) == []


def test_equal_scores_go_by_count_then_bytes(spark):
    rows = [("p q. é f. z y", "en")] * 30 + [("m n", "en")] * 31
    assert [r[2] for r in got(spark, rows)] == ["m n", "p q", "z y", "é f"]


def test_scores_pass_64_bits(spark):
    a = 9_000_000_000_000_000
    df = spark.createDataFrame([(a, [a + 1, a], [a + 3, a])], "f long, heads array<long>, tails array<long>")
    r = k._scored(df, 2).select("cut.*").first()
    assert (r.score, r.l, r.r) == (2000000 * a // (2 * a + 4), a + 1, a + 3)


def test_cuts_cover_a_text_once():
    data = np.frombuffer(b"aa bb. cc dd ee ff gg hh iiiiiiiiiiiiiiiiiiiii j", np.uint8)
    for limit in range(1, 60):
        runs = list(k._cuts(data, limit))
        assert [r[0] for r in runs] == [0, *[r[1] for r in runs[:-1]]] and runs[-1][1:] == (len(data), len(data))


def test_registered_query(spark, tmp_path):
    rows = [("Foo Bar baz. foo bar", "en")] * 35
    spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op11_setm_collocations(spark, str(tmp_path))
    assert sorted(tuple(r) for r in out.collect()) == brute(rows, 30, 2000)


def test_many_small_buckets(spark):
    rows = texts(8)
    assert got(spark, rows, support=2, block=200, bucket_groups=50) == brute(rows, 2, 2000)
