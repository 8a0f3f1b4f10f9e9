import hashlib
import math
import random
import re
import string
import time
from collections import Counter

import pytest
from quire.llm import queries
from quire.llm import secret_scan as k

KINDS = ["assign", "access", "hex"]


def base_spans(text):
    out = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return out


def entropy(s):
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def runs(pattern, least, text):
    return [m for m in re.finditer(pattern, text) if len(m[0]) >= least]


def method_spans(text, allow=()):
    out = []

    def add(order, at, run, least):
        covered = set()
        for i in range(len(run) - 19):
            if entropy(run[i:i + 20]) >= least:
                covered |= set(range(i, i + 20))
        for p in covered:
            if p - 1 not in covered:
                e = p
                while e in covered:
                    e += 1
                out.append((at + p, order, at + e))

    for m in runs("[A-Za-z0-9+/_-]+", 20, text):
        s = m[0]
        if s in allow or any(re.search(p, s) for p in k.ALLOW_PATTERNS):
            continue
        if re.search("[^0-9A-Fa-f]", s):
            add(3, m.start(), s, 3.8)
        for h in runs("[0-9A-Fa-f]+", 20, s):
            add(4, m.start() + h.start(), h[0], 3.0)
    return out


def shown(spans):
    return ",".join(f"{[*KINDS, 'entropy_base64', 'entropy_hex'][o]}:{a}:{b}" for a, o, b in sorted(spans))


def brute(text, allow=()):
    text = text or ""
    base = base_spans(text)
    return (*(sum(o == j for _, o, _ in base) for j in range(3)), hashlib.sha256(shown(base).encode()).hexdigest(),
            shown(base + method_spans(text, allow)))


def got(spark, texts, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = k.summary(k.scan(df, **kw)).orderBy("doc_id").collect()
    return [(r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in rows]


def token(rnd, alphabet, n):
    return "".join(rnd.choice(alphabet) for _ in range(n))


def texts(seed):
    rnd = random.Random(seed)
    alnum = string.ascii_letters + string.digits
    out = []
    for _ in range(60):
        parts = []
        for _ in range(rnd.randint(0, 12)):
            parts.append(rnd.choice([
                "word", "Émile 🌍", "\n", "PassWord: ", "api_key='", "apikey =", "secret:", "token=token:", "passwd=\"", "AKIA", "AKIAAKIA",
                "AKIA" + token(rnd, string.ascii_uppercase + string.digits, rnd.randint(10, 30)), token(rnd, "0123456789abcdef", rnd.randint(15, 60)),
                token(rnd, alnum + "+/", rnd.randint(15, 90)), token(rnd, "0123456789ABCDEFabcdef", 30), "a" * 30 + token(rnd, alnum, 40) + "b" * 30 + token(rnd, alnum, 25),
                "longwordlongwordlongword", "12345678901234567890123", "some-slug/of-words_that-is-long", "x" * 25, "6f1e2d3c-1a2b-3c4d-5e6f-0123456789ab"]))
            parts.append(rnd.choice(["", " ", " ", ", ", "=", ":", "é"]))
        out.append("".join(parts))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_as_brute_force(spark, seed):
    t = texts(seed)
    assert got(spark, t) == [brute(x) for x in t]


def test_matches_take_what_they_consume(spark):
    t = ["token:token:abcdefgh", "token=secret=abcdefgh", "TOKEN = \"abc\"", "api_key:   'abcdef'", "apikey=abcdef api__key=abcdef", "tokens: abcdef", "ſecret=abcdef"]
    assert got(spark, t) == [brute(x) for x in t]
    assert [r[0] for r in got(spark, t)] == [0, 1, 0, 1, 1, 0, 0]


def test_allow_list_suppresses_only_the_method(spark):
    s = "dG9rZW4x9Qz7Lk2Pw8Vb4Rt6"
    h = "04dbebab91ab85687d33eeaaf9ac699e"
    assert "entropy_base64" in got(spark, [s])[0][4]
    assert got(spark, [f"password={s} x {h}"], allow=[s, h])[0] == brute(f"password={s} x {h}", [s, h])
    r = got(spark, [f"password={s} x {h}"], allow=[s, h])[0]
    assert r[:3] == (1, 0, 1) and "entropy" not in r[4]


def test_nulls_empties_repeats_and_other_columns(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "token=abcdef", 3), (1, "token=abcdef", 3)], "doc_id long, text string, found int")
    rows = sorted((r.n_assign, r.spans) for r in k.summary(k.scan(df)).collect())
    assert rows == [(0, ""), (0, ""), (1, "assign:0:12"), (1, "assign:0:12")]
    assert k.summary(k.scan(df.limit(0))).count() == 0


def test_long_candidates_go_in_slices(spark):
    rnd = random.Random(9)
    t = ["".join(rnd.choice(["A1b2C3d4E5f6G7h8I9j0", "a" * 21, token(rnd, "0123456789abcdef", 31)]) for _ in range(300)), "🌍" + "0f" * 3000 + token(rnd, "0123456789abcdef", 3000)]
    assert got(spark, t) == [brute(x) for x in t]


def test_very_long_texts(spark):
    rnd = random.Random(3)
    many = " ".join("token=" + token(rnd, string.ascii_lowercase, 8) for _ in range(60_000))
    t = ["token" * 200_000, " " * 3_000_000 + "token=abcdef", many, "f" * 1_000_000, "token" + " " * 2_000_000, "é" * 1_000_000]
    began = time.time()
    r = got(spark, t)
    assert [(x[0], x[2]) for x in r] == [(0, 0), (1, 0), (60_000, 0), (0, 1), (0, 0), (0, 0)]
    assert r[2][3] == brute(many)[3]
    assert time.time() - began < 120


def test_plan_has_no_python_and_no_shuffle(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = k.summary(k.scan(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_registered_query(spark, tmp_path):
    t = texts(7) + [None]
    spark.createDataFrame([(i * 3, x, "n") for i, x in enumerate(t)], "doc_id long, text string, spans string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op12_entropy_secrets(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [(i * 3, *brute(x)) for i, x in enumerate(t)]
