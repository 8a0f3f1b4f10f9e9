import random
import re

import numpy as np
import pytest
from quire.llm import jaccard_join as jj
from quire.llm.graph import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, size=5):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(w) >= size:
        return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)}
    return {tuple(w)} if w else set()


def brute(docs, size=5, percent=75):
    sets = [shingle_set(t, size) for _, t in docs]
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    out = []
    for i, (d, _) in enumerate(docs):
        ids = [docs[j][0] for j in range(len(docs)) if label[j] == label[i] and docs[j][0] is not None]
        out.append((d, len(sets[i]), (min(ids) if ids else None) if sets[i] else d))
    return sorted(out, key=repr)


def got(spark, docs, **kw):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    return sorted([tuple(r) for r in jj.jaccard_components(df, **kw).collect()], key=repr)


def family_docs(seed, families=4, members=14):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    passage = [rnd.choice(vocab) for _ in range(30)]
    docs, n = [], 0
    for _ in range(families):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([12, 40, 70]))] + passage * rnd.randint(0, 1)
        for _ in range(members):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 3, 5])):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            if rnd.random() < 0.3:
                w = w[: int(len(w) * rnd.choice([0.6, 0.8, 0.9]))]
            docs.append((n, " ".join(w)))
            n += 1
    rnd.shuffle(docs)
    return docs


EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE\ttwo"), (5, "one two"), (6, "one"),
        (None, "a b c d e f g h i j"), (8, "A b c d e f g h i j"), (None, None), (None, "only without id"),
        (9, "z " * 20000), (10, "z\n" * 300), (11, "é é É x y"), (12, "a b c d e f g h i j k")]


def test_edge_cases(spark):
    assert got(spark, EDGE) == brute(EDGE)


@pytest.mark.parametrize("part", [1 << 20, 150])
def test_families_against_brute_force(spark, part):
    docs = family_docs(1)
    assert got(spark, docs, part=part) == brute(docs)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_other_columns_are_ignored(spark):
    df = spark.createDataFrame([(1, "a b c", 5, 6, 7)], "id long, body string, key int, n int, component_id int")
    assert [tuple(r) for r in jj.jaccard_components(df, "id", "body").collect()] == [(1, 1, 1)]


@pytest.mark.parametrize("seed", range(30))
def test_divide_skip_finds_every_link(seed):
    docs = family_docs(seed, families=5, members=9)
    sets = [sorted(hash(x) & 0xFFFFFFFF for x in shingle_set(t)) for _, t in docs]
    n = np.array([len(s) for s in sets])
    flat = np.array([x for s in sets for x in s], dtype=np.uint64)
    keys = np.arange(len(sets))

    def classes(links):
        label = list(range(len(sets)))
        for a, b in links:
            x, y = label[a], label[b]
            label = [y if z == x else z for z in label]
        return {tuple(i for i in range(len(label)) if label[i] == z) for z in label}

    true = [(i, j) for i in range(len(sets)) for j in range(i)
            if (o := len(set(sets[i]) & set(sets[j]))) and 100 * o >= 75 * (n[i] + n[j] - o)]
    part = jj.Part(keys, keys, n, flat, 75)
    part.search_all()
    assert set(part.links) <= {x for a, b in true for x in ((a, b), (b, a))}
    assert classes(part.links) == classes(true)
    half = len(sets) // 2                    # the same as queries against an index of one half
    part = jj.Part(keys[:half], keys[:half], n[:half], flat[: n[:half].sum()], 75)
    part.search_all()
    links = list(part.links)
    index = jj.Part(keys[:half], keys[:half], n[:half], flat[: n[:half].sum()], 75)
    for i in range(half, len(sets)):
        index.query(i, i, np.array(sets[i], dtype=np.uint64))
    rest = [(a, b) for a, b in true if a >= half and b >= half]
    assert classes(links + index.links + rest) == classes(true)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(200, 260)] + [(7, 7)]
    df = spark.createDataFrame(edges, "u long, v long")
    label = dict(tuple(r) for r in connected_components(df).collect())
    assert {label[i] for i in range(61)} == {0}
    assert {label[i] for i in [100, *range(200, 260)]} == {100}


def test_a_pack_has_no_more_classes_than_numbers(spark):
    # Texts of some 300 bytes, then a large block of short ones, in one batch of one task; each shares all its shingles with another task's text.
    texts = [" ".join(f"{i:x}{c}{'x' * 18 if i < 55_500 else ''}" for c in "abcdefghijkl") for i in range(72_000)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 28))
    try:
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
        both = docs.unionByName(docs.selectExpr("doc_id", "concat(text, ' more') AS text"))
        counts = jj._shared_counts(both, jj.SIZE, 1)
        classes = jj._scan(docs, jj.SIZE).where("half > 0")
        assert classes.join(counts, "key", "left").where("c IS NULL OR c <> half").count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old[0])
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", old[1])


def test_words_that_differ_by_the_thue_morse_rule_do_not_link(spark):
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    docs = [(1, " ".join([word] * 6)), (2, " ".join([other] * 6)), (3, word), (4, other), (5, word)]
    assert got(spark, docs) == [(1, 1, 1), (2, 1, 2), (3, 1, 3), (4, 1, 4), (5, 1, 3)]


def test_long_words_hash_by_all_their_bytes():
    from quire.llm.words import SPACED, words
    base = "x" * 700
    all_words = [base, *[base[:i] + "y" + base[i + 1:] for i in range(700)], base + "x", "x" * 256, "x" * 257, "x" * 8, "x" * 9]
    raw = " ".join(all_words + [w.upper() for w in all_words]).encode()
    h = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), SPACED).hash
    n = len(all_words)
    assert len(set(h[:n].tolist())) == n and np.array_equal(h[:n], h[n:])


@pytest.mark.parametrize("work", [1, 4000])
def test_parts_bounded_by_work_find_the_same(spark, monkeypatch, work):
    monkeypatch.setattr(jj, "WORK", work)
    docs = family_docs(5)
    assert got(spark, docs) == brute(docs)


def test_components_of_more_edges_than_a_task_contracts(spark, monkeypatch):
    from quire.llm import graph
    monkeypatch.setattr(graph, "EDGES_PER_TASK", 20)
    rnd = random.Random(4)
    edges = [(rnd.randint(0, 400), rnd.randint(0, 400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)]
    least = {}

    def find(x):
        while least.setdefault(x, x) != x:
            x = least[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        least[b] = a
    rows = connected_components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()
    assert {r.node: r.component for r in rows} == {x: find(x) for u, v in edges if u != v for x in (u, v)}
