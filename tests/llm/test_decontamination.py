import hashlib
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from quire.llm.decontamination import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def folded(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def brute(docs, items, size=13):
    wins = {}
    for item, text in items:
        w = folded(text)
        m = min(size, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            wins.setdefault(tuple(w[i:i + m]), set()).add("null" if item is None else str(item))
    out = []
    for d, text in docs:
        w = folded(text)
        hit, ids = set(), set()
        for key, who in wins.items():
            for i in range(len(w) - len(key) + 1):
                if tuple(w[i:i + len(key)]) == key:
                    hit.update(range(i, i + len(key)))
                    ids |= who
        x = sorted(ids)
        out.append((d, len(w), len(hit), len(x), hashlib.sha256(",".join(x).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def got(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return sorted([tuple(r) for r in decontaminate(d, b, **kw).select(*cols).collect()], key=repr)


ITEM = "Alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho"
ITEMS = [(1, ITEM), (2, "short Item"), (3, "x"), (10, "the the the the the the the the the the the the the the"),
         (4, None), (5, ""), (6, "!!! ..."), (None, "naïve café ÉCOLE"), (1, "second text of item one")]
DOCS = [(1, "pre " + ITEM.upper() + " post"), (2, "pre " + ITEM[:60]), (3, "a SHORT, item! short-item"), (4, None), (5, ""),
        (6, "the " * 40), (7, "x"), (7, "x"), (None, "naïve café École"), (8, "naïve café école"),
        (9, ("filler " * 3000) + "second text of item one " + "tail " * 3000), (10, "y" * 300000 + " x")]


def test_against_brute_force(spark):
    assert got(spark, DOCS, ITEMS) == brute(DOCS, ITEMS)


def test_benchmark_in_blocks_gives_the_same(spark):
    assert got(spark, DOCS, ITEMS, block_bytes=64) == brute(DOCS, ITEMS)


def test_empty_tables(spark):
    assert got(spark, [], ITEMS) == []
    assert got(spark, DOCS, []) == brute(DOCS, [])


def test_clashing_columns_are_replaced(spark):
    d = spark.createDataFrame([(1, "x", 7, "k")], "doc_id long, text string, N_WORDS long, extra string")
    b = spark.createDataFrame([(3, "x", 1)], "item_id long, text string, n_hit int")
    r = decontaminate(d, b).first()
    assert (r.n_words, r.n_hit, r.extra, r.hit_spans) == (1, 1, "k", [[0, 1]])


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("aAb é-", max_size=60), max_size=5), st.lists(st.text("aAb é-", max_size=40), max_size=4))
def test_random_texts(spark, texts, items):
    docs, bench = list(enumerate(texts)), list(enumerate(items))
    assert got(spark, docs, bench, window=3, q=2) == brute(docs, bench, 3)


def test_repeated_items_stay_within_the_block_bound(spark):
    from quire.llm.decontamination import _benchmark_blocks
    items = [(i, ITEM) for i in range(2000)] + [(7000, "another text of the benchmark")]
    b = spark.createDataFrame(items, "item_id long, text string").repartition(5)
    blocks = list(_benchmark_blocks(b, "item_id", "text", 20_000, 300))
    sizes = [sum(len(t) + 64 + sum(len(i) + 8 for i in ids) for ids, t in x) for x in blocks]
    assert len([x for x in blocks if x]) <= 4 and max(sizes) <= 2 * 20_000
    assert sorted(i for x in blocks for ids, _ in x for i in ids) == sorted(str(i) for i, _ in items)
    docs = [(1, "pre " + ITEM), (2, "nothing of it"), (3, "another text of the benchmark")]
    assert got(spark, docs, items, block_bytes=20_000) == brute(docs, items)
