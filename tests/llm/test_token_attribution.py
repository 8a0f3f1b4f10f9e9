import collections

import numpy as np
import pytest
from pyspark.sql import functions as F
from quire.llm import token_attribution as ta

public = pytest.importorskip("public_tokenizers")
PATH, PATTERN = public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN


def char_spans(text):
    """Character spans of the tokens, from the bytes of each."""
    enc = ta.encoder_for(PATH, PATTERN).encoding
    owner = [i for i, c in enumerate(text) for _ in c.encode()]
    out, at = [], 0
    for t in enc.encode_ordinary(text):
        n = len(enc.decode_single_token_bytes(t))
        out.append((owner[at], owner[at + n - 1] + 1))
        at += n
    return out


def brute(text, sections, rule):
    got, gap, crossing = [0.0] * len(sections), 0.0, 0
    for s, e in char_spans(text):
        part = [max(0, min(e, z) - max(s, a)) for a, z in sections]
        gaps, at = [], 0
        for a, z in [*sections, (len(text), len(text))]:
            gaps.append(max(0, min(e, a) - max(s, at)))
            at = max(at, z)
        crossing += sum(p > 0 for p in part + gaps) > 1
        cells = [x for pair in zip(gaps, part) for x in pair] + [gaps[-1]]      # gap, section, gap, ...
        if rule == "share":
            share = [c / (e - s) for c in cells]
        else:
            best = max(range(len(cells)), key=lambda i: (cells[i], -i)) if rule == "largest" else next(i for i, c in enumerate(cells) if c)
            share = [float(i == best) for i in range(len(cells))]
        gap += sum(share[0::2])
        got = [g + x for g, x in zip(got, share[1::2])]
    return got, gap, crossing


TEXTS = ["Hello world, tokenization of naïve words", "日本語🌍 text 🌍🌍", "", "x", "a\nb\n\nccc dd\n", "word " * 5000, "é" * 300]


@pytest.mark.parametrize("rule", ta.RULES)
def test_against_brute_force(spark, rule):
    rnd = np.random.default_rng(5)
    rows = []
    for i, t in enumerate(TEXTS):
        cuts = sorted(rnd.integers(0, len(t) + 1, 6).tolist())
        rows.append((i, t, [("a", cuts[0], cuts[1]), ("b", cuts[1], cuts[2]), (None, cuts[3], cuts[4]), ("d", cuts[4], cuts[4])]))
    df = spark.createDataFrame(rows, "doc_id long, text string, sections array<struct<name:string,start:int,end:int>>").withColumn("tokens", F.lit(1))
    got = collections.defaultdict(list)
    for r in ta.attribute(df, PATH, PATTERN, "sections", rule=rule).collect():
        got[r.doc_id].append(r)
    for i, t, s in rows:
        want, gap, crossing = brute(t, [(a, z) for _, a, z in s], rule)
        inside = [r for r in got[i] if r.char_start is not None]
        outside = [r for r in got[i] if r.char_start is None]
        assert [(r.section, r.char_start, r.char_end) for r in inside] == [tuple(x) for x in s]
        assert np.allclose([r.tokens for r in inside], want)
        assert np.isclose(sum(r.tokens for r in outside), gap) and len(outside) == (gap > 0)
        n = len(char_spans(t))
        assert {(r.crossing, r.doc_tokens) for r in got[i]} == {(crossing, n)}
        assert np.isclose(sum(r.tokens for r in got[i]), n)


def test_lines_and_edge_rows(spark):
    rows = [(1, "one two\nthree\n"), (2, None), (3, ""), (None, "x"), (5, "\n"), (5, "\n")]
    got = [(r.doc_id, r.section, r.char_start, r.char_end, r.tokens) for r in
           ta.attribute(spark.createDataFrame(rows, "doc_id long, text string"), PATH, PATTERN).collect()]
    assert sorted((g[:4] for g in got), key=repr) == sorted([(1, "0", 0, 8), (1, "1", 8, 14), (None, "0", 0, 1), (5, "0", 0, 1), (5, "0", 0, 1)], key=repr)
    assert all(g[4] > 0 for g in got)
    assert ta.attribute(spark.createDataFrame([], "doc_id long, text string"), PATH, PATTERN).count() == 0


def test_null_sections_are_a_gap_and_bad_ones_fail(spark):
    kind = "doc_id long, text string, sections array<struct<name:string,start:int,end:int>>"
    r = ta.attribute(spark.createDataFrame([(1, "a b c", None)], kind), PATH, PATTERN, "sections").collect()
    assert [(x.section, x.tokens) for x in r] == [(None, 3.0)]
    with pytest.raises(Exception, match="ascending"):
        ta.attribute(spark.createDataFrame([(1, "abc", [("a", 1, 2), ("b", 0, 1)])], kind), PATH, PATTERN, "sections").collect()


def test_fields(spark):
    df = spark.createDataFrame([(1, "Title", None, "The body"), (2, None, None, None)], "doc_id long, title string, note string, body string")
    text, sections = ta.field_sections(["title", "note", "body"], " | ")
    out = ta.attribute(df.select("doc_id", text.alias("text"), sections.alias("sections")), PATH, PATTERN, "sections").collect()
    one = {r.section: (r.char_start, r.char_end) for r in out if r.doc_id == 1}
    assert one == {"title": (0, 5), "note": (8, 8), "body": (11, 19), None: (None, None)}
    assert sum(r.tokens for r in out if r.doc_id == 1) == out[0].doc_tokens


def test_the_query_counts_empty_documents(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    from quire.llm.queries import op1_offset_attribution
    spark.createDataFrame([(1, None), (2, ""), (3, "a b " * 200)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.section, r.char_start, r.char_end, r.tokens > 0) for r in op1_offset_attribution(spark, str(tmp_path)).collect())
    assert got == [(1, "0", 0, 0, False), (2, "0", 0, 0, False), (3, "0", 0, 500, True), (3, "1", 500, 800, True)]


def test_very_long_runs_are_encoded(spark):
    import public_tokenizers
    e = ta.encoder_for(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    for text in (" " * 5_000_000, "\n" * 5_000_000, "ab" * 2_500_000, "!?" * 2_500_000, "a" + " \t\u3000" * 50_000 + "b", " " * 20_001 + "\nx " + " " * 10_001):
        ids = e.ids(text)
        assert e.encoding.decode(ids.tolist()) == text
    for n in (10_000, 10_001, 10_002, 60_000):       # runs that the pattern itself can read give the same ids
        for text in ("a" + " " * n + "b c", "a" + "\n" * n + "b", " " * n, "x" + "\u2003" * n + ".", "a" + " " * n + "\n", "\x1c" * n + "z"):
            assert e.ids(text).tolist() == e.encoding.encode_ordinary(text)
