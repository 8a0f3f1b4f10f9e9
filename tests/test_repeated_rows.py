"""Tables that list a path twice or lack corpus names: every step sees the same rows."""
import pytest
from pyspark.sql import functions as F

from quire import api
from quire.operators import optimize as O
from quire.operators import pack as P
from quire.operators import split as S
from quire.operators import tree as T
from quire.operators.filters import select_files
from tests.conftest import files_df

ROWS = [("A", "a.js", "x"), ("A", "a.js", "yy"), ("A", "a.js", "x"), ("A", "d/b.md", "text\n" * 30), (None, "b.js", "zzz"), (None, "d/c.md", "w\n" * 40),
        ("B", "only.py", "q = 1\n")]


def by_corpus(df, *cols):
    out = {}
    for r in df.collect():
        out.setdefault(r.corpus_id, []).append(tuple(r[c] for c in cols))
    return {k: sorted(v, key=repr) for k, v in out.items()}


WANT = {"A": [("a.js", "x"), ("a.js", "x"), ("a.js", "yy"), ("d/b.md", "text\n" * 30)], None: [("b.js", "zzz"), ("d/c.md", "w\n" * 40)], "B": [("only.py", "q = 1\n")]}
COUNTS = {k: len(v) for k, v in WANT.items()}


def test_pack_and_content(spark):
    p = api.pack(files_df(spark, ROWS))
    assert {r.corpus_id: r.total_files for r in p.summary.collect()} == COUNTS
    assert by_corpus(p.files, "pos") == {k: [(i + 1,) for i in range(n)] for k, n in COUNTS.items()}
    assert by_corpus(p.with_content(), "path", "content") == WANT


def test_one_copy_of_a_very_often_repeated_row_is_joined(spark):
    rows = [("A", "a.js", "same")] * 500 + [("A", "b.js", "once")]
    p = api.pack(files_df(spark, rows).repartition(7))
    c = p.with_content()
    assert c.count() == 501 and c.select("pos").distinct().count() == 501 and c.where("content = 'same'").count() == 500


def test_optimize(spark):
    p = api.pack(files_df(spark, ROWS))
    o = api.optimize(p, target_tokens=20)
    assert {r.corpus_id: r["count"] for r in o.groupBy("corpus_id").count().collect()} == COUNTS
    s = {r.corpus_id: (r.files + r.dropped_files, r.final_tokens <= 20) for r in O.optimize_summary(o, p.summary).collect()}
    assert s == {k: (n, True) for k, n in COUNTS.items()}
    kept = by_corpus(api.optimize(p, target_tokens=1000, remove_comments_=False, remove_empty_lines_=False), "path", "content")
    assert kept == WANT
    assert {r.corpus_id for r in O.dropped_preview(o).collect()} <= set(COUNTS)


def test_optimize_folds_a_corpus_without_a_name_over_slices(spark):
    rows = [(None, f"f{i}.txt", "line of text\n" * (i % 17 + 3)) for i in range(120)] + [("A", f"f{i}.txt", "line\n" * 9) for i in range(60)]
    o = api.optimize(api.pack(files_df(spark, rows)), target_tokens=900)
    s = {r.corpus_id: (r.n, r.t) for r in o.where("not dropped").groupBy("corpus_id").agg(F.count("*").alias("n"), F.sum("len").alias("t")).collect()}
    assert set(s) == {None, "A"} and all((t + n - 1) / 4 <= 900 for n, t in s.values())
    assert o.count() == 180


@pytest.mark.parametrize("fmt", ["markdown", "xml", "plain", "json"])
def test_documents(spark, fmt):
    docs = {r.corpus_id: r.document for r in api.format(api.pack(files_df(spark, ROWS)), fmt).collect()}
    assert set(docs) == set(COUNTS)
    for k, rows in WANT.items():
        assert all(docs[k].count(name) >= 1 and (c.split("\n")[0] in docs[k]) for name, c in rows)
        assert ("only.py" in docs[k]) == (k == "B")


def test_tree_and_selection(spark):
    files = files_df(spark, ROWS)
    tree = {r.corpus_id: r.tree for r in api.get_file_tree(files).collect()}
    assert tree == {"A": "├── a.js\n└── d/\n    └── b.md\n", None: "├── b.js\n└── d/\n    └── c.md\n", "B": "└── only.py\n"}
    ruled = files_df(spark, ROWS + [(None, ".gitignore", "*.md\n")])
    assert by_corpus(select_files(ruled), "path") == by_corpus(P.pack(ruled).files, "path")
    assert by_corpus(select_files(ruled), "path")[None] == [("b.js",)]
    assert {r.tree for r in T.tree_text(T.tree_lines(ruled)).where("corpus_id is null").collect()} == {"├── b.js\n└── d/\n"}


@pytest.mark.parametrize("strategy", ["by_tokens", "by_files", "by_directory", "by_type"])
def test_split(spark, strategy):
    p = api.pack(files_df(spark, ROWS))
    s = S.split_context(p.files, strategy, max_tokens_per_chunk=5, max_files_per_chunk=2, overlap=True, overlap_files=1)
    own = s.where("not is_overlap")
    assert {r.corpus_id: r["count"] for r in own.groupBy("corpus_id").count().collect()} == COUNTS
    assert by_corpus(p.attach(own), "path", "content") == WANT
    stats = S.chunk_stats(s)
    assert {r.corpus_id for r in S.split_stats(stats, p.summary).where("total_chunks > 0").collect()} == set(COUNTS)
    assert {r.corpus_id for r in S.chunk_listing(s).collect()} == set(COUNTS)
