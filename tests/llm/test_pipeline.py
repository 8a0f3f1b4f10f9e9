import collections

import corpus_pipeline as cp
import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
COLS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n):
    rnd = np.random.default_rng(seed)
    return " ".join("".join(rnd.choice(list("abcdeimnorst"), rnd.integers(2, 9))) for _ in range(n))


BENCH = words(10_000, 30)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows, labels = [], []
    for i in range(240):
        text = words(i, 60)
        if i % 6 == 0:
            text = text.upper().replace(" ", "!! ")
        rows.append((i, text))
        if i % 3 == 0 or i % 2:
            labels.append((i, int(i % 6 != 0)))
    rows += [(300, rows[7][1]), (301, rows[7][1] + " end"), (302, words(302, 20) + " " + BENCH), (303, BENCH), (304, words(304, 4000) + " " + BENCH)]
    extra = [(400, None), (401, ""), (402, words(402, 50)), (402, rows[-1][1])]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in rows + extra]
    spark.createDataFrame(docs, COLS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, BENCH), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows


def test_each_stage_on_its_own_input(spark, tables):
    d, rows = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = cp.keep_quality(spark, docs, d)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & set(range(0, 240, 6)) and ids >= {i for i in range(240) if i % 6} | {300, 301, 302, 304}
    unique = cp.drop_near_duplicates(spark, docs, d)
    assert unique.columns == docs.columns
    ids = collections.Counter(r.doc_id for r in unique.collect())
    assert set(range(240)) | {302, 303, 400, 401} <= set(ids) and not {300, 301} & set(ids)
    clean = cp.drop_contaminated(spark, docs, d)
    assert clean.columns == docs.columns
    ids = collections.Counter(r.doc_id for r in clean.collect())
    assert not {302, 303} & set(ids) and set(range(240)) | {300, 301, 304, 400, 401} <= set(ids)


def test_the_whole(spark, tables):
    d, rows = tables
    out = cp.run(spark, d).collect()
    got = collections.defaultdict(int)
    for r in out:
        got[r.doc_id] += r.length
    ids = set(got)
    assert ids >= {i for i in range(240) if i % 6} and not ids & ({300, 301, 302, 303} | set(range(0, 240, 6)))
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "packing"]


def test_empty_documents(spark, tables, tmp_path):
    import shutil
    d, _ = tables
    for t in ("labels", "benchmark"):
        shutil.copytree(f"{d}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    spark.createDataFrame([], COLS).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_one_row_of_a_group_stays(spark, tables):
    d, _ = tables
    docs = spark.createDataFrame([(1, "a b c d e f", 1, 2), (2, "a b c d e f", 3, 4), (None, "a b c d e f", 5, 6), (1, "a b c d e f", 7, 8),
                                  (None, "only here is this text", 9, 10), (None, "only here is this text", 9, 10), (None, None, 1, 12), (None, None, 1, 14)],
                                 "doc_id long, text string, keep int, extra int")
    assert sorted(r.extra for r in cp.drop_near_duplicates(spark, docs, d).collect())[1:] == [10, 12, 14]
    assert sorted(r.extra for r in cp.drop_near_duplicates(spark, docs, d).collect())[0] in (2, 8)
    assert sorted(r.extra for r in cp.drop_contaminated(spark, docs, d).collect()) == [2, 4, 6, 8, 10, 10, 12, 14]


def test_an_id_with_two_texts_loses_the_copy(spark, tables):
    d, _ = tables
    docs = spark.createDataFrame([(1, "a b c d e f"), (5, "u v w x y z"), (5, "a b c d e f"), (5, "u v w x y z")], "doc_id long, text string")
    got = sorted(map(tuple, cp.drop_near_duplicates(spark, docs, d).collect()))
    assert got == [(1, "a b c d e f"), (5, "u v w x y z")]


def test_columns_with_the_names_of_results_keep_their_values(spark, tables):
    d, _ = tables
    names = ["score", "predicted", "held_out", "_text", "n_words", "n_hit", "contaminated", "stats", "component_id", "n_shingles", "key", "a.b", "text_hash"]
    docs = spark.createDataFrame([(i, words(i, 60), *[f"{n}{i}" for n in names]) for i in range(1, 6)], ["doc_id", "text", *names])
    for stage in (cp.keep_quality, cp.drop_near_duplicates, cp.drop_contaminated):
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        rows = {r[0]: tuple(r) for r in out.collect()}
        assert rows == {r[0]: tuple(r) for r in docs.collect()}, stage


def test_a_very_long_text_goes_through(spark, tables, tmp_path):
    import shutil
    d, _ = tables
    for t in ("labels", "benchmark"):
        shutil.copytree(f"{d}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    docs = [(1, words(1, 400) + " " + "word " * 400_000, "en", "s", 0), (2, words(2, 60), "en", "s", 0), (3, "x" * 1_000_000, "en", "s", 0)]
    spark.createDataFrame(docs, COLS).write.parquet(f"{tmp_path}/documents.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert cp.drop_near_duplicates(spark, table, d).count() == 3
    assert cp.drop_contaminated(spark, table, d).count() == 3
    assert {r.doc_id for r in cp.pack(spark, table, d).collect()} == {1, 2, 3}
    assert cp.keep_quality(spark, table, d).where("doc_id = 2").count() == 1
