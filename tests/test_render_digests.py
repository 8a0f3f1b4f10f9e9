"""Digests of rendered documents, and the block form of every format."""
import hashlib

import pytest
from pyspark.sql import functions as F

from quire.operators import render as R
from quire.operators.tree import tree_lines, tree_text
from quire.plans import oracle
from quire.plans import queries as Q

SF = "/root/testdata/sf0.001"
FORMATS = ["markdown", "xml", "plain", "json", Q.TEMPLATE, "{{tree}}{{#files}}{{path}}{{/files}}", "{{#files}}{{/files}}",
           "<{{directory}} {{tree}}{{#files}}[{{path}} {{totalFiles}}]\n{{/files}}{{totalSize}}>"]


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_digests_are_those_of_the_documents(spark, monkeypatch):
    monkeypatch.setattr(R, "CHUNKS_PER_PASS", 2)
    rows = [("c1", 1, 1, "a.js", "x\n", 2), ("c1", 1, 2, "d/b.py", "y  \n\n", 4), ("c1", 2, 3, "d/é.md", "🌍 \\ \"", 9),
            ("c1", 3, 4, "z", "", 0), ("c2", 1, 1, "only.md", "# é 🌍\x0b", 9), (None, 1, 1, "p", "q", 1)]
    files = spark.createDataFrame(rows, "corpus_id string, chunk long, q long, path string, content string, size long")
    stats = spark.createDataFrame([("c1", 1, 2, 6, 2), ("c1", 2, 1, 9, 3), ("c1", 3, 1, 0, 0), ("c2", 1, 1, 9, 3), ("none", 1, 0, 0, 0), (None, 1, 1, 1, 1)],
                                  "corpus_id string, chunk long, total_files long, total_size long, tokens long")
    lines = tree_lines(files.select("corpus_id", "path", "content", "size"))
    for fmt in FORMATS:
        docs = R.render_documents(files, stats, fmt, tree=tree_text(lines)).collect()
        want = {(r.corpus_id, r.chunk): (len(r.document), hashlib.md5(r.document.encode()).hexdigest()) for r in docs}
        got = R.document_digests(files, stats, fmt, tree_rows=lines, order="q").collect()
        assert {(r.corpus_id, r.chunk): (r.doc_len, r.doc_md5) for r in got} == want and len(got) == len(docs), fmt


@pytest.mark.parametrize("name", ["render_json", "render_chunks"])
def test_no_corpus_or_tree_becomes_one_value(spark, name):
    # Lists of a node's ancestors (the prefix of its line) are bounded by its depth.
    plan = _plan(Q.QUERIES[name](spark, SF))
    assert "collect_list(struct(segs" not in plan and "collect_list(struct(_o" not in plan


@pytest.mark.parametrize("kind", ["xml", "plain", "template", "json"])
def test_blocks_of_every_format_are_registered(spark, kind):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    name = f"render_{kind}_blocks"
    got = Q.QUERIES[name](spark, SF).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, con.execute(oracle.oracle_sql()[name]).fetchall()))


def _two_levels(blocks: list[str], run: int) -> str:
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    own = [md5(b) for b in blocks]
    return md5("".join(md5("".join(own[i:i + run])) for i in range(0, len(own), run)))


@pytest.mark.parametrize("fmt", ["markdown", "xml", "json"])
def test_a_hot_corpus_over_many_slices(spark, monkeypatch, fmt):
    """One corpus has nearly all rows: its blocks stand in many slices, and index and digest are those of the whole."""
    from quire.operators import ordered
    monkeypatch.setattr(ordered, "SLICE_ROWS", 40)
    monkeypatch.setattr(R, "DIGEST_BLOCKS", 64)
    rows = [("hot", f"d{i % 7}/é{i:04d}.md", "text 🌍 \n" * (i % 5)) for i in range(600)] + [("cold", "a.py", "x"), (None, "b.py", "y\n")]
    files = spark.createDataFrame(rows, "corpus_id string, path string, content string").withColumn("size", F.octet_length("content").cast("long"))
    from quire.operators import pack as P
    p = P.pack(files)
    blocks = R.render_blocks(p.with_content(), p.summary, fmt, tree_rows=tree_lines(files)).cache()
    index = R.block_index(blocks)
    assert ordered.slices_for(blocks) >= 13
    docs = {r.corpus_id: r.document for r in R.render_documents(
        p.with_content().withColumn("chunk", F.lit(1)), p.summary.withColumn("chunk", F.lit(1)), fmt, tree=tree_text(tree_lines(files)), order="pos").collect()}
    text = {(r.corpus_id, r.part, r.segs and tuple(r.segs), r.seq): r.block for r in blocks.collect()}
    found = {}
    for r in index.collect():
        block, doc = text[r.corpus_id, r.part, r.segs and tuple(r.segs), r.seq], docs[r.corpus_id]
        assert doc[r.char_start:r.char_end] == block and doc.encode()[r.byte_start:r.byte_end] == block.encode()
        found.setdefault(r.corpus_id, {})[r["at"]] = block
    whole = {r.corpus_id: r for r in R.index_digests(index).collect()}
    assert set(whole) == set(docs) == {"hot", "cold", None}
    for c, doc in docs.items():
        own = [found[c][i] for i in range(1, len(found[c]) + 1)]
        assert "".join(own) == doc
        r = whole[c]
        assert (r.blocks, r.doc_len, r.doc_bytes, r.doc_digest) == (len(own), len(doc), len(doc.encode()), _two_levels(own, 64))


@pytest.mark.parametrize("name", ["render_markdown", "render_json"])
def test_contents_are_not_dealt_by_corpus(spark, name):
    plan = Q._pack_blocks(spark, SF, name.split("_")[1])._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(corpus_id" in line or "Exchange hashpartitioning(coalesce(corpus_id" in line]
    assert all("content_key" in line or "content" not in line for line in dealt)


def test_whole_digests_over_slices_and_pieces(spark, monkeypatch):
    """The MD5 is that of a document's text, wherever slices and pieces end."""
    from quire.operators import ordered
    monkeypatch.setattr(ordered, "SLICE_ROWS", 40)
    monkeypatch.setattr(R, "PIECE_BYTES", 100)
    rows = [("hot", f"d{i % 7}/é{i:04d}.md", "text 🌍 \n" * (i % 25)) for i in range(300)] + [("cold", "a.py", "x"), (None, "b.py", "y\n"), ("", "c", "")]
    files = spark.createDataFrame(rows, "corpus_id string, path string, content string").withColumn("size", F.octet_length("content").cast("long"))
    from quire.operators import pack as P
    p = P.pack(files)
    for fmt in ("markdown", "json"):
        blocks = P.stored(R.render_blocks(p.with_content(), p.summary, fmt, tree_rows=tree_lines(files)))
        docs = R.render_documents(p.with_content().withColumn("chunk", F.lit(1)), p.summary.withColumn("chunk", F.lit(1)), fmt,
                                  tree=tree_text(tree_lines(files)), order="pos").collect()
        got = R.whole_digests(blocks).collect()
        assert {r.corpus_id: r.doc_md5 for r in got} == {r.corpus_id: hashlib.md5(r.document.encode()).hexdigest() for r in docs} and len(got) == 4


@pytest.mark.parametrize("kind", ["json", "markdown", "plain", "template", "xml"])
def test_queries_hash_whole_documents(spark, kind):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    got, sql = Q.QUERIES[f"render_{kind}"](spark, SF), con.execute(oracle.oracle_sql()[f"render_{kind}"])
    assert "doc_md5" in got.columns and got.columns == [c[0] for c in sql.description]
    assert sorted(map(tuple, got.collect())) == sorted(sql.fetchall())
