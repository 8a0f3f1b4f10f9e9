"""Directory scan (binaryFile), rule files on disk, and sinks."""
import os
import tempfile

from pyspark.sql import functions as F

from quire.operators.pack import pack
from quire.operators.render import render_blocks, render_documents
from quire.sources.files import scan_files
from quire.sources.sinks import chunk_file_name, write_blocks, write_documents


def _write(root, rel, data):
    p = os.path.join(root, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "wb") as f:
        f.write(data)


def test_scan_and_pack_directory(spark):
    root = tempfile.mkdtemp(prefix="quire-scan-")
    _write(root, "proj/README.md", b"# Test Project\n")
    _write(root, "proj/src/index.js", b"console.log(1);\n")
    _write(root, "proj/node_modules/dep/index.js", b"x\n")
    _write(root, "proj/.gitignore", b"node_modules\nsecret\n")
    _write(root, "proj/secret/key.txt", b"k\n")
    _write(root, "proj/bad.txt", b"ok \xff\xfe end\n")
    _write(root, "proj/big.txt", b"x" * 5000)
    _write(root, "other/a.py", b"print(1)\n")
    files = scan_files(spark, root, max_file_size=4096)
    p = pack(files)
    got = {(r.corpus_id, r.path) for r in p.files.collect()}
    assert got == {("proj", "README.md"), ("proj", "src/index.js"), ("proj", "bad.txt"), ("other", "a.py")}
    bad = files.where("path = 'bad.txt'").first()
    assert bad.content.startswith("ok ") and "�" in bad.content and bad.size == 10


def test_scan_reads_names_with_dots_and_underscores(spark):
    root = tempfile.mkdtemp(prefix="quire-scan-")
    names = ["pkg/__init__.py", "pkg/a.py", "_config.yml", ".eslintrc.js", "_app/x.ts", "_app/.deep/_y.ts", "empty.txt", "naïve é.md", "a b.txt"]
    for n in names:
        _write(root, f"proj/{n}", b"" if n == "empty.txt" else n.encode())
    _write(root, "proj/.gitignore", b"# none\n")
    _write(root, "proj/.ctxignore", b"_app\n")
    _write(root, "top.txt", b"outside any corpus")
    os.makedirs(f"{root}/void/inner")
    files = scan_files(spark, root)
    assert {(r.corpus_id, r.path, r.content) for r in files.collect() if r.path[:2] not in (".g", ".c")} == \
        {("proj", n, "" if n == "empty.txt" else n) for n in names}
    assert {r.path for r in pack(files).files.collect()} == set(names) - {"_app/x.ts", "_app/.deep/_y.ts"} | {".ctxignore"}
    assert {r.path for r in scan_files(spark, "file://" + root, path_glob="*.py").collect()} == {"pkg/__init__.py", "pkg/a.py"}
    deep = {(r.corpus_id, r.path) for r in scan_files(spark, root, corpus_depth=2).collect()}
    assert ("proj/pkg", "a.py") in deep and ("proj/_app", ".deep/_y.ts") in deep


def test_a_file_that_cannot_be_read_ends_the_job(spark):
    import pytest
    root = tempfile.mkdtemp(prefix="quire-scan-")
    _write(root, "p/a.txt", b"a")
    got = scan_files(spark, root)
    os.remove(os.path.join(root, "p", "a.txt"))
    assert got.collect() == []                      # vanished: skipped
    os.makedirs(os.path.join(root, "p", "a.txt"))
    with pytest.raises(Exception):
        got.collect()                               # no longer a file: fails


def test_sinks(spark):
    out = tempfile.mkdtemp(prefix="quire-out-")
    docs = spark.createDataFrame([("c1", 1, "doc one"), ("c1", 12, "doc\ntwelve"), ("c2", 100, "x")],
                                 "corpus_id string, chunk long, document string")
    names = [r[0] for r in docs.select(chunk_file_name("chunk", "xml")).collect()]
    assert names == ["chunk-01.xml", "chunk-12.xml", "chunk-100.xml"]
    write_documents(docs, f"{out}/docs", "markdown")
    assert os.path.isdir(f"{out}/docs/corpus_id=c1/file=chunk-12.md")
    files = spark.createDataFrame([("c1", 1, "a.js", "x\n", 2), ("c1", 2, "b.js", "y", 1)],
                                  "corpus_id string, pos long, path string, content string, size long")
    stats = spark.createDataFrame([("c1", 2, 3, 2)], "corpus_id string, total_files long, total_size long, tokens long")
    from quire.operators.tree import tree_lines, tree_text
    tl = tree_lines(files.select("corpus_id", "path", "content", "size"))
    for fmt in ("plain", "markdown", "xml"):
        blocks = render_blocks(files, stats, fmt, tree_rows=tl)
        write_blocks(blocks, f"{out}/blocks-{fmt}")
        d = f"{out}/blocks-{fmt}/corpus_id=c1"
        text = "".join(open(os.path.join(d, n), encoding="utf-8").read()
                       for n in sorted(os.listdir(d)) if n.startswith("part-"))
        whole = render_documents(files.withColumn("chunk", F.lit(1)).withColumnRenamed("pos", "q"),
                                 stats.withColumn("chunk", F.lit(1)), fmt, tree=tree_text(tl)).first().document
        assert text == whole + "\n", fmt


def test_blocks_of_every_format_make_the_document(spark):
    from quire.operators.tree import tree_lines, tree_text
    rows = [("c1", 1, "a.js", "x\n", 2), ("c1", 2, "d/b.py", "y  \n\n", 4), ("c2", 1, "only.md", "# é 🌍\x0b", 9)]
    files = spark.createDataFrame(rows, "corpus_id string, pos long, path string, content string, size long")
    stats = spark.createDataFrame([("c1", 2, 6, 2), ("c2", 1, 9, 3), ("none", 0, 0, 0)], "corpus_id string, total_files long, total_size long, tokens long")
    lines = tree_lines(files.select("corpus_id", "path", "content", "size"))
    one = files.withColumn("chunk", F.lit(1)).withColumnRenamed("pos", "q"), stats.withColumn("chunk", F.lit(1))
    for fmt in ("markdown", "xml", "plain", "json", "<{{directory}} {{tree}}{{#files}}[{{path}} {{totalFiles}}]\n{{/files}}{{totalSize}}>",
                "{{#files}}{{content}}{{/files}}tree: {{tree}}"):
        blocks = render_blocks(files, stats, fmt, tree_rows=lines).collect()
        got = {}
        for r in sorted(blocks, key=lambda r: (r.part, r.segs or [], r.seq)):
            got[r.corpus_id] = got.get(r.corpus_id, "") + r.block
        want = {r.corpus_id: r.document for r in render_documents(*one, fmt, tree=tree_text(lines)).collect()}
        assert got == want, fmt


ODD = [("c1", 1, "a.js", "x\n", 2), ("c1", 2, "d/b.py", "y  \n\n", 4), ("a/b c.", 1, "only.md", "# é 🌍\x0b", 9), (".", 1, "p", "", 0), (None, 1, "q", "z", 1)]


def _odd(spark):
    from quire.operators.tree import tree_lines
    files = spark.createDataFrame(ODD, "corpus_id string, pos long, path string, content string, size long")
    stats = spark.createDataFrame([("c1", 2, 6, 2), ("a/b c.", 1, 9, 3), (".", 1, 0, 0), (None, 1, 1, 1), ("none", 0, 0, 0)],
                                  "corpus_id string, total_files long, total_size long, tokens long")
    return files, stats, tree_lines(files.select("corpus_id", "path", "content", "size"))


def test_files_are_the_documents(spark):
    from quire.operators.tree import tree_text
    from quire.sources.sinks import write_files
    files, stats, lines = _odd(spark)
    names = {"c1": "c1", "a/b c.": "a%2Fb%20c.", ".": "%2E", None: "%00", "none": "none"}
    for fmt, ext in (("markdown", "md"), ("xml", "xml"), ("plain", "md"), ("json", "json"), ("{{#files}}{{path}}{{/files}}{{tree}}.", "md")):
        out = tempfile.mkdtemp(prefix="quire-out-")
        written = {r.file: r.bytes for r in write_files(render_blocks(files, stats, fmt, tree_rows=lines), out, fmt).collect()}
        docs = render_documents(files.withColumn("chunk", F.lit(1)), stats.withColumn("chunk", F.lit(1)), fmt, tree=tree_text(lines), order="pos").collect()
        want = {f"{names[r.corpus_id]}/context.{ext}": r.document.encode() for r in docs}
        found = {os.path.relpath(os.path.join(d, f), out): open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(out) for f in fs}
        assert found == want and written == {k: len(v) for k, v in want.items()}, fmt


def test_a_document_of_many_parts_and_chunk_names(spark, monkeypatch):
    from quire.operators import ordered
    from quire.sources.sinks import write_files
    monkeypatch.setattr(ordered, "SLICE_ROWS", 30)
    rows = [(c, k, i, f"f{i:04d}.txt", f"text {i} é\n" * (i % 4)) for c, k, n in (("hot", 1, 400), ("hot", 7, 3), ("hot", 123, 1), ("cold", 1, 2)) for i in range(1, n + 1)]
    files = spark.createDataFrame(rows, "corpus_id string, chunk long, q long, path string, content string").withColumn("size", F.octet_length("content").cast("long"))
    stats = files.groupBy("corpus_id", "chunk").agg(F.count("*").alias("total_files"), F.sum("size").alias("total_size"), F.lit(5).cast("long").alias("tokens"))
    out = tempfile.mkdtemp(prefix="quire-out-")
    for _ in range(2):                                  # writing again replaces the files
        write_files(render_blocks(files, stats, "xml", group=("corpus_id", "chunk"), order="q"), out, "xml", ("corpus_id", "chunk"))
    docs = {(r.corpus_id, r.chunk): r.document for r in render_documents(files, stats, "xml", include_tree=False).collect()}
    names = {("hot", 1): "hot/chunk-01.xml", ("hot", 7): "hot/chunk-07.xml", ("hot", 123): "hot/chunk-123.xml", ("cold", 1): "cold/chunk-01.xml"}
    assert sorted(os.listdir(out)) == ["cold", "hot"]
    for k, n in names.items():
        assert open(f"{out}/{n}", encoding="utf-8").read() == docs[k]


def test_a_failed_write_leaves_nothing(spark):
    import pytest
    from quire.sources.sinks import write_files
    files, stats, lines = _odd(spark)
    out = tempfile.mkdtemp(prefix="quire-out-")
    blocks = render_blocks(files, stats, "plain", tree_rows=lines)
    write_files(blocks, out, "plain")
    before = sorted(os.path.join(d, f) for d, _, fs in os.walk(out) for f in fs)
    os.makedirs(f"{out}/c1/context.json/blocked")       # the name of a file is taken by a folder
    with pytest.raises(Exception):
        write_files(render_blocks(files, stats, "json", tree_rows=lines), out, "json")
    assert not [d for d in os.listdir(out) if d.startswith("_")]
    assert set(before) <= {os.path.join(d, f) for d, _, fs in os.walk(out) for f in fs}
