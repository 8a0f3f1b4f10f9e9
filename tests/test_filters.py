"""Ignore rules: literal cases, and sets of ignored nodes."""
import random

from pyspark.sql import functions as F

from quire.functions import constants as K
from quire.operators.filters import ignored, select_files
from quire.operators.pack import pack
from tests.conftest import files_df


def ignored_nodes(nodes, patterns):
    """The nodes (files and folders, by path) that a pattern or a binary extension names."""
    last = {n: n.rsplit("/", 1)[-1] for n in nodes}
    named = {n for n in nodes for p in patterns if p in n}
    tails = {n for n in nodes for p in patterns if p[:1] == "*" and last[n].endswith(p[1:])}
    heads = {n for n in nodes for p in patterns if p[-1:] == "*" and last[n].startswith(p[:-1])}
    binary = {n for n in nodes if "." in last[n][1:] and last[n].lower().rsplit(".", 1)[1] in K.BINARY_EXTENSIONS}
    return named | tails | heads | binary


def ancestry(path):
    parts = path.split("/")
    return {"/".join(parts[:i + 1]) for i in range(len(parts))}


def model_ignored(path, patterns):
    return bool(ignored_nodes(ancestry(path), patterns))


def test_literal_cases(spark):
    cases = {"src/a.js": False, "dist/a.js": True, "distance.js": True, ".env.example": True, "x.png/inner.txt": True, "x.PNG": True,
             ".png": False, "a.b/c": False, "lib/node_modules/z": True, "node_modules": True, "src/Makefile": False}
    df = spark.createDataFrame([(p,) for p in cases], "path string")
    assert dict(df.select("path", ignored("path", list(K.DEFAULT_IGNORE)).alias("i")).collect()) == cases


def test_closed_form_matches_sets_of_nodes(spark):
    rnd = random.Random(7)
    parts = ["src", "dist", "distance.js", "x.png", "a.b", ".env.example", "build", "lib", "node_modules",
             "f.log", "main.min.js", "ok.txt", "Thumbs.db", "venv2", "a", ".gitignore", "cache", "READ.ME"]
    paths = sorted({"/".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4))) for _ in range(600)})
    patterns = list(K.DEFAULT_IGNORE) + ["dist/", "x*", "*.txt"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = dict(df.select("path", ignored("path", patterns).alias("i")).collect())
    for p in paths:
        assert got[p] == model_ignored(p, patterns), p


def test_fixture_project(spark):
    rows = [("README.md", "# Test Project\n"), ("package.json", '{"name":"t"}\n'), ("src/index.js", "console.log(1);\n"),
            ("src/utils.js", "module.exports={}\n"), ("node_modules/dep/index.js", "x\n"), (".gitignore", "node_modules\n")]
    p = pack(files_df(spark, rows))
    got = {r.path: (r.priority, r.pos) for r in p.files.collect()}
    assert got == {"README.md": (0, 1), "package.json": (1, 2), "src/index.js": (2, 3), "src/utils.js": (100, 4)}


def test_edge_frames(spark):
    rows = [("dist/a.js", "a"), ("distance.js", "b"), ("x.png/inner.txt", "c"), (".env.example", "d"),
            ("src/Makefile", "e"), ("a.b/c", "f"), ("nul.txt", "a\x00b"), ("big.txt", "x" * 200)]
    kept = {r.path for r in select_files(files_df(spark, rows), ignore=["dist/"], max_file_size=100).collect()}
    assert kept == {"src/Makefile", "a.b/c"}


def test_per_corpus_rule_files(spark):
    rows = [("p", ".gitignore", "# c\n  secret  \n\n*.tmp\n"), ("p", "secret/a.js", "1"), ("p", "b.tmp", "2"),
            ("p", "keep.js", "3"), ("q", "secret/a.js", "4"), ("q", ".ctxignore", "keep*\n"), ("q", "keep.js", "5")]
    kept = {(r.corpus_id, r.path) for r in select_files(files_df(spark, rows)).collect()}
    assert kept == {("p", "keep.js"), ("q", "secret/a.js"), ("q", ".ctxignore")}


def test_extensions_not_lowercased(spark):
    rows = [("a.JS", "1"), ("b.js", "2"), ("c.ts", "3")]
    kept = {r.path for r in select_files(files_df(spark, rows), extensions=["js"]).collect()}
    assert kept == {"a.JS", "b.js"}
    kept = {r.path for r in select_files(files_df(spark, rows), extensions=["JS"]).collect()}
    assert kept == set()


def test_rule_regex_matches_level_walk(spark):
    from quire.operators.filters import filter_ignored
    rnd = random.Random(17)
    parts = ["src", "a.b", "x*y", "f(1)", "dist", "[z]", "b.tmp", "q+", "we\\Eird", "lib"]
    pats = ["*.tmp", "x*", "a.b", "f(1)", "[z]", "q+", "we\\Eird", "*", "lib*"]
    rows, rules, expect = [], [], set()
    for c in range(6):
        mine = rnd.sample(pats, rnd.randint(1, 3))
        rules += [(f"c{c}", p) for p in mine]
        for p in {"/".join(rnd.choice(parts) for _ in range(rnd.randint(1, 3))) for _ in range(60)}:
            rows.append((f"c{c}", p, "x"))
            if not model_ignored(p, list(K.DEFAULT_IGNORE)) and not model_ignored(p, mine):
                expect.add((f"c{c}", p))
    r = spark.createDataFrame(rules, "corpus_id string, pattern string")
    got = {(x.corpus_id, x.path) for x in filter_ignored(files_df(spark, rows), K.DEFAULT_IGNORE, r).collect()}
    assert got == expect
