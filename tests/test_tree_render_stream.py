"""Tree, renderers and the change feed."""
import json
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from quire.functions import constants as K
from quire.operators.filters import ignored
from quire.operators.render import parse_template, render_documents
from quire.operators.tree import tree_lines, tree_text
from quire.streaming import watch as W
from tests.conftest import files_df
from tests.test_filters import model_ignored


def _checked_tree(text, paths, patterns):
    """Properties that fix a tree's text: one line per kept node in order of the
    segments, as deep as its path, and a corner where no kept sibling follows."""
    nodes = {tuple(p.split("/")[:d + 1]) for p in paths for d in range(p.count("/") + 1)}
    kept = sorted(n for n in nodes if not any(model_ignored("/".join(n[:d + 1]), patterns) for d in range(len(n))))
    folders = {n[:d] for n in nodes for d in range(1, len(n))}
    lines = text.split("\n")[:-1]
    assert len(lines) == len(kept)
    for n, line in zip(kept, lines):
        glyphs, name = line[:4 * len(n)], line[4 * len(n):]
        assert name == n[-1] + ("/" if n in folders else "")
        follows = [any(m[:d] == n[:d] and len(m) == d + 1 and m[d] > n[d] for m in kept) for d in range(len(n))]
        assert [glyphs[4 * d:4 * d + 4] for d in range(len(n) - 1)] == ["│   " if f else "    " for f in follows[:-1]]
        assert glyphs[-4:] == ("├── " if follows[-1] else "└── ")


def _random_projects(seed):
    rnd = random.Random(seed)
    names = ["a", "b", "src", "dist", "x.png", "lib", "a-b", "z.js", "m.py", "node_modules", "É"]
    return {f"c{c}": sorted({"/".join(rnd.choice(names) for _ in range(rnd.randint(1, 4))) + f"{i}.txt" for i in range(rnd.randint(1, 40))}) for c in range(4)}


@pytest.mark.parametrize("slices", [1, 3, 29])
def test_tree_lines_by_their_properties(spark, slices):
    projects = _random_projects(slices)
    rows = [(c, p, "x") for c, ps in projects.items() for p in ps] + [("c0", projects["c0"][0], "again")]
    got = {r.corpus_id: r.tree for r in tree_text(tree_lines(files_df(spark, rows), num_slices=slices)).collect()}
    for c, paths in projects.items():
        _checked_tree(got.get(c, ""), paths, K.DEFAULT_IGNORE)


def test_literal_trees(spark):
    rows = [("p", "src/index.js", ""), ("p", "src/lib/a.js", ""), ("p", "README.md", ""), ("p", "src/lib/b.js", ""), ("p", "node_modules/x/y.js", ""), ("p", "z/dist/k.js", ""),
            ("q", "a", ""), ("q", "a/b", ""), ("q", "a/b", ""), (None, "only", "")]
    want = {"p": "├── README.md\n├── src/\n│   ├── index.js\n│   └── lib/\n│       ├── a.js\n│       └── b.js\n└── z/\n", "q": "└── a/\n    └── b\n", None: "└── only\n"}
    for slices in (1, 2, 11):
        assert {r.corpus_id: r.tree for r in tree_text(tree_lines(files_df(spark, rows), num_slices=slices)).collect()} == want


#: Own sample: no final newline, an end of CDATA, a replacement pattern, a placeholder, astral text, control characters.
SAMPLE = [("cfg/site.yaml", "a: ']]>'\n", 9), ("notes", "price $& {{path}} 🌍", 24), ("z.rs", "", 0), ("ctl.txt", "t\tb\x0b\x1f\\u001F\n", 13)]


def _render(spark, fmt, tokens=7, tree="├── cfg/\n└── notes\n", **kw):
    files = spark.createDataFrame([("acme kit & co", 1, i + 1, p, c, s) for i, (p, c, s) in enumerate(SAMPLE)],
                                  "corpus_id string, chunk long, q long, path string, content string, size long")
    stats = spark.createDataFrame([("acme kit & co", 1, 4, 1536, tokens)],
                                  "corpus_id string, chunk long, total_files long, total_size long, tokens long")
    trees = spark.createDataFrame([("acme kit & co", tree)], "corpus_id string, tree string")
    return render_documents(files, stats, fmt, tree=trees, **kw).first().document


def test_markdown(spark):
    doc = _render(spark, "md")
    head, body = doc.split("## Files\n\n")
    assert head == ("# acme kit & co\n\n**Files:** 4 | **Tokens:** ~7 | **Size:** 1.5 KB\n\n## File Structure\n\n```\n├── cfg/\n└── notes\n```\n\n")
    assert body == ("### cfg/site.yaml\n\n```yaml\na: ']]>'\n```\n\n### notes\n\n```notes\nprice $& {{path}} 🌍\n```\n\n"
                    "### z.rs\n\n```rust\n\n```\n\n### ctl.txt\n\n```text\nt\tb\x0b\x1f\\u001F\n```")


def test_xml_and_plain(spark):
    x = _render(spark, "XML")
    assert x.startswith('<?xml version="1.0" encoding="UTF-8"?>\n<context directory="acme kit &amp; co">\n  <stats>\n    <files>4</files>\n')
    assert '<file path="notes" language="notes" size="24">\n<![CDATA[\nprice $& {{path}} 🌍\n]]>' in x
    assert x.endswith("    </file>\n  </files>\n</context>")
    p = _render(spark, "txt", tokens=0)
    assert p.startswith("Directory: acme kit & co\nFiles: 4 | Size: 1.5 KB\n" + "=" * 60 + "\n\nFILE STRUCTURE:\n├── cfg/\n")
    assert "--- notes ---\n\nprice $& {{path}} 🌍\n\n--- z.rs ---\n\n\n\n--- ctl.txt ---" in p


def test_json(spark):
    text = _render(spark, "json", tokens=0, tree=None)
    j = json.loads(text)
    assert (j["directory"], j["stats"], j["tree"]) == ("acme kit & co", {"totalFiles": 4, "totalSize": 1536, "tokens": None}, None)
    assert [(f["path"], f["content"]) for f in j["files"]] == [(p, c) for p, c, _ in SAMPLE]
    assert r"t\tb\u000b\u001f\\u001F\n" in text
    compact = _render(spark, "json", tokens=0, tree=None, pretty=False)
    assert json.loads(compact) == j and '"tokens":null' in compact and '"tree":null' in compact


def test_template(spark):
    t = _render(spark, "{{directory}}:{{totalFiles}} {{#files}}<{{directory}}/{{path}}|{{size}}|{{totalSize}}|{{content}}>{{/files}}!")
    assert t.startswith("acme kit & co:4 <acme kit & co/cfg/site.yaml|9|1.5 KB|a: ']]>'\n><acme kit & co/notes|24|1.5 KB|price $& {{path}} 🌍>")
    assert t.endswith("!")
    pre, body, post = parse_template("a{{tree}}{{#files}}{{content}}{{/files}}z")
    assert pre == [("lit", "a"), ("col", "tree")] and body == [("col", "content")] and post == [("lit", "z")]


def test_an_emptied_corpus_disappears(spark):
    rows = [("u1", "a", "add", 1, 1, "x"), ("u2", "b", "add", 2, 2, "yy"), ("u1", "a", "unlink", 3, 3, None), ("u1", "a", "change", 2, 4, "late"),
            ("u2", "c", "add", 4, 5, "z"), ("u3", "d", "add", 5, 6, "w")]
    ch = spark.createDataFrame(rows, "corpus_id string, path string, op string, s long, seq long, content string").select(
        "corpus_id", "path", "op", F.timestamp_seconds("s").alias("ts"), "seq", "content", F.octet_length("content").cast("long").alias("size"))
    d = tempfile.mkdtemp(prefix="quire-stream-")
    seen = []
    for i in range(3):
        ch.where(f"seq > {2 * i} AND seq <= {2 * i + 2}").coalesce(1).write.mode("append").parquet(f"{d}/in")
        q = W.incremental_repack(spark.readStream.schema(ch.schema).parquet(f"{d}/in"), f"{d}/state", f"{d}/out", f"{d}/ckpt",
                                 lambda s: s.groupBy("corpus_id").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("size")))
        q.awaitTermination()
        seen.append({r.corpus_id: (r.files, r.size) for r in W.current_output(spark, f"{d}/out").collect()})
    assert seen == [{"u1": (1, 1), "u2": (1, 2)}, {"u2": (1, 2)}, {"u2": (2, 3), "u3": (1, 1)}]


def test_changes_batch_and_stream(spark):
    rows = [("u1", "src/a.js", "add", "2024-01-01 00:00:00", 1, "x"), ("u1", "src/a.js", "change", "2024-01-01 00:00:00.5", 2, "xy"),
            ("u1", "src/b.js", "add", "2024-01-01 00:00:05", 3, "z"), ("u1", "src/b.js", "unlink", "2024-01-01 00:00:05.2", 4, None),
            ("u2", ".hidden", "add", "2024-01-01 00:00:01", 5, "h"), ("u2", "dist/x.js", "add", "2024-01-01 00:00:01", 6, "d")]
    ch = spark.createDataFrame(rows, "corpus_id string, path string, op string, ts string, seq long, content string") \
        .withColumn("ts", F.to_timestamp("ts")).withColumn("size", F.octet_length("content").cast("long"))
    assert {r.path for r in W.watch_filter(ch).collect()} == {"src/a.js", "src/b.js"}
    bursts = sorted((r.corpus_id, r.events, r.last_op, r.last_path) for r in W.debounce(ch, 1000).collect())
    assert bursts == [("u1", 2, "change", "src/a.js"), ("u1", 2, "unlink", "src/b.js"), ("u2", 2, "add", "dist/x.js")]
    state = {(r.corpus_id, r.path): r.content for r in W.latest_state(ch).collect()}
    assert state == {("u1", "src/a.js"): "xy", ("u2", ".hidden"): "h", ("u2", "dist/x.js"): "d"}

    d = tempfile.mkdtemp(prefix="quire-stream-")
    ch.write.parquet(f"{d}/in")
    stream = spark.readStream.schema(ch.schema).parquet(f"{d}/in")
    q = W.incremental_repack(stream, f"{d}/log", f"{d}/out", f"{d}/ckpt",
                             lambda s: s.groupBy("corpus_id").agg(F.count(F.lit(1)).alias("files")))
    q.awaitTermination()
    out = {r.corpus_id: r.files for r in W.current_output(spark, f"{d}/out").collect()}
    assert out == {"u1": 1, "u2": 2}


def test_debounce_stream_equals_batch(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(300):
        sec = rnd.randint(0, 3000)
        rows.append((f"u{rnd.randint(0, 5)}", f"src/f{rnd.randint(0, 9)}.js", rnd.choice(["add", "change", "unlink"]),
                     f"2024-01-01 00:{sec // 60:02d}:{sec % 60:02d}", i, "c"))
    rows.append(("flush", "src/z.js", "add", "2024-01-02 00:00:00", 10_000, "c"))   # moves the watermark past all bursts
    ch = spark.createDataFrame(rows, "corpus_id string, path string, op string, ts string, seq long, content string") \
        .withColumn("ts", F.to_timestamp("ts")).withColumn("size", F.octet_length("content").cast("long"))
    want = {tuple(r) for r in W.debounce(ch, 30000).where("corpus_id <> 'flush'").collect()}
    d = tempfile.mkdtemp(prefix="quire-deb-")
    ch.repartition(4).write.parquet(f"{d}/in")
    stream = spark.readStream.schema(ch.schema).parquet(f"{d}/in")
    q = (W.debounce(stream, 30000, watermark="1 minute").writeStream.outputMode("append")
         .format("parquet").option("path", f"{d}/out").option("checkpointLocation", f"{d}/ck")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(f"{d}/out").where("corpus_id <> 'flush'")
           .select(*W.debounce(ch, 30000).columns).collect()}
    assert got == want


def test_tree_uses_rule_files(spark):
    rows = [("p", ".gitignore", "secret\n"), ("p", "secret/a.txt", "x"), ("p", "src/b.js", "y"), ("p", ".ctxignore", "*.js\n")]
    got = tree_text(tree_lines(files_df(spark, rows))).first().tree
    assert got == "├── .ctxignore\n└── src/\n"
