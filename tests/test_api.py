"""The named entry points, end to end on a small project."""
from quire import api
from tests.conftest import files_df


def test_api_end_to_end(spark):
    rows = [("README.md", "# Test Project\n"), ("src/index.js", "// c\nconsole.log(1);\n"), ("src/utils.js", "x\n" * 50),
            ("node_modules/dep/index.js", "x\n")]
    files = files_df(spark, rows)
    p = api.pack(files)
    assert p.summary.first().total_files == 3
    assert api.count(p.files.join(files.select("corpus_id", "path", "content"), ["corpus_id", "path"])).first().total_tokens == 4 + 6 + 25
    md = api.format_markdown(p).first().document
    assert md.startswith("# p\n\n**Files:** 3 | **Tokens:** ~35") and "└── src/" in md and "node_modules" not in md
    assert api.calculate_cost(p.summary, "gpt-5.4", 1000).first().total_cost > 0
    assert api.split(p, "by_files", max_files_per_chunk=2).select("chunk").distinct().count() == 2
    o = api.optimize(p, target_tokens=10)
    assert o.where("dropped").count() >= 1
    from quire.operators.optimize import dropped_preview
    assert dropped_preview(o).first().dropped_files >= 1
    assert api.get_model_info(spark, ["gpt-4o", "nope"]).where("known").count() == 1
    from quire.operators.pack import single_file
    from quire.functions.models import models
    s = single_file(files, "node_modules/dep/index.js", model_table=models(spark)).first()
    assert s.tokens == 1 and s.lines.total_lines == 2 and s.remaining == 399999


def test_packs_say_what_they_hold(spark):
    from pyspark.sql import functions as F
    files = files_df(spark, [("a.js", "xxxxx"), ("d/b.md", "é" * 8)])
    p = api.pack(files)
    assert "content" in p.rows.columns and p.tree.count() == 3 and not p.summary.first().tokens_accurate
    q = api.pack(files, include_tree=False, include_content=False, tokenizer=lambda c: F.size(F.split(c, "")))
    assert q.tree is None and "content" not in q.rows.columns
    assert (q.summary.first().tokens_accurate, q.summary.first().tokens) == (True, 13)
    text = "".join(r.block for r in api.format_blocks(p, "xml").orderBy("part", "segs", "seq").collect())
    assert text == api.format_xml(p).first().document


def test_counts_of_texts(spark):
    from pyspark.sql import functions as F
    assert api.count("") == 0 and api.count("Hello World") == 3 and api.count("a" * 1000) == 250
    df = spark.createDataFrame([("Hello World",), (None,)], "t string")
    assert [r[0] for r in df.select(api.count(F.col("t"))).collect()] == [3, 0]
    assert [r[0] for r in df.select(api.count(F.col("t"), lambda c: F.size(F.split(c, " ")))).collect()] == [2, 0]


def test_the_pack_command_has_no_cap_of_its_own(spark):
    from quire.plans.commands import pack_command
    files = files_df(spark, [("big.txt", "x" * 1_500_000), ("a.txt", "y")])
    assert pack_command(files)["summary"].first().total_files == 2
    assert pack_command(files, max_file_size_kb=1000)["summary"].first().total_files == 1
    assert pack_command(files, max_file_size_kb=None)["blocks"].where("part = 3").count() == 2
