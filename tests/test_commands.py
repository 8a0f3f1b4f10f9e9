"""Each command plan on a small project."""
from pyspark.sql import functions as F

from quire.plans import commands as CMD
from tests.conftest import files_df

ROWS = [("README.md", "# Test Project\n"), ("src/index.js", "// c\nconsole.log(1);\n" * 30),
        ("src/utils.py", "x = 1  # c\n" * 200), ("docs/a.md", "text\n\n\n" * 100), ("node_modules/x.js", "y")]


def test_commands(spark):
    files = files_df(spark, ROWS)
    out = CMD.pack_command(files, stats=True, fmt="xml")
    assert out["summary"].first().total_files == 4 and out["top_files"].count() == 4
    assert out["documents"].first().document.endswith("</context>")
    assert CMD.count_command(files, breakdown=True)["summary"].first().fits
    cmp = CMD.compare_command(files, models="gpt-4o,nope,codestral")["comparison"]
    assert {r.model for r in cmp.collect()} == {"gpt-4o", "codestral"}
    assert CMD.cost_command(files)["recommendation"].first().any_fits
    assert CMD.cost_command(files, model="o3")["cost"].first().model == "o3"
    opt = CMD.optimize_command(files, tokens=300, fmt="markdown")
    s = opt["summary"].first()
    assert s.final_tokens <= 300 and s.initial_tokens > 300 and opt["documents"].count() == 1
    sp = CMD.split_command(files, strategy="by_type", overlap=True, fmt="plain")
    assert sp["split_stats"].first().total_chunks == 3 and sp["documents"].count() == 3
    assert CMD.split_command(files, suggest=True, model="codestral")["suggestion"].first().needs_split is False
    prof = CMD.profile_command(spark, action="add", name="mine", context=5000)["custom"]
    shown = CMD.profile_command(spark, prof, action="show", name="mine")
    assert shown["profile"].first().context == 5000 and shown["example_costs"].count() == 1
    assert CMD.profile_command(spark, prof, action="list")["profiles"].count() == 48
