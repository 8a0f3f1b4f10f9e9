"""Single answers: money, model lists, profiles, empty corpora, a pack's own tree, plans."""
import re

import pytest
from pyspark.sql import functions as F

from quire import api
from quire.functions import models as M
from quire.functions.text import format_money
from quire.operators import compare as C
from quire.operators import pack as P
from quire.operators.split import suggest_split
from tests.conftest import files_df


def test_money_rounds_the_binary_value(spark):
    cases = {1.005: "$1.00", 2.675: "$2.67", 0.125: "$0.13", 0.375: "$0.38", 1.45: "$1.45", 8.345: "$8.35", 0.005: "$0.01", 0.015: "$0.01",
             1e-9: "$0.00", 0.0: "$0.00", 1234567.891: "$1234567.89", 99.995: "$100.00", -1.5: "$-1.50"}
    df = spark.createDataFrame([(x,) for x in cases], "x double")
    assert dict(df.select("x", format_money("x")).collect()) == cases


def test_listed_models_keep_order_and_repeats(spark):
    summary = spark.createDataFrame([("c", 1000)], "corpus_id string, tokens long")
    names = ["command-r", "gpt-4o", "mistral-large-3", "nope", "gpt-4o"]
    got = [(r.rank, r.model) for r in C.compare_models(summary, M.models(spark), names).orderBy("rank").collect()]
    context = {n: M.model_context(n) for n in names}
    want = sorted((n for n in names if context[n]), key=lambda n: 1000 / context[n])
    assert got == list(enumerate(want, 1))


def test_custom_profiles_are_flagged_and_numbered(spark):
    custom = spark.createDataFrame([], M.PROFILE_SCHEMA)
    for name in ("b-model", "a-model", "gpt-4o"):
        custom = M.add_profile(custom, name, 1000, 1, 1)
    got = {r.model: r for r in M.profiles(M.models(spark), custom).collect()}
    assert {m for m, r in got.items() if r.custom} == {"b-model", "a-model", "gpt-4o"}
    assert sorted(r.ord for r in got.values() if r.custom) == [M.MODEL_COUNT, M.MODEL_COUNT + 1, M.MODEL_COUNT + 2]
    assert all(r.created_at is not None for r in got.values() if r.custom)


def test_a_corpus_without_files_has_a_row_of_zeros(spark):
    files = files_df(spark, [("empty", "node_modules/y.js", "x"), ("full", "a.js", "abcd")])
    for kw in ({}, {"max_files": 1}, {"rules": spark.createDataFrame([("full", "*.md")], "corpus_id string, pattern string")}):
        got = {r.corpus_id: (r.total_files, r.total_size, r.tokens, r.tokens_joined, r.truncated) for r in P.pack(files, **kw).summary.collect()}
        assert got == {"empty": (0, 0, 0, 0, False), "full": (1, 4, 1, 1, False)}


def test_there_is_no_size_cap_unless_asked_for(spark):
    files = files_df(spark, [("big.txt", "x" * 300_000), ("small.txt", "y")])
    names = lambda **kw: {r.path for r in P.pack(files, **kw).files.collect()}
    assert names() == names(max_file_size=0) == {"big.txt", "small.txt"}
    assert names(max_file_size=1000) == {"small.txt"}


def test_the_tree_of_a_document_follows_the_pack(spark):
    files = files_df(spark, [("foo/a.js", "1"), ("bar/b.js", "2")])
    doc = api.format(api.pack(files, ignore=["foo"])).first().document
    assert "foo" not in doc and "bar/" in doc


def test_advice_on_splitting(spark):
    summary = spark.createDataFrame([("a", 10), ("b", 10 ** 9)], "corpus_id string, tokens long")
    got = {r.corpus_id: (r.needs_split, r.recommendation, r.strategies) for r in suggest_split(summary, "gpt-4o").collect()}
    assert got["a"] == (False, "Content fits within context limit", None)
    assert got["b"][0] and re.fullmatch(r"Split into \d+ chunks of ~[\d,]+ tokens each", got["b"][1])
    assert got["b"][2] == ["by_tokens", "by_directory", "by_type"]
    assert suggest_split(summary, "nope").first().recommendation == "Use --max-tokens flag to specify limit"


def test_contents_cross_no_exchange_of_a_pack(spark):
    files = files_df(spark, [("a/x.js", "1"), ("a/.gitignore", "z\n")]).union(files_df(spark, [(".gitignore", "q\n")], corpus="r"))
    rules = spark.createDataFrame([("p", "*.md")], "corpus_id string, pattern string")
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = P.pack(files, rules=rules, use_rule_files=False).summary._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    lines = plan.split("\n")
    assert any("SortMergeJoin" in x or "ShuffledHashJoin" in x for x in lines)
    for i, x in enumerate(lines):
        if "Exchange hashpartitioning" in x:        # what goes into an exchange is the node under it
            below = next(y for y in lines[i + 1:] if "Project" in y or "Aggregate" in y or "Scan" in y)
            assert "content" not in re.sub(r"\(.*", "", below.split("[", 1)[-1]), below


def test_a_cluster_needs_a_shared_checkpoint_folder():
    from quire.session import ensure_checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
