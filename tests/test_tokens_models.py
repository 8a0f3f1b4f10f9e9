"""Token estimates, cost arithmetic, model resolution, profiles, formatting."""
from pyspark.sql import functions as F

from quire.functions import constants as K
from quire.functions import models as M
from quire.functions.text import format_bytes, format_money, format_size, xml_escape
from quire.functions.tokens import estimate_tokens, joined_tokens, len_chars
from quire.operators.compare import cost_comparison, recommend_model, single_cost


def test_estimate(spark):
    df = spark.createDataFrame([("",), (None,), ("Hello World",), ("a" * 1000,), ("Hello 世界 🌍",)], "t string")
    got = [r[0] for r in df.select(estimate_tokens("t")).collect()]
    assert got[:4] == [0, 0, 3, 250] and got[4] > 0


def test_utf16_length(spark):
    df = spark.createDataFrame([("a🌍",)], "t string")
    assert df.select(len_chars("t", True), len_chars("t")).first() == (3, 2)


def test_joined_tokens(spark):
    df = spark.createDataFrame([(0, 0), (8, 1), (8, 2), (9, 2)], "l long, n long")
    assert [r[0] for r in df.select(joined_tokens("l", "n")).collect()] == [0, 2, 3, 3]


def test_cost_arithmetic(spark):
    summary = spark.createDataFrame([("c", t) for t in (0, 64000, 500000, 1000000)], "corpus_id string, tokens long") \
        .withColumn("corpus_id", F.concat("corpus_id", F.col("tokens").cast("string")))
    got = {r.corpus_id: r for r in single_cost(summary, M.models(spark), "gpt-5.4", 1000).collect()}
    for t in (0, 64000, 500000, 1000000):
        r = got[f"c{t}"]
        assert r.input_cost == (t / 1_000_000) * 2.5
        assert r.output_cost == (1000 / 1_000_000) * 15.0
        assert r.total_cost == r.input_cost + r.output_cost
        assert r.context_usage == t / 400000 and r.context_remaining == 400000 - t
    bad = single_cost(summary, M.models(spark), "no-such-model").first()
    assert bad.error == "Unknown model: no-such-model" and bad.total_cost is None


def test_recommend(spark):
    summary = spark.createDataFrame([("small", 1000), ("huge", 20_000_000)], "corpus_id string, tokens long")
    rec = {r.corpus_id: r for r in recommend_model(cost_comparison(summary, M.models(spark))).collect()}
    assert rec["small"].best_model == rec["small"].cheapest_model == "command-r7b"
    assert rec["huge"].best_model is None and rec["huge"].any_fits is False


def test_resolve_model(spark):
    names = spark.createDataFrame([("Claude",), ("gpt-4o",), ("zzz",), (None,), ("OPUS",)], "n string")
    got = {r.n: r.model for r in M.resolve_model(names, "n").collect()}
    assert got == {"Claude": "claude-sonnet-4-6", "gpt-4o": "gpt-4o", "zzz": K.DEFAULT_MODEL, None: K.DEFAULT_MODEL,
                   "OPUS": "claude-opus-4-7"}
    assert M.resolve_model_name("scout") == "llama-4-scout" and len(K.MODELS) == 47 and len(K.MODEL_ALIASES) == 34


def test_profiles(spark):
    custom = spark.createDataFrame([], M.PROFILE_SCHEMA)
    custom = M.add_profile(custom, "mine", 8000, 1.0, 2.0)
    custom = M.add_profile(custom, "gpt-4o", 64000, 9.0, 9.0)
    custom = M.add_profile(custom, "mine", 9000, 1.0, 2.0)
    prof = {r.model: r for r in M.profiles(M.models(spark), custom).collect()}
    assert len(prof) == 48 and prof["mine"].context == 9000 and prof["gpt-4o"].context == 64000
    assert M.remove_profile(custom, "mine").count() == 1
    try:
        M.remove_profile(custom, "gpt-5.4")
        assert False
    except ValueError:
        pass


def test_example_costs(spark):
    ex = M.example_costs(M.models(spark).where("model = 'codestral'")).collect()
    assert [r.tokens for r in sorted(ex, key=lambda r: r.tokens)] == [1000, 10000]


def test_formatting(spark):
    df = spark.createDataFrame([(b,) for b in (0, 500, 1024, 1536, 2048, 1048576, 2097152, 1280, 1310720)], "b long")
    got = [tuple(r) for r in df.select(format_size("b"), format_bytes("b")).collect()]
    assert got == [("0 B", "0 B"), ("500 B", "500 B"), ("1.0 KB", "1.0 KB"), ("1.5 KB", "1.5 KB"),
                   ("2.0 KB", "2.0 KB"), ("1.00 MB", "1.0 MB"), ("2.00 MB", "2.0 MB"), ("1.3 KB", "1.3 KB"),
                   ("1.25 MB", "1.3 MB")]
    m = spark.createDataFrame([(10.999,)], "m double").select(format_money("m")).first()[0]
    assert m == "$11.00"
    e = spark.createDataFrame([("a&<>\"'",)], "s string").select(xml_escape("s")).first()[0]
    assert e == "a&amp;&lt;&gt;&quot;&apos;"
