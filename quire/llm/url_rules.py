"""URL filter: explicit rules, and association rules mined from what they label.

The explicit rules (allow or block a host with its subdomains and a path
prefix, the longest wins) label the URLs they fit.  The labelled URLs are
transactions of URL tokens plus their label; FP-growth mines frequent token
combinations, and those that imply a label with enough confidence become
association rules.  Each labelled URL counts once, however often it occurs, and
frequent tokens that the same labelled URLs have are one item, which a URL has
if it has any of them (a rule is as confident with any as with all of them).
So a query layout of many fields does not multiply the combinations; tokens
that are frequent in many different combinations still do.  A rule is kept only if no more general rule (a part of its
tokens) is at least as confident, which prunes without changing what fires.
URLs without an explicit rule are judged by the mined ones: blocked if the most
confident rule that fires says block (allow wins a tie), else allowed.

Rules are matched by an inverted index: each is posted under its rarest token,
so a token that a third of all URLs have attracts no candidates unless a rule
has nothing rarer, and a candidate fires if the URL has all its tokens.
Everything is DataFrame functions and Spark's own FP-growth.  Its items are
bounded by the support (at most ``tokens / min_support``, by the transactions'
length); the tables of items and rules are broadcast up to a counted size and
joined by shuffle beyond it.  Equal URLs are judged once.

Edge cases: a null URL or one without ``://`` has an empty host and path, no
tokens and no rule, and is allowed; empty paths fit no rule with a path; repeated
rows are judged alike; without labelled URLs nothing is mined and all others
are allowed; an empty table gives an empty result; columns that clash with
result columns are replaced.
"""
from __future__ import annotations

from typing import NamedTuple, Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare, without

MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.8
BROADCAST_RULES = 20_000       # a rule takes some hundred bytes
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str        # "allow" or "block"
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The explicit rules of the query.
RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
         Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))


def _rest(url: Column) -> Column:
    """What follows the first ``://`` (null without one)."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct of ``rule`` and ``verdict``, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    # Rules that fit one URL have hosts that are suffixes of one host, so their lengths order them.
    for r in sorted(rules, key=lambda r: (len(r.host), len(r.path))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: last label and last two labels of the host, each label
    before those, every path segment with its place, kind of the last segment,
    names of the query's fields."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    hosts = F.array(F.concat(F.lit("top:"), F.element_at(labels, -1)),
                    F.concat(F.lit("site:"), F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), F.lit(2)), ".")))
    subs = F.transform(F.slice(labels, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda x: F.concat(F.lit("sub:"), x))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    segments = F.transform(parts, lambda p, i: F.concat(F.lit("dir"), i.cast("string"), F.lit(":"), F.translate(p, UPPER, LOWER)))
    kind = F.transform(F.filter(F.array(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)), lambda x: x != ""),
                       lambda x: F.concat(F.lit("ext:"), F.translate(x, UPPER, LOWER)))
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda q: q != ""), lambda q: F.concat(F.lit("arg:"), F.substring_index(q, "=", 1)))
    return F.when(host != "", F.array_distinct(F.concat(hosts, subs, segments, kind, names))).otherwise(F.array().cast("array<string>"))


def _small(table: DataFrame, most: int) -> DataFrame:
    """``table``, to be broadcast if it has no more than ``most`` rows."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def items_of(labelled: DataFrame, min_support: float = MIN_SUPPORT) -> DataFrame:
    """``(token, item)`` of the frequent tokens of distinct ``url, tokens`` rows:
    those that the same URLs have share an item, the smallest of them."""
    least = min_support * labelled.count()
    # Equal counts and two equal 64-bit sums of hashes stand for equal sets of URLs.
    sets = (labelled.select(F.explode("tokens").alias("token"), F.xxhash64("url").alias("h"), F.xxhash64(F.lit("2"), "url").alias("k"))
            .groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("h"), F.bit_xor("k").alias("k")).where(F.col("n") >= least))
    sets = cut(sets)
    return cut(sets.join(sets.groupBy("n", "h", "k").agg(F.min("token").alias("item")), ["n", "h", "k"]).select("token", "item"))


def mine(labelled: DataFrame, items: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules ``(rule_id, tokens, verdict, confidence, support)``, whose tokens are
    items, from distinct ``url, tokens, verdict`` rows."""
    label = "label:"
    # URLs without a frequent token count, too: the support is a part of all.
    baskets = (labelled.select("url", "verdict", F.explode_outer("tokens").alias("token")).join(items, "token", "left")
               .groupBy("url").agg(F.collect_set("item").alias("items"), F.first("verdict").alias("verdict")))
    baskets = cut(baskets.select(F.concat("items", F.array(F.concat(F.lit(label), F.col("verdict")))).alias("items")))
    found = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets).associationRules
    rules = cut(found.where(F.element_at("consequent", 1).startswith(label))
                .where(~F.exists("antecedent", lambda t: t.startswith(label)))
                .select(F.sort_array("antecedent").alias("tokens"), F.substring(F.element_at("consequent", 1), len(label) + 1, 100).alias("verdict"),
                        "confidence", "support"))
    # Drop a rule if a more general one with its verdict, found through one of its tokens, is as confident.
    posted = rules.select(F.explode("tokens").alias("t"), F.col("tokens").alias("more"), "verdict", F.col("confidence").alias("c"))
    general = rules.select(F.element_at("tokens", 1).alias("t"), F.col("tokens").alias("less"), "verdict", F.col("confidence").alias("d"))
    implied = (posted.join(general, ["t", "verdict"])
               .where((F.size("less") < F.size("more")) & (F.col("d") >= F.col("c")) & (F.size(F.array_except("less", "more")) == 0))
               .select(F.col("more").alias("tokens"), "verdict").distinct())
    kept = rules.join(implied, ["tokens", "verdict"], "left_anti")
    return cut(kept.withColumn("rule_id", F.xxhash64("tokens", "verdict")))


def _posted(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """Rules under the token that fewest URLs have."""
    counts = (urls.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
              .join(rules.select(F.explode("tokens").alias("token")).distinct(), "token", "left_semi"))
    rarest = (rules.select("rule_id", F.explode("tokens").alias("token")).join(counts, "token", "left")
              .groupBy("rule_id").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("token")))
    return cut(rules.join(rarest, "rule_id").select("token", F.col("tokens").alias("needs"), F.col("verdict").alias("says"), "confidence"))


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, url_col: str = "url", min_support: float = MIN_SUPPORT,
          min_confidence: float = MIN_CONFIDENCE, broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (of the explicit rule that
    wins, else null) and ``verdict``."""
    prepare(pages.sparkSession)
    base = without(pages, ["host", "path", "rule", "verdict"])
    url = F.col(url_col)
    seen = base.select(url.alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    seen = seen.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn(
        "tokens", tokens_of(F.col("url"), F.col("host"), F.col("path")))
    labelled = cut(seen.where("fit is not null").select("url", "tokens", F.col("fit.verdict").alias("verdict")).dropDuplicates(["url"]))
    items = _small(items_of(labelled, min_support), broadcast_rules)
    mined = mine(labelled, items, min_support, min_confidence)
    rest = (seen.where("fit is null").select("url", "tokens").dropDuplicates(["url"]).select("url", F.explode("tokens").alias("token"))
            .join(items, "token").groupBy("url").agg(F.collect_set("item").alias("tokens")))
    index = _small(_posted(mined, rest), broadcast_rules)
    fired = (rest.withColumn("token", F.explode("tokens")).join(index, "token")
             .where(F.size(F.array_except("needs", "tokens")) == 0)
             .groupBy("url").agg(F.max(F.struct("confidence", (F.col("says") == "allow").alias("kind"))).alias("best")))
    blocked = fired.where("not best.kind").select(F.col("url").alias("_url"), F.lit("block").alias("_mined"))
    host, path = host_of(url), path_of(url)
    out = base.withColumns({"host": host, "path": path}).withColumn("_fit", fitting_rule(F.col("host"), F.col("path"), rules))
    out = out.join(blocked, out["_fit"].isNull() & (out[url_col] == blocked["_url"]), "left")
    return out.select(*base.columns, "host", "path", F.col("_fit.rule").alias("rule"),
                      F.coalesce("_fit.verdict", "_mined", F.lit("allow")).alias("verdict"))
