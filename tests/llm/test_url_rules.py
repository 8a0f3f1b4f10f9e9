import itertools
import re

from pyspark.sql import functions as F
from quire.llm import url_rules as u


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return low, re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]


def winner(host, path):
    fit = [r for r in u.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.name)) if fit else None


URLS = (["http://a.example.com/en/1", "https://www.example.com/en/2?x=1", "HTTP://WWW.EXAMPLE.COM/EN/3", "http://b.com/de/x#/en/",
         "http://x.net/es/1", "http://net/fr/", "http://notnet/fr/", "http://com", "http://com?a/b", "x://y://z/en/", "no scheme/en/",
         None, "", "://", "http://", "http:///en/", "http://É.org/fr/", "http://my.example.com:80/en/", "http://a.b.example.com/en/?q=1#h",
         "http://example.com/fr/en/", "http://a.org/es/1", "http://c.org/es/1", "http://c.org/de/2.html"]
        + [f"http://s{i % 3}.net/{l}/{i}" for i in range(40) for l in ("es", "fr", "de")] + [f"http://q{i}.org/es/{i}" for i in range(20)])


def brute_mined(rows, min_support, min_confidence):
    """The most confident verdict of any token set of labelled URLs that a URL has."""
    base = [(frozenset(t), v) for t, v in rows]
    rules = []
    tokens = {t for b, _ in base for t in b}
    common = [t for t in tokens if sum(t in b for b, _ in base) >= min_support * len(base)]
    for k in (1, 2, 3):
        for c in itertools.combinations(sorted(common), k):
            who = [v for b, v in base if b.issuperset(c)]
            for v in ("allow", "block"):
                n = who.count(v)
                if n and n >= min_support * len(base) and n / len(who) >= min_confidence:
                    rules.append((frozenset(c), v, n / len(who)))
    return rules


def test_against_brute_force(spark):
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(URLS)], "page_id long, url string, HOST string")
    seen = df.select("url", u.host_of(F.col("url")).alias("host"), u.path_of(F.col("url")).alias("path"))
    seen = {r.url: (r.host, r.path, r.tokens) for r in seen.select("*", u.tokens_of(F.col("url"), F.col("host"), F.col("path")).alias("tokens")).collect()}
    labelled = [(seen[x][2], w.verdict) for x in URLS if (w := winner(*parts(x)))]
    rules = brute_mined(labelled, 0.1, 0.8)
    assert rules
    for broadcast in (20_000, 0):
        got = u.judge(df, min_support=0.1, min_confidence=0.8, broadcast_rules=broadcast).collect()
        assert len(got) == len(URLS)
        for r in got:
            host, path = parts(r.url)
            assert (r.host, r.path) == (host, path)
            w = winner(host, path)
            if w:
                assert (r.rule, r.verdict) == (w.name, w.verdict)
                continue
            fired = [(c, v == "allow") for need, v, c in rules if need <= set(seen[r.url][2])]
            assert r.rule is None
            assert r.verdict == ("block" if fired and not max(fired)[1] else "allow"), (r.url, fired)


def test_without_labels_and_empty(spark):
    df = spark.createDataFrame([(1, "http://a.org/x"), (2, None)], "page_id long, url string")
    assert [r.verdict for r in u.judge(df).collect()] == ["allow", "allow"]
    assert u.judge(df.limit(0)).count() == 0


RULES = (u.Rule("block", "net", "/a/b/bad/"), u.Rule("allow", "net", "/a/b/"))


def verdicts(spark, urls):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return {r.url: r.verdict for r in u.judge(df, RULES, min_support=0.1).collect()}


def test_a_token_in_a_deep_segment(spark):
    urls = [f"http://s{i}.net/a/b/{k}/{i}" for i in range(20) for k in ("bad", "good")]
    got = verdicts(spark, urls + ["http://q.org/a/b/bad/x", "http://q.org/a/b/good/x"])
    assert got["http://q.org/a/b/bad/x"] == "block" and got["http://q.org/a/b/good/x"] == "allow"


def test_a_layout_of_many_fields_is_one_item(spark):
    fields = "&".join(f"f{i}=1" for i in range(40))          # 2 ** 40 sets of fields
    urls = [f"http://s{i}.net/a/b/bad/{i}?{fields}" for i in range(20)] + [f"http://s{i}.net/a/b/good/{i}" for i in range(20)]
    got = verdicts(spark, urls + ["http://q.org/?f7=2", "http://q.org/?g7=2"])
    assert got["http://q.org/?f7=2"] == "block" and got["http://q.org/?g7=2"] == "allow"


def test_a_hot_url_does_not_hide_the_others(spark):
    urls = [f"http://s{i}.net/a/b/bad/{i}" for i in range(20)] + ["http://hot.net/a/b/good/1"] * 1000
    assert verdicts(spark, urls + ["http://q.org/a/b/bad/x"])["http://q.org/a/b/bad/x"] == "block"
