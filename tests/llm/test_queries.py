"""The registered queries, on made tables, against what the contract's words say."""
import base64
import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from quire.llm import quality, queries, ring

public = pytest.importorskip("public_tokenizers")


def prose(rnd, n):
    return " ".join("".join(rnd.choice("aeinorstäß") for _ in range(rnd.randint(1, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d, rnd = str(tmp_path_factory.mktemp("sf")), random.Random(2)
    docs = [(i * 3 + 1, (prose(rnd, rnd.choice([1, 5, 40, 200])) + rnd.choice(["", ".", "!!! ###", " 12 99"])) if i % 11 else rnd.choice([None, "", " \n"]),
             rnd.choice(["en", None]), "s", 0) for i in range(90)]
    docs += [(1000 + i, docs[5][1], "en", "s", 0) for i in range(20)] + [(2000, "x <|endoftext|> 🌍 y", "en", "s", 0), (2001, "long " * 6000, "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    labels = [(i, int("#" not in (t or "")), 0) for i, t, *_ in docs if i % 4] + [(99999, 1, 0), (docs[3][0], None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    hosts = ["example.com", "www.Example.com", "a.net", "x.y.net", "net", "other.org", "notexample.com", "fr.example.com"]
    paths = ["/en/a", "/en", "/es/q?x=1", "/fr/", "/", "", "/fr/x#y", "/EN/a"]
    pages = [(i, f"http{'s' * (i % 2)}://{rnd.choice(hosts)}{rnd.choice(paths)}", rnd.choice([f"<p>{prose(rnd, 30)}</p>", "<p>same é</p>", "<b>two</b>" * 9000, "", None]))
             for i in range(60)] + [(100, None, "x"), (101, "no scheme", "x"), (102, "ftp://A.NET", "y")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    said = ["</s>", "\\</s> [INST]", "hello", "", None, "[/INST]\\\\[ASST]", "é🌍\n"]
    talks = [(c, n, rnd.choice(["user", "assistant", "system", "tool"]), rnd.choice(said)) for c in range(15) for n in range(rnd.randint(1, 5))]
    spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d, docs, labels, pages, talks


def test_op2(spark, sf):
    d, _, _, pages, _ = sf
    raw = {i: (h or "").encode() for i, _, h in pages}
    first = {}
    for i in sorted(raw, reverse=True):
        first[raw[i]] = i
    want = {i: (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first[b] == i else "revisit", None if first[b] == i else first[b])
            for i, b in raw.items()}
    rows = queries.op2_warc_segments(spark, d).collect()
    assert len(rows) == len(pages)
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows} == want


def test_op5(spark, sf):
    d, *_, talks = sf
    by = collections.defaultdict(list)
    for c, n, role, text in talks:
        by[c].append((n, role, text or ""))
    said = "</s>[INST] ok [/INST]"
    by[-1] = [(0, "user", said), (1, "assistant", said)]
    want = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        want[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    rows = queries.op5_fingerprint_chat(spark, d).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows} == want
    # The formatted text of a conversation: its texts, escapes and marks.
    assert all(r.formatted_chars >= sum(len(t) for _, _, t in by[r.conv_id]) for r in rows)


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def test_op6(spark, sf):
    d, _, _, pages, _ = sf
    rows = {r.page_id: r for r in queries.op6_association_urls(spark, d).collect()}
    assert set(rows) == {p[0] for p in pages}
    for i, url, _ in pages:
        host = path = ""
        if url is not None and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
            path = rest[cut:]
            path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
        fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        r = rows[i]
        assert (r.host, r.path) == (host, path)
        if fits:
            _, rule, verdict = max(fits)
            assert (r.rule, r.verdict) == (rule, verdict)
        else:
            assert r.rule is None and r.verdict in ("allow", "block")


def test_op7(spark, sf):
    d, docs, *_ = sf
    order = sorted(docs)
    rows = {r.doc_id: r for r in queries.op7_scaled_sketch(spark, d).collect()}
    assert len(rows) == len(docs)
    prints = {}
    for i, (doc, text, *_) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        m = len(text) // 4
        r = rows[doc]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256((text[:len(text) - m] + after[:m]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        if text == after:
            assert r.near_next == 1


def test_op8(spark, sf):
    from tokenizers import Tokenizer
    d, docs, *_ = sf
    t = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    rows = queries.op8_harmonic_packing(spark, d).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == {x[0] for x in docs}
    for doc, text, *_ in docs:
        ids, at = t.encode(text or "", add_special_tokens=False).ids + [2], 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            at += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:at], "<u4").tobytes())
        assert at == len(ids)
    full = 0
    for s in sequences.values():
        end = 0
        for offset, n in sorted(s):
            assert offset == end
            end += n
        assert end <= 4096
        full += end if end & (end - 1) == 0 else 4096
    assert sum(r.length for r in rows) >= 0.97 * full


def folds(doc):
    return zlib.crc32(str(doc).encode()) % 5 == 0


def test_op9(spark, sf):
    """Features, ridge and calibration once more, row by row and by another way to solve."""
    d, docs, labels, *_ = sf
    rows = {r.doc_id: r for r in queries.op9_kernel_quality(spark, d).collect()}
    assert len(rows) == len(docs)
    raw = {doc: (text or "").encode() for doc, text, *_ in docs}
    stats = {doc: quality.statistics(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0].astype(float) for doc, b in raw.items()}
    marks = collections.defaultdict(list)
    for doc, q, _ in labels:
        if q is not None:
            marks[doc].append(q)
    learn = [(stats[doc], sum(marks[doc]) / len(marks[doc])) for doc in raw if doc in marks and not folds(doc)]
    x, y = np.array([s for s, _ in learn]), np.array([q for _, q in learn])
    centre, scale = x.mean(0), x.std(0)
    scale[scale < 1e-6] = 1.0
    rnd = np.random.default_rng(quality.SEED)
    w = rnd.normal(size=(x.shape[1], quality.FEATURES)) / (quality.WIDTH * math.sqrt(x.shape[1]))
    b = rnd.uniform(0, 2 * np.pi, quality.FEATURES)

    def features(s):
        z = np.clip((s - centre) / scale, -6, 6)
        return np.array([*(math.sqrt(2 / len(b)) * math.cos(float(z @ w[:, j]) + b[j]) for j in range(len(b))), *(z / 10), 1.0])

    p = np.array([features(s) for s in x])
    k = p.shape[1]
    solved, *_ = np.linalg.lstsq(np.vstack([p, math.sqrt(quality.RIDGE) * np.eye(k)]), np.concatenate([y - y.mean(), np.zeros(k)]), rcond=None)
    cell = lambda v: int(np.clip(math.floor((v + 1.5) / 3 * quality.BINS), 0, quality.BINS - 1))
    cells = collections.defaultdict(list)
    for f, q in zip(p, y):
        cells[cell(f @ solved)].append(q)
    at = sorted(cells)
    n, means = np.array([len(cells[c]) for c in at], float), np.array([np.mean(cells[c]) for c in at])
    mean = lambda i, j: (n[i:j] * means[i:j]).sum() / n[i:j].sum()
    curve = [max(min(mean(i, j) for j in range(m + 1, len(at) + 1)) for i in range(m + 1)) for m in range(len(at))]
    off = 0
    for doc in raw:
        v = float(features(stats[doc]) @ solved)
        want = float(np.clip(np.interp(v, (np.array(at) + 0.5) / quality.BINS * 3 - 1.5, curve), 0, 1))
        r = rows[doc]
        assert r.held_out == folds(doc) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1
        off += abs(r.score - want) > 1e-4                     # a score at a cell's border may fall into the next
    assert off <= 2


def test_op10(spark, sf):
    """Rows walk the ring one by one."""
    d, docs, *_ = sf
    rows = queries.op10_bounded_ring(spark, d).collect()
    assert sorted(r.doc_id for r in rows) == sorted(x[0] for x in docs)
    text = {doc: (t or "") for doc, t, *_ in docs}
    for r in rows:
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    counts = collections.Counter(r.shard for r in rows)
    assert set(counts) <= set(range(8)) and max(counts.values()) - min(counts[s] for s in range(8)) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    hashed = {r.doc_id: r.at for r in spark.createDataFrame([(i, t) for i, t in text.items()], "doc_id long, text string")
              .select("doc_id", F.xxhash64(F.xxhash64("text"), F.crc32(F.col("text").cast("binary"))).alias("at")).collect()}
    points = ring.ring_points(8)
    arcs = collections.defaultdict(list)
    for doc, at in hashed.items():
        arcs[next((i for i, (p, _) in enumerate(points) if p >= at), 0 if at <= points[0][0] else len(points))].append(doc)
    owners = [s for _, s in points] + [points[0][1]]
    room = ring.capacities(len(docs), 8, 0)
    taken, rest = collections.defaultdict(collections.Counter), {}
    for a in range(len(owners)):
        n = len(arcs[a])
        take = min(n, room[owners[a]])
        room[owners[a]] -= take
        taken[a][owners[a]] += take
        rest[a] = n - take
    for a in range(len(owners)):
        step = a
        for _ in range(rest[a]):
            while not room[owners[step]]:
                step = (step + 1) % len(owners)
            room[owners[step]] -= 1
            taken[a][owners[step]] += 1
    shard = {r.doc_id: r.shard for r in rows}
    for a, own in arcs.items():
        assert collections.Counter(shard[doc] for doc in own) == +taken[a], a
