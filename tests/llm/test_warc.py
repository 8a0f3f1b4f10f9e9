import gzip

import pytest
from pyspark.sql import functions as F
from quire.llm import warc

ROWS = [(1, "http://a/1", "<p>é one</p>"), (2, "http://a/2", None), (3, "http://a/3", ""), (4, "http://a/\r\n4", "x" * 100_000),
        (5, None, "<p>é one</p>"), (6, "http://b/", "x" * 100_000), (6, "http://b/", "x" * 100_000), (None, "http://n/", "only"),
        (None, "http://n/2", "<p>é one</p>"), (7, "u", "WARC/1.1\r\n\r\n0\r\n\r\n"), (8, "u", "same"), (8, "u", "same"),
        (9, "u", "日本" * 40_000), (9, "u", "日本" * 40_000)]


def expected(rows):
    low = {}
    for i, _, h in rows:
        p = (h or "").encode()
        k = (i is None, i)
        low[p] = min(low.get(p, k), k, key=lambda x: (x[0], x[1] or 0))
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        f = low[p][1]
        kind = "response" if i == f else "revisit"
        out.append((i, kind, warc.digest_of(p), p if kind == "response" else None, None if kind == "response" else f))
    return sorted(out, key=repr)


def read(spark, path):
    rows = warc.read_payloads(spark, path).collect()
    assert {r.status for r in rows} <= {"ok"}
    return sorted([(int(r.row_id) if r.row_id else None, r.type, r.digest, None if r.payload is None else bytes(r.payload),
                    int(r.refers_to_row) if r.refers_to_row else None) for r in rows], key=repr)


@pytest.mark.parametrize("codec,segment", [("gzip", 1 << 14), ("none", 1 << 14)])
def test_round_trip(spark, tmp_path, codec, segment):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    path = str(tmp_path / "w")
    warc.write_archives(df, path, segment_bytes=segment, chunk_bytes=1000, codec=codec)
    assert read(spark, path) == expected(ROWS)
    kinds = {r.type: r.n for r in warc.read_records(spark, path).groupBy("type").agg(F.count("*").alias("n")).collect()}
    assert kinds["continuation"] > 10
    # Revisits that are joined by a shuffle give the same.
    keep, warc.REVISITS = warc.REVISITS, 0
    try:
        warc.write_archives(df, path + "2", segment_bytes=segment)
    finally:
        warc.REVISITS = keep
    assert read(spark, path + "2") == expected(ROWS)


def test_small_payloads_stay_responses_below_the_bound(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    warc.write_archives(df, str(tmp_path / "w"), min_dedup_bytes=1000)
    kinds = [(r[0], r[1]) for r in read(spark, str(tmp_path / "w"))]
    assert [k for k in kinds if k[1] == "revisit"] == [(6, "revisit"), (6, "revisit")]


def test_empty_table(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert read(spark, str(tmp_path / "w")) == []


def test_damaged_segments_are_reported(spark):
    block = lambda p: b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(p, 3)
    whole = block(b"abcdefgh")
    cutted = [whole[i:i + 20] for i in range(0, len(whole), 20)]
    n = len(cutted)

    def rows(name, parts, total):
        for k, b in parts:
            head = ("response", name, None) if k == 1 else ("continuation", f"{name}#{k}", name)
            yield (*head, k, total if k == n else None, bytearray(b))
    full = list(enumerate(cutted, 1))
    data = [*rows("ok", full[::-1], len(whole)), *rows("gone", full[:1] + full[2:], len(whole)), *rows("cut", full[:-1], len(whole)),
            *rows("long", full, len(whole) + 1), *rows("twice", full + [(2, cutted[1])], len(whole)),
            *rows("clash", full + [(2, b"other")], len(whole)), *rows("orphan", full[1:], len(whole))]
    df = spark.createDataFrame([(*r, None, None, None, None, None) for r in data],
                               "type string, record_id string, origin string, number long, total long, block binary,"
                               "uri string, digest string, refers_to string, row_id string, refers_to_row string")
    got = {r.record_id: (r.status, bytes(r.block) if r.block else None) for r in warc.reassemble(df).collect()}
    assert got == {"ok": ("ok", whole), "gone": ("missing segment", None), "cut": ("missing segment", None),
                   "long": ("wrong length", None), "twice": ("ok", whole), "clash": ("conflict", None), "orphan": ("no origin", None)}


def test_chunks():
    for p in (b"", b"a", b"abc" * 1000):
        assert warc.dechunked(warc.chunked(p, 7)) == p
    assert warc.dechunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: v\r\n\r\n") == b"abc"
    for bad in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabc\r\n", b"z\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(bad)


def test_stream_of_gzip_members():
    record = warc._record([("WARC-Type", "x")], b"block")
    raw = b"".join(gzip.compress(record + b"\r\n\r\n") for _ in range(3))
    assert [b for _, b in warc.parse_records(warc._stream(raw))] == [b"block"] * 3
    with pytest.raises(ValueError):
        list(warc.parse_records(iter([record[:-2]])))
