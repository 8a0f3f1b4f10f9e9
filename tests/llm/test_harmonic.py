import collections

import numpy as np
import pytest
from quire.llm import harmonic

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def encode(text, plain=False):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = plain
    return t.encode(text or "", add_special_tokens=False).ids + [2]


DOCS = [(1, "Hello   World, it's don't ΑΣ İstanbul 3rd 42"), (2, None), (3, ""), (4, "a\x1cb c d e é"),
        (5, "word " * 9000), (6, "naïve ".join("xyz" * 50)), (7, "日本語テキスト 🌍🌍"), (7, "日本語テキスト 🌍🌍"),
        (None, "<|endoftext|> </s> 's"), (9, "one two\tthree\r\nfour")]


@pytest.mark.parametrize("capacity,grain", [(4096, 64), (16, 4), (8, 8)])
def test_pieces_cover_documents_and_fill_sequences(spark, capacity, grain):
    rows = harmonic.pack(spark.createDataFrame(DOCS, "doc_id long, text string"), PATH, 2,
                         capacity=capacity, grain=grain, cache=50).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        pieces[r.doc_id].append((r.start, r.length, ids, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    whole = collections.Counter()
    for d, text in DOCS:
        whole[d, tuple(encode(text))] += 1
    for d in {d for d, _ in DOCS}:
        copies = sum(n for (x, _), n in whole.items() if x == d)
        seen = collections.Counter()
        for s, n, ids, total in pieces[d]:
            for i, x in enumerate(ids):
                seen[s + i, x] += 1
        (ids,) = {ids for (x, ids) in whole if x == d}
        assert seen == collections.Counter({(i, x): copies for i, x in enumerate(ids)})
        assert {p[3] for p in pieces[d]} == {len(ids)}
    for got in sequences.values():
        end = 0
        for offset, n in sorted(got):
            assert offset == end
            end += n
        assert end <= capacity


def test_padding_is_small(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('alpha beta gamma ', int(id % 700)) AS text")
    lengths = [r[0] for r in harmonic.pack(docs, PATH, 2).groupBy("sequence_id").sum("length").select("sum(length)").collect()]
    padded = sum(n if n & (n - 1) == 0 else 4096 for n in lengths)
    assert sum(lengths) / padded > 0.99


def test_class_of_each_piece():
    for n in range(1, 9000, 7):
        got = harmonic.piece_lengths(n)
        assert sum(got) == n
        assert all(harmonic.CAPACITY % p == 0 for p in got if p >= harmonic.GRAIN)
        assert sum(p < harmonic.GRAIN for p in got) <= 1


def test_empty_table_and_extra_columns(spark):
    assert harmonic.pack(spark.createDataFrame([], "doc_id long, text string"), PATH, 2).count() == 0
    d = spark.createDataFrame([("k", "hi", 3, 4)], "name string, body string, start int, ids int")
    r = harmonic.pack(d, PATH, 2, id_col="name", text_col="body").first()
    assert (r.doc_id, r.start, r.doc_tokens) == ("k", 0, 2)


def test_cached_encoder_agrees_with_the_tokenizer(spark):
    import os
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    enc = harmonic.WordEncoder(PATH, cache=3000)
    for i in range(0, len(texts), 20):
        flat, at = enc.encode(texts[i:i + 20])
        for j, t in enumerate(texts[i:i + 20]):
            assert flat[at[j]:at[j + 1]].tolist() + [2] == encode(t)


def test_special_strings(spark):
    texts = ["x <|endoftext|> y", "<|endoftext|><|startoftext|>", "a<|endoftext|>b <|END|> <|endoftext|", "Σ<|startoftext|>é"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for plain in (False, True):
        rows = harmonic.pack(df, PATH, 2, capacity=64, grain=64, plain=plain).collect()
        got = collections.defaultdict(list)
        for r in sorted(rows, key=lambda r: r.start):
            got[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
        assert got == {i: encode(t, plain) for i, t in enumerate(texts)}
    assert encode(texts[0]) == [343, 49407, 344, 2]
