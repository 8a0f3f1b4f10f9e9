"""Phrase collocations by SETM relational mining.

Occurrences of words form a relation sorted by place, where a place is a
number that grows by one from word to word of a piece and skips one between
pieces.  A round joins the relation of frequent k-word phrases with itself by
piece and adjacent position: both sides are sorted, so the merge only compares
neighbours, and two phrases that overlap in all but one word make one of
k + 1 words.  The groups are counted, groups of fewer than ``support``
occurrences go, and a semi-join with the frequent groups leaves the next
relation, sorted as before.  Every word sequence inside a frequent phrase is
frequent, so nothing is lost by the pruning, and all numbers that a phrase's
score needs are counts of frequent phrases.

The relations are written as Parquet in the shared folder, in blocks of
bounded bytes (one row a block, places and items as compressed arrays).  A
text longer than a block is cut between words; a block then looks ahead by
three words that it doesn't count.

A block counts its groups, deals them to buckets by hash and sends each bucket
one packed row.  A bucket (of about ``BUCKET_GROUPS`` groups) sums what the
blocks sent, so a frequent group is at most one entry a block.  It answers each
block with the places of the frequent ones in the row it was sent, and the
block drops the rest.  What a task holds is bounded by the block and by the
bucket; nothing is broadcast or collected.  Groups are equal only if their
strings, or the numbers of their two parts, are: hashes do no more than deal.

Scores are whole numbers, computed with decimals of 38 digits.

Edge cases: a null text is empty; a null language is ``und``; texts without
words, an empty table or a language without candidates give no row; repeated
rows are texts of their own; documents of any length are worked through in
blocks; other columns are ignored, also under clashing names; ids are not
used, so null or repeated ones change nothing.
"""
from __future__ import annotations

import uuid
from typing import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import ordered_scan
from ..session import work_path
from .common import prepare, row_blocks, utf8_buffers
from .words import FOLD, hash_ranges, mix

SUPPORT = 30
LONGEST = 4
TOP = 2000
SCALE = 2_000_000
#: A phrase goes if a longer one has this percentage of its occurrences.
CONTAINED_PERCENT = 80
BLOCK = 8 << 20          # bytes of text in a block
BUCKET_GROUPS = 2 << 20  # groups, counted once a block, that a bucket sums about
_SEQUENCE_BITS = 20
_RANK_BITS = 32          # a group's number: its bucket and its rank there

_WORD, _BLANK, _BREAK = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = _BREAK

RELATION = "block long, own long, n int, place binary, item binary, m int, ids binary"
#: Words of a block by language: how many, how many occurrences, and the packed lengths, bytes and counts of all.
BLOCKS = ("block long, own long, n int, place binary, item binary, "
          "langs array<struct<lang: string, words: int, occurrences: long>>, lengths binary, strings binary, counts binary")
SENT = "bucket int, block long, lang string, n int, a binary, b binary, counts binary"
FOUND = "block long, bucket int, lang string, n int, at binary, ids binary, groups array<struct<id: long, lang: string, word: string, l: long, r: long, f: long>>"


def _packed(a: np.ndarray, kind: str) -> bytes:
    """Numbers of ``kind``, their lowest bytes first, then the next: small
    numbers' upper bytes then take next to nothing."""
    import pyarrow as pa
    width = np.dtype(kind).itemsize
    planes = np.ascontiguousarray(a.astype(kind).view(np.uint8).reshape(-1, width).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(b: bytes, n: int, kind: str) -> np.ndarray:
    import pyarrow as pa
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(b, n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).ravel()


def _cuts(data: np.ndarray, limit: int) -> Iterator[tuple[int, int, int]]:
    """``(first, end, look-ahead end)`` of runs of about ``limit`` bytes of one
    text, cut between words; the look-ahead has the next words of the piece."""
    n, lo = len(data), 0
    while lo < n:
        own = min(lo + limit, n)
        step = 1 << 12
        while own < n and _KIND[data[own]] == _WORD:
            off = np.flatnonzero(_KIND[data[own:own + step]])
            own = own + int(off[0]) if len(off) else min(own + step, n)
            step *= 4
        hi, step = own, 1 << 8
        while hi < n:
            hi = min(own + step, n)
            kind = _KIND[data[own:hi]]
            stop = np.flatnonzero(kind == _BREAK)
            ends = np.flatnonzero((kind[:-1] == _WORD) & (kind[1:] != _WORD)) + 1
            if len(stop):
                hi = own + int(stop[0])
                break
            if len(ends) >= LONGEST - 1:
                hi = own + int(ends[LONGEST - 2])
                break
            step *= 4
        yield lo, own, hi
        lo = own


def _block(number: int, data: np.ndarray, offsets: np.ndarray, own_bytes: int, lang: np.ndarray, names: list[str]):
    """One row of ``BLOCKS`` (None without words): texts ``data[offsets[i]:offsets[i + 1]]`` of language ``lang[i]``."""
    import pyarrow as pa
    kind = _KIND[data]
    word = kind == _WORD
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], word[:-1]]) & ~edge[:-1]
    after = np.concatenate([word[1:], [False]]) & ~edge[1:]
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    if not len(start):
        return None
    text = np.searchsorted(offsets, start, "right") - 1
    piece = np.cumsum(kind == _BREAK, dtype=np.int64)[start] + text
    place = np.arange(len(start)) + np.concatenate([[0], np.cumsum(piece[1:] != piece[:-1])])
    ends = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    strings = pa.StringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(FOLD[data[word]])).dictionary_encode()
    m = len(strings.dictionary)
    groups, item = np.unique(lang[text] * np.int64(m) + strings.indices.to_numpy(), return_inverse=True)
    own = int(np.searchsorted(start, own_bytes, "left"))
    count = np.bincount(item[:own], minlength=len(groups))
    of = groups // m                                            # ascending: words stand by language
    langs = [{"lang": names[i], "words": int(np.count_nonzero(of == i)), "occurrences": int(count[of == i].sum())} for i in np.unique(of)]
    taken = strings.dictionary.take(pa.array(groups % m))
    data, lengths = utf8_buffers(taken)
    bound = int(place[own]) if own < len(place) else int(place[-1]) + 1
    values = [number, bound, len(place), _packed(np.diff(place, prepend=0), "<i4"), _packed(item, "<i4"), langs,
              _packed(np.diff(lengths), "<i4"), _packed(data, "u1"), _packed(count, "<i4")]
    struct = pa.struct([("lang", pa.string()), ("words", pa.int32()), ("occurrences", pa.int64())])
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(struct), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)],
                                      names=["block", "own", "n", "place", "item", "langs", "lengths", "strings", "counts"])


def _blocks_of(limit: int):
    def run(batches: Iterator) -> Iterator:
        from pyspark import TaskContext
        first, made = TaskContext.get().partitionId() << _SEQUENCE_BITS, 0
        for b in batches:
            raw, offsets = utf8_buffers(b.column("text"))
            codes = b.column("lang").dictionary_encode()
            names, lang = codes.dictionary.to_pylist(), codes.indices.to_numpy().astype(np.int64)
            for lo, hi in row_blocks(offsets, limit):
                data, at = raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
                for a, own, e in [(0, len(data), len(data))] if hi - lo > 1 else _cuts(data, limit):
                    row = _block(first + made, data[a:e], at if hi - lo > 1 else np.array([0, e - a]), own - a, lang[lo:hi], names)
                    if row is not None:
                        made += 1
                        yield row

    return run


def _ids(r: dict) -> np.ndarray:
    """Numbers of a relation's groups, ascending."""
    return np.cumsum(_unpacked(r["ids"], r["m"], "<i8"), dtype=np.int64)


def _read(r: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(_unpacked(r["place"], r["n"], "<i4"), dtype=np.int64), _unpacked(r["item"], r["n"], "<i4").astype(np.int64)


def _merge_join(place: np.ndarray, item: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The relation joined with itself by adjacent place: ``(place, pair number,
    pairs)``, a pair being ``left * m + right``."""
    at = np.flatnonzero(place[1:] == place[:-1] + 1)
    pairs, number = np.unique(item[at] * np.int64(m) + item[at + 1], return_inverse=True)
    return place[at], number, pairs


def _dealt(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """``(bucket, positions)``, positions ascending."""
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cut):
        if len(part):
            yield int(bucket[part[0]]), part


def _words_of(r: dict) -> Iterator[tuple[str, int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(language, first word, bytes, offsets, counts)`` of a block's words."""
    total = sum(x["words"] for x in r["langs"])
    ends = np.concatenate([[0], np.cumsum(_unpacked(r["lengths"], total, "<i4"), dtype=np.int64)])
    data, counts, at = _unpacked(r["strings"], int(ends[-1]), "u1"), _unpacked(r["counts"], total, "<i4"), 0
    for x in r["langs"]:
        n = x["words"]
        yield x["lang"], at, data[ends[at]:ends[at + n]], ends[at:at + n + 1] - ends[at], counts[at:at + n]
        at += n


def _word_buckets(data: np.ndarray, offsets: np.ndarray, buckets: int) -> np.ndarray:
    return (hash_ranges(data, offsets[:-1], offsets[1:]) % np.uint64(buckets)).astype(np.int64)


def _pair_buckets(left: np.ndarray, right: np.ndarray, buckets: int) -> np.ndarray:
    key = mix(left.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64)
    return (mix(key) % np.uint64(buckets)).astype(np.int64)


def _sent(rows: list) -> "pa.RecordBatch":
    import pyarrow as pa
    kinds = [pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["bucket", "block", "lang", "n", "a", "b", "counts"])


def _send_words(buckets: int):
    """A block's words: ``a`` has their lengths, ``b`` their bytes."""
    def run(batches: Iterator) -> Iterator:
        for b in batches:
            for r in b.to_pylist():
                rows = []
                for lang, _, data, offsets, counts in _words_of(r):
                    words = _strings(data, offsets)
                    for bucket, at in _dealt(_word_buckets(data, offsets, buckets)):
                        own, ends = utf8_buffers(words.take(_indices(at)))
                        rows.append((bucket, r["block"], lang, len(at), _packed(np.diff(ends), "<i4"), _packed(own, "u1"), _packed(counts[at], "<i4")))
                yield _sent(rows)

    return run


def _strings(data: np.ndarray, offsets: np.ndarray):
    import pyarrow as pa
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def _indices(at: np.ndarray):
    import pyarrow as pa
    return pa.array(at, pa.int64())


def _send_pairs(buckets: int):
    """Groups of a block's self-join, with the occurrences that are its own:
    ``a`` has the left numbers' differences, ``b`` the right ones' halves."""
    def run(batches: Iterator) -> Iterator:
        for b in batches:
            for r in b.to_pylist():
                ids = _ids(r)
                place, number, pairs = _merge_join(*_read(r), len(ids))
                if not len(pairs):
                    continue
                count = np.bincount(number[place < r["own"]], minlength=len(pairs))
                left, right = ids[pairs // len(ids)], ids[pairs % len(ids)]
                yield _sent([(bucket, r["block"], None, len(at), _packed(np.diff(left[at], prepend=0), "<i8"),
                              _packed(np.concatenate([right[at] >> _RANK_BITS, right[at] & 0xFFFFFFFF]), "<u4"), _packed(count[at], "<u4"))
                             for bucket, at in _dealt(_pair_buckets(left, right, buckets))])

    return run


def _answers(rows: list, group: np.ndarray, f: np.ndarray, support: int) -> tuple[np.ndarray, list]:
    """Numbers of the frequent groups (-1 for others), and for each row sent the
    positions and numbers of its frequent ones."""
    bucket = rows[0]["bucket"]
    ids = np.full(len(f), -1, np.int64)
    often = np.flatnonzero(f >= support)
    ids[often] = (np.int64(bucket) << _RANK_BITS) + np.arange(len(often))
    out, lo = [], 0
    for r in rows:
        own = ids[group[lo:lo + r["n"]]]
        lo += r["n"]
        at = np.flatnonzero(own >= 0)
        if len(at):
            out.append((r["block"], bucket, r["lang"], len(at), _packed(np.diff(at, prepend=0), "<u4"), _packed(own[at] & 0xFFFFFFFF, "<u4"), None))
    return ids, out


def _found(rows: list, groups: list, bucket: int):
    import pyarrow as pa
    struct = pa.struct([("id", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("l", pa.int64()), ("r", pa.int64()), ("f", pa.int64())])
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.list_(struct)]
    rows = rows + [(None, bucket, None, 0, None, None, groups)] if groups else rows
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["block", "bucket", "lang", "n", "at", "ids", "groups"])


def _sum_words(support: int):
    """A bucket's words: counts over all blocks, the frequent ones, and the answers."""
    def run(table):
        import pyarrow as pa
        rows = sorted(table.to_pylist(), key=lambda r: (r["lang"], r["block"]))
        langs = sorted({r["lang"] for r in rows})
        number = {x: i for i, x in enumerate(langs)}
        parts = []
        for r in rows:
            ends = np.concatenate([[0], np.cumsum(_unpacked(r["a"], r["n"], "<i4"), dtype=np.int64)])
            parts.append(_strings(_unpacked(r["b"], int(ends[-1]), "u1"), ends))
        words = pa.concat_arrays(parts).dictionary_encode()
        m = len(words.dictionary)
        lang = np.repeat([number[r["lang"]] for r in rows], [r["n"] for r in rows])
        keys, group = np.unique(lang * np.int64(m) + words.indices.to_numpy(), return_inverse=True)
        f = np.zeros(len(keys), np.int64)
        np.add.at(f, group, np.concatenate([_unpacked(r["counts"], r["n"], "<i4") for r in rows]))
        ids, out = _answers(rows, group, f, support)
        often = np.flatnonzero(ids >= 0)
        names = words.dictionary.take(_indices(keys[often] % m)).to_pylist()
        groups = [{"id": i, "lang": langs[x], "word": w, "f": n} for i, x, w, n in
                  zip(ids[often].tolist(), (keys[often] // m).tolist(), names, f[often].tolist())]
        return _found(out, groups, rows[0]["bucket"])

    return run


def _sum_pairs(support: int):
    """The same for a bucket's groups of two overlapping phrases."""
    def run(table):
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        left = np.concatenate([np.cumsum(_unpacked(r["a"], r["n"], "<i8")) for r in rows])
        halves = [_unpacked(r["b"], 2 * r["n"], "<u4").astype(np.int64) for r in rows]
        right = np.concatenate([(h[:len(h) // 2] << _RANK_BITS) + h[len(h) // 2:] for h in halves])
        count = np.concatenate([_unpacked(r["counts"], r["n"], "<u4") for r in rows]).astype(np.int64)
        order = np.lexsort((right, left))
        l, r = left[order], right[order]
        first = np.concatenate([[True], (l[1:] != l[:-1]) | (r[1:] != r[:-1])])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(first) - 1
        f = np.add.reduceat(count[order], np.flatnonzero(first))
        ids, out = _answers(rows, group, f, support)
        often = np.flatnonzero(ids >= 0)
        l, r = l[first][often], r[first][often]
        groups = [{"id": i, "l": x, "r": y, "f": n} for i, x, y, n in zip(ids[often].tolist(), l.tolist(), r.tolist(), f[often].tolist())]
        return _found(out, groups, rows[0]["bucket"])

    return run


def _relation(r: dict | None, place: np.ndarray, item: np.ndarray, local: list, ids: list, total: int):
    """Semi-join of occurrences with the frequent groups (their local numbers
    and numbers): a table of at most one row of ``RELATION``."""
    import pyarrow as pa
    n = 0
    if local:
        local, ids = np.concatenate(local), np.concatenate(ids)
        order = np.argsort(ids)                    # pairs of items then stand in the order of their numbers
        new = np.full(total, -1, np.int64)
        new[local[order]] = np.arange(len(order))
        item = new[item]
        kept = item >= 0
        place, item, ids = place[kept], item[kept], ids[order]
        n = int(len(place) > 0)
    values = [r["block"], r["own"], len(place), _packed(np.diff(place, prepend=0), "<i4"), _packed(item, "<i4"),
              len(ids), _packed(np.diff(ids, prepend=0), "<i8")] if n else []
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
    return pa.table([pa.array(values[i:i + 1], k) for i, k in enumerate(kinds)], names=["block", "own", "n", "place", "item", "m", "ids"])


def _answered(answers, at_of) -> tuple[list, list]:
    """Local numbers and numbers of the groups in a block's answers; ``at_of``
    gives the local numbers of the row sent to a bucket."""
    local, ids = [], []
    for a in answers.to_pylist():
        local.append(at_of[a["bucket"], a["lang"]][np.cumsum(_unpacked(a["at"], a["n"], "<u4"), dtype=np.int64)])
        ids.append((np.int64(a["bucket"]) << _RANK_BITS) + _unpacked(a["ids"], a["n"], "<u4").astype(np.int64))
    return local, ids


_NOTHING = np.zeros(0, np.int64)


def _first_relation(buckets: int):
    """Co-group of a block of words with its frequent words."""
    def run(left, right):
        if not (left.num_rows and right.num_rows):
            return _relation(None, _NOTHING, _NOTHING, [], [], 0)
        r = left.to_pylist()[0]
        sent = {(bucket, lang): first + at for lang, first, data, offsets, _ in _words_of(r)
                for bucket, at in _dealt(_word_buckets(data, offsets, buckets))}
        place, item = _read(r)
        return _relation(r, place, item, *_answered(right, sent), sum(x["words"] for x in r["langs"]))

    return run


def _next_relation(buckets: int):
    """Co-group of a block of k-word phrases with its frequent ones of k + 1 words."""
    def run(left, right):
        if not (left.num_rows and right.num_rows):
            return _relation(None, _NOTHING, _NOTHING, [], [], 0)
        r = left.to_pylist()[0]
        ids = _ids(r)
        place, number, pairs = _merge_join(*_read(r), len(ids))
        sent = {(bucket, None): at for bucket, at in _dealt(_pair_buckets(ids[pairs // len(ids)], ids[pairs % len(ids)], buckets))}
        return _relation(r, place, number, *_answered(right, sent), len(pairs))

    return run


def _sum(a: Column, b: Column) -> Column:
    return a.cast("decimal(20,0)") + b.cast("decimal(20,0)")


def _scored(phrases: DataFrame, words: int) -> DataFrame:
    """``l``, ``r`` and ``score`` of the lowest-scoring cut (ties: the first)."""
    product = F.lit(SCALE).cast("decimal(7,0)") * F.col("f").cast("decimal(20,0)")
    cuts = []
    for k in range(1, words):
        first, rest = F.get("heads", F.lit(k - 1)), F.get("tails", F.lit(words - k - 1))
        score = F.call_function("div", product, _sum(first, rest))
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), first.alias("l"), rest.alias("r")))
    return phrases.withColumn("cut", F.array_min(F.array(*cuts)))


def mine(docs: DataFrame, support: int = SUPPORT, top: int = TOP, block: int = BLOCK,
         bucket_groups: int = BUCKET_GROUPS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's ``top``
    phrases of 2 to 4 words, from ``docs(text, lang)``."""
    spark = docs.sparkSession
    prepare(spark)
    folder = work_path(spark, f"setm-{uuid.uuid4().hex}")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    def buckets_for(relation: DataFrame) -> int:
        """Enough buckets for all occurrences, of which a block's equal ones are sent as one."""
        total = relation.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
        return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // bucket_groups))

    def counted(sent: DataFrame, summing, name: str) -> DataFrame:
        return stored(sent.groupBy("bucket").applyInArrow(summing, FOUND), name)

    def groups_of(found: DataFrame) -> DataFrame:
        return found.where("groups is not null").select(F.inline("groups"))

    def related(blocks: DataFrame, found: DataFrame, joining, name: str) -> DataFrame:
        answers = found.where("block is not null").select("block", "bucket", "lang", "n", "at", "ids")
        return stored(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(joining, RELATION), name)

    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    blocks = stored(texts.mapInArrow(_blocks_of(block), BLOCKS), "blocks")
    buckets = buckets_for(blocks)
    found = counted(blocks.mapInArrow(_send_words(buckets), SENT), _sum_words(support), "frequent1")
    phrases = [groups_of(found).select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f",
                                       F.array("f").alias("heads"), F.array("f").alias("tails"))]
    relation = related(blocks, found, _first_relation(buckets), "relation1")
    kept = []
    for k in range(2, LONGEST + 1):
        buckets = buckets_for(relation)
        found = counted(relation.mapInArrow(_send_pairs(buckets), SENT), _sum_pairs(support), f"frequent{k}")
        if k < LONGEST:
            relation = related(relation, found, _next_relation(buckets), f"relation{k}")
        named = groups_of(found).select("id", "l", "r", "f")
        a = phrases[-1].select(F.col("id").alias("l"), "lang", "phrase", "heads")
        b = phrases[-1].select(F.col("id").alias("r"), "last", "tails")
        phrases.append(stored(named.join(a, "l").join(b, "r").select(
            "id", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f",
            F.concat("heads", F.array("f")).alias("heads"), F.concat("tails", F.array("f")).alias("tails")), f"phrases{k}"))
        if k > 2:                      # the phrases one word shorter that these contain
            longer = named.select(F.col("l").alias("id"), "f").unionByName(named.select(F.col("r").alias("id"), "f"))
            longer = longer.groupBy("id").agg(F.max("f").alias("longer"))
            kept[-1] = (phrases[-2].join(longer, "id", "left")
                        .where(F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("f").cast("decimal(20,0)") * CONTAINED_PERCENT))
                        .select(*phrases[-2].columns))
        kept.append(phrases[-1])
    scored = [_scored(p, k).select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score") for k, p in enumerate(kept, 2)]
    rows = scored[0].unionByName(scored[1]).unionByName(scored[2])
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # At most ``top`` rows of each salt reach a language's ranking.
    salt = F.pmod(F.xxhash64("phrase"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = (rows.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best)))
            .where(F.col("rank") <= top).drop("salt", "rank"))
    ranked = ordered_scan(rows, "lang", best, pos_col="rank").where(F.col("rank") <= top)
    n = blocks.select(F.inline("langs")).groupBy("lang").agg(F.sum("occurrences").alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
