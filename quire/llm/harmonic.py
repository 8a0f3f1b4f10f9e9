"""Harmonic packing of tokenized documents into fixed-length sequences.

Piece lengths are dealt into reciprocal classes: class ``k`` holds lengths in
``(C / (k + 1), C / k]`` of the capacity ``C`` and its bins take exactly ``k``
pieces.  A document is cut first so that its pieces fill their class: whole
pieces of ``C`` (class 1), then pieces of ``C / 2, C / 4, ...`` down to
``grain`` (classes 2, 4, ...), whose bins come out full, and one tail shorter
than ``grain``, whose bins (class ``C // length``) waste less than ``grain``
tokens.  What a worker has in unfinished bins at its end is laid end to end
and cut at ``C`` and then at powers of two, which need no padding.

Every task packs its own rows: no shuffle, no state between workers, and a
lost task is packed again on its own.  Memory of a task is its Arrow batch,
a bounded cache of words and at most one open bin per class.

Edge cases: a null or empty text is the end token alone; special strings of the
tokenizer in a text are their ids, unless ``plain``; repeated rows are
packed once each; a null id is kept; an empty table gives no piece.  The
result has its own columns, so none of the input's can clash.
"""
from __future__ import annotations

import json
import unicodedata
from array import array
from collections import defaultdict
from typing import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, row_blocks, utf8_buffers

CAPACITY = 4096
GRAIN = 64
CACHE = 300_000          # stretches, and pieces of them, whose ids a worker remembers
BLOCK_BYTES = 4 << 20    # bytes of text encoded at a time (a longer text alone)

#: What separates stretches: blanks and line ends of ASCII.
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0D]] = True


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class WordEncoder:
    """Ids of whole texts by a tokenizer whose pre-tokenization never joins
    what a blank or line end separates, so each stretch between them is
    encoded once and found again in a cache of at most ``cache`` entries.
    Stretches of a batch are told apart by Arrow's dictionary encoding, so only
    its distinct ones are looked up one by one.

    For the normalizers and splitting rules read below from the tokenizer's
    own file, stretches are split here and only new pieces go to its model;
    for any other file each new stretch goes to ``encode_batch``.

    The tokenizer's special strings become their ids wherever they stand in a
    text, as its library has it; ``plain`` reads them as ordinary text instead.
    """

    def __init__(self, path: str, cache: int = CACHE, plain: bool = False):
        import re

        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_str(json.dumps(spec))
        self.tokenizer.encode_special_tokens = plain
        special = [] if plain else spec.get("added_tokens") or []
        self.special = {t["content"]: array("I", [t["id"]]).tobytes() for t in special}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=lambda x: -len(x))))) if special else None
        self.cache = cache
        self.model = self.tokenizer.model
        simple = all(not re.search(r"\s", t["content"]) and not any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in special)
        if special and not simple:
            raise ValueError("added strings with blanks or rules of their own are not supported")
        self.pieces = self._splitter(spec)
        self._clear()

    def _clear(self) -> None:
        self.index, self.known = {}, {}
        self.starts, self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    @staticmethod
    def _splitter(spec: dict) -> Callable[[str], list[str]] | None:
        norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        steps, parts = norm.get("normalizers", []), pre.get("pretokenizers", [])
        if ([s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or steps[1]["pattern"] != {"Regex": "\\s+"}
                or [p["type"] for p in parts] != ["Split", "ByteLevel"] or parts[1]["use_regex"]
                or parts[1]["add_prefix_space"] or parts[0]["behavior"] != "Removed" or not parts[0]["invert"]):
            return None
        import regex
        find = regex.compile(parts[0]["pattern"]["Regex"]).findall
        letters = {b: c for b, c in _byte_letters().items()}
        table = str.maketrans({chr(b): c for b, c in letters.items()})

        def split(low: str) -> list[str]:
            return [p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(table)
                    for p in find(low)]
        return split

    @staticmethod
    def _normal(text: str) -> str:
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _ids(self, new: list[str]) -> list[bytes]:
        """Ids of each stretch as unsigned 32-bit integers (bytes take a
        fraction of the memory of lists)."""
        if self.pieces is None:
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(new, add_special_tokens=False)]
        known, pieces, tokenize = self.known, self.pieces, self.model.tokenize

        def of(p: str) -> bytes:
            known[p] = got = array("I", [t.id for t in tokenize(p)]).tobytes()
            return got

        def plain(low: str) -> bytes:
            if low.isascii() and low.isalpha():          # letters alone are one piece
                return known.get(low) or of(low)
            return b"".join([known.get(p) or of(p) for p in pieces(low)])

        def cut(word: str) -> bytes:
            at, parts = 0, []
            for m in self.cut.finditer(word):
                parts += [plain(self._normal(word[at:m.start()])), self.special[m[0]]]
                at = m.end()
            return b"".join([*parts, plain(self._normal(word[at:]))])

        joined = "\n".join(new)                          # no stretch has a line end; all are lower-cased at once
        out = [plain(low) for low in self._normal(joined).split("\n")]
        if any(s in joined for s in self.special):
            out = [cut(w) if self.cut.search(w) else ids for w, ids in zip(new, out)]
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`encode_bytes` of a list of texts."""
        raw = [t.encode() for t in texts]
        return self.encode_bytes(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)]))

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts ``data[offsets[i]:offsets[i + 1]]`` in one array,
        and the ``n + 1`` places where texts begin."""
        import pyarrow as pa
        import pyarrow.compute as pc
        if len(self.index) > self.cache or len(self.known) > self.cache:
            self._clear()
        word = ~_BLANK[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        start = np.flatnonzero(word & (edge[:-1] | ~np.concatenate([[False], word[:-1]])))
        end = np.flatnonzero(word & (edge[1:] | ~np.concatenate([word[1:], [False]]))) + 1
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        ends = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
        stretches = pa.StringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(data[word])).dictionary_encode()
        # No stretch has a line end, so one string and a split give them all.
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(stretches.dictionary)], pa.int32()), stretches.dictionary), "\n")
        distinct = joined[0].as_py().split("\n")
        index = self.index
        number = list(map(index.get, distinct))
        if None in number:
            at = [i for i, n in enumerate(number) if n is None]
            new = [distinct[i] for i in at]
            first = len(index)
            index.update(zip(new, range(first, first + len(new))))
            for i, n in zip(at, range(first, first + len(new))):
                number[i] = n
            ids = self._ids(new)
            lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            at = len(self.flat) + np.cumsum(lengths) - lengths
            self.starts, self.lengths = np.concatenate([self.starts, at]), np.concatenate([self.lengths, lengths])
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), np.uint32)])
        words = np.array(number, np.int64)[stretches.indices.to_numpy()]
        lengths = self.lengths[words]
        last = np.concatenate([[0], np.cumsum(lengths)])
        flat = self.flat[np.repeat(self.starts[words] - last[:-1], lengths) + np.arange(int(last[-1]))]
        return flat, last[np.searchsorted(start, offsets, "left")]


def piece_lengths(n: int, capacity: int = CAPACITY, grain: int = GRAIN) -> list[int]:
    """Lengths of the pieces a document of ``n`` tokens is cut into."""
    out = [capacity] * (n // capacity)
    rest, size = n % capacity, capacity // 2
    while size >= grain:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    return out + [rest] * (rest > 0)


class _Packer:
    def __init__(self, capacity: int, grain: int, first_sequence: int):
        self.capacity, self.grain, self.next = capacity, grain, first_sequence
        self.open: dict[int, list[tuple]] = defaultdict(list)
        self.rows: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, tokens in pieces:
            self.rows.append((doc, start, len(ids), ids.tobytes(), tokens, self.next, offset))
            offset += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> None:
        start = 0
        for n in piece_lengths(len(ids), self.capacity, self.grain):
            k = self.capacity // n
            held = self.open[k]
            held.append((doc, start, ids[start:start + n].copy(), len(ids)))
            start += n
            if len(held) == k:
                self._close(self.open.pop(k))

    def finish(self) -> None:
        """Unfinished bins: end to end, cut at the capacity and then at powers of two."""
        left = [p for k in sorted(self.open) for p in self.open[k]]
        self.open.clear()
        total = sum(len(p[2]) for p in left)
        sizes = [self.capacity] * (total // self.capacity)
        rest = total % self.capacity
        sizes += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        queue = iter(left)
        doc, start, ids, tokens = next(queue, (None, 0, np.zeros(0, np.uint32), 0))
        for size in sizes:
            here = []
            while size:
                if not len(ids):
                    doc, start, ids, tokens = next(queue)
                take = min(size, len(ids))
                here.append((doc, start, ids[:take], tokens))
                start, ids, size = start + take, ids[take:], size - take
            self._close(here)


def pack(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, grain: int = GRAIN, cache: int = CACHE, plain: bool = False) -> DataFrame:
    """One row per piece: the document's id, ``start`` (ids of the document
    before the piece), ``length``, ``ids`` (little-endian unsigned 32-bit),
    ``doc_tokens``, ``sequence_id`` and ``offset`` in that sequence.

    ``capacity`` and ``grain`` are powers of two.  ``tokenizer`` is the path
    of a vocabulary file that every worker can read; with ``plain`` its special
    strings in a text are ordinary text.
    """
    if capacity & (capacity - 1) or grain & (grain - 1) or not 0 < grain <= capacity:
        raise ValueError("capacity and grain must be powers of two, grain at most the capacity")
    prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = src.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("start", T.LongType()),
                           T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
                           T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        encoder = encoder_for(tokenizer, cache, plain)
        packer = _Packer(capacity, grain, TaskContext.get().partitionId() << 33)

        def out():
            rows, packer.rows = packer.rows, []
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        for batch in batches:
            data, offsets = utf8_buffers(batch.column(1))
            for lo, hi in row_blocks(offsets, BLOCK_BYTES):
                keys = batch.column(0).slice(lo, hi - lo).to_pylist()
                flat, at = encoder.encode_bytes(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                for i, key in enumerate(keys):
                    packer.add(key, np.append(flat[at[i]:at[i + 1]], np.uint32(end_id)).astype("<u4", copy=False))
                if packer.rows:
                    yield out()
        packer.finish()
        if packer.rows:
            yield out()

    return src.mapInArrow(run, schema)


_ENCODERS: dict[tuple, WordEncoder] = {}


def encoder_for(path: str, cache: int, plain: bool = False) -> WordEncoder:
    """One encoder per worker process, so later tasks find its cache filled."""
    if (path, cache, plain) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, cache, plain] = WordEncoder(path, cache, plain)
    return _ENCODERS[path, cache, plain]
