"""Word and shingle hashes of whole texts, computed on UTF-8 bytes.

Words are maximal runs of word bytes after folding A-Z, so a word class is a
table of 256 flags: every byte from 0x80 up belongs to a character outside
ASCII, which both classes used here count as a word character.  A word's hash
mixes eight bytes at a time, each group of bytes with keys of its place, so that
no relation between two words' bytes makes their hashes equal (polynomials of
bytes modulo 2^64 have such relations).  Texts are worked through in pieces of
bounded size, cut between words, so memory does not depend on a text's length
beyond its words' hashes.
"""
from __future__ import annotations

from typing import Iterator, NamedTuple

import numpy as np

from .common import row_blocks

PIECE = 1 << 20          # bytes hashed at a time
_U = np.uint64
_SIZE_KEY = _U(0x9E3779B97F4A7C15)


def _flags(word) -> np.ndarray:
    return np.array([bool(word(b)) for b in range(256)])


#: Words ``[^\x20\x09-\x0D]+``
SPACED = _flags(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased texts
ALNUM = _flags(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Folds A-Z alone.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20

_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_GROUPS = 32             # groups of eight bytes hashed for all words at once; what longer words have besides is hashed word by word


def _keys(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two keys of each place of a group, the second odd."""
    g = group.astype(np.uint64)
    return mix(g * _U(2) + _U(0xA0761D65)), mix(g * _U(2) + _U(0xE7037ED2)) | _U(1)


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes ``data[start[i]:end[i]]`` (none of them empty)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    size = end - start
    out = size.astype(np.uint64) * _SIZE_KEY
    xors, factors = _keys(np.arange(_GROUPS))
    at = None
    for k in range(_GROUPS):
        begin, left = (start, size) if at is None else (start[at] + 8 * k, size[at] - 8 * k)
        part = mix((eight[begin] & _MASK[np.minimum(left, 8)]) ^ xors[k]) * factors[k]
        if at is None:
            out += part
        else:
            out[at] += part
        more = left > 8
        at = np.flatnonzero(more) if at is None else at[more]
        if not len(at):
            break
    for i in at.tolist():
        for lo in range(8 * _GROUPS, int(size[i]), PIECE):
            offset = np.arange(lo, min(lo + PIECE, int(size[i])), 8)
            x, f = _keys(offset // 8)
            out[i:i + 1] += np.sum(mix((eight[start[i] + offset] & _MASK[np.minimum(size[i] - offset, 8)]) ^ x) * f, dtype=np.uint64)
    return mix(out)


class Words(NamedTuple):
    """Words of a run of texts: text ``i`` has words ``first[i]:first[i + 1]``;
    ``start`` and ``end`` are byte positions in the run."""
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def _piece(data: np.ndarray, breaks: np.ndarray, flags: np.ndarray):
    w = flags[data]
    before = np.empty(len(w), dtype=bool)
    before[:1] = False
    before[1:] = w[:-1]
    before[breaks] = False
    start = np.flatnonzero(w & ~before)
    after = np.empty(len(w), dtype=bool)
    after[-1:] = False
    after[:-1] = w[1:]
    after[breaks[breaks > 0] - 1] = False
    end = np.flatnonzero(w & ~after) + 1
    return hash_ranges(FOLD[data], start, end), start, end


def words(data: np.ndarray, offsets: np.ndarray, flags: np.ndarray) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i + 1]]``."""
    n = int(offsets[-1])
    hashes, starts, ends = [], [], []
    lo = 0
    while lo < n:
        hi = min(lo + PIECE, n)
        while hi < n:                       # back to a place between words
            back = np.flatnonzero(~flags[data[lo:hi]])
            if len(back):
                hi = lo + int(back[-1]) + 1
                break
            hi = min(hi + (hi - lo), n)     # one word longer than the piece
        inside = offsets[np.searchsorted(offsets, lo, "left"):np.searchsorted(offsets, hi, "left")] - lo
        h, s, e = _piece(data[lo:hi], inside, flags)
        hashes.append(h)
        starts.append(s + lo)
        ends.append(e + lo)
        lo = hi
    if not hashes:
        none = np.zeros(0, dtype=np.int64)
        return Words(none.astype(np.uint64), none, none, np.zeros(len(offsets), dtype=np.int64))
    start = np.concatenate(starts)
    return Words(np.concatenate(hashes), start, np.concatenate(ends), np.searchsorted(start, offsets, "left"))


def blocks(data: np.ndarray, offsets: np.ndarray, flags: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int, Words]]:
    """``(lo, hi, words of rows lo..hi - 1)`` over runs of rows of bounded bytes."""
    for lo, hi in row_blocks(offsets, limit):
        yield lo, hi, words(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], flags)


def _factor(k: int) -> np.uint64:
    return mix(np.array([2 * k + 0x51ED27], dtype=np.uint64))[0] | _U(1)


def rolling(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words (length ``len(h) - size + 1``)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, _U(size), dtype=np.uint64)
    for k in range(size):
        out += h[k:k + n] * _factor(k)
    return mix(out)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, text)`` of every ``size``-word run inside each text; a text of
    fewer words, but not none, gives its whole sequence."""
    count = np.diff(w.first)
    text = np.repeat(np.arange(len(count)), count)
    full = rolling(w.hash, size)
    last = np.repeat(w.first[1:], count) - size
    ok = np.arange(len(w.hash)) <= last
    at = np.flatnonzero(ok)
    out, owner = full[at], text[at]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = np.zeros(len(short), dtype=np.uint64)
        for c in np.unique(count[short]):
            own = short[count[short] == c]
            s = np.full(len(own), _U(c), dtype=np.uint64)
            for k in range(int(c)):
                s += w.hash[w.first[own] + k] * _factor(k)
            extra[count[short] == c] = mix(s)
        out, owner = np.concatenate([out, extra]), np.concatenate([owner, short])
    return out, owner


def distinct(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``(owner, hash)`` pairs, ordered by both."""
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[keep], owner[keep]
