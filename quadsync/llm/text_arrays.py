"""Whole-batch text primitives on Arrow buffers (numpy, no per-word Python).

A string column is taken as its UTF-8 buffer with row offsets; words are found
by byte class, hashed by prefix sums of ``byte * P**i`` (mod 2**64) and
combined to shingles.  Nulls count as empty texts.  Work is cut into pieces of
whole rows of about ``PIECE`` bytes, so memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MULT = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93,
                                0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]

#: bytes of ``[^\x20\x09-\x0D]``
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
#: A-Z to a-z, all other bytes as they are
LOWER_AZ = np.arange(256, dtype=np.uint8)
LOWER_AZ[65:91] += 32


def folded(raw: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the capitals of Latin-1 (their second byte) lower-cased."""
    buf = LOWER_AZ[raw]
    if len(buf) > 1:
        capital = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        buf[1:][capital] += 32
    return buf


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MULT[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _MULT[1]
    return x ^ (x >> np.uint64(31))


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has length 0."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    col = pc.fill_null(col.cast(pa.large_string()), "")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset: col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def pieces(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, at least one row each."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b
        a = b


def word_spans(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the words of rows cut out of ``buf`` at ``offsets`` (offsets[0] = 0)."""
    if not len(buf):
        e = np.zeros(0, np.int64)
        return e, e, e
    inside = is_word[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[offsets] = True
    before = np.empty(len(buf), bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(len(buf), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | first[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for i below n, kept for the next piece."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = []
        for base in (_P, _P_INV):
            x = np.full(max(n, PIECE + 1), base, np.uint64)
            x[0] = 1
            _powers.append(np.multiply.accumulate(x))
    return _powers[0], _powers[1]


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans."""
    n = len(buf)
    power, back = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    return mix((total[end] - total[start]) * back[start])


def shingle_rows(words: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``k``-word shingles and the row of each; a row of fewer words
    (but one at least) gives its whole sequence as one."""
    count = np.bincount(row, minlength=n_rows)
    out_h, out_r = [], []
    if len(words) >= k:
        h = np.zeros(len(words) - k + 1, np.uint64)
        for j in range(k):
            h += words[j: len(words) - k + 1 + j] * _MULT[j % 5] * np.uint64(2 * (j // 5) + 1)
        ok = row[: len(h)] == row[k - 1:]
        out_h.append(mix(h[ok]))
        out_r.append(row[: len(h)][ok])
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        first = np.searchsorted(row, few)
        hs = np.zeros(len(few), np.uint64)
        for j in range(k - 1):
            has = count[few] > j
            hs[has] += words[first[has] + j] * _MULT[j % 5] * np.uint64(2 * (j // 5) + 1)
        out_h.append(mix(hs + count[few].astype(np.uint64)))
        out_r.append(few)
    if not out_h:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, r = np.concatenate(out_h), np.concatenate(out_r)
    o = np.argsort(r, kind="stable")
    return h[o], r[o]


def shingle_sets(col: pa.Array | pa.ChunkedArray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row of a string column;
    words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased."""
    raw, offsets = buffers(col)
    for a, b in pieces(offsets):
        off = offsets[a:b + 1] - offsets[a]
        buf = LOWER_AZ[raw[offsets[a]:offsets[b]]]
        start, end, row = word_spans(buf, off, NOT_SPACE)
        h, r = shingle_rows(span_hashes(buf, start, end), row, b - a, k)
        cut = np.searchsorted(r, np.arange(b - a + 1))
        for i in range(b - a):
            yield a + i, np.unique(h[cut[i]:cut[i + 1]])
