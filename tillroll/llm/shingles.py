"""Words and word shingles of whole texts as 64-bit hashes, in numpy.

Words are runs of characters other than blank and U+0009-U+000D, with A-Z
lower-cased; a word's hash is a polynomial over its UTF-8 bytes modulo 2^64,
read off one running sum over the batch, and mixed. No Python string is made
per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False
_PLACE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
SLICE = 1 << 20  # bytes hashed together (a longer text is taken whole)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE + 1)
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0], _powers[1]


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (NULL: none) and where each begins and ends."""
    texts = texts.fill_null("") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array):
    """Slices of (first row, hashes of all words, words per text)."""
    if not len(texts):
        return
    data, offsets = _buffers(texts)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, "right")) - 1)
        yield a, *_words(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        a = b


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    inside = _WORD[data]
    before = np.concatenate(([False], inside[:-1]))
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.concatenate((inside[1:], [False]))
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    up, down = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = (total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)
    return mix(h), np.diff(np.searchsorted(start, offsets))


def shingle_sets(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct five-word shingles of each text, ascending, and how many; a
    text of one to four words is one shingle."""
    ends = np.cumsum(counts)
    starts = ends - counts
    k = len(_PLACE)
    out, sizes = [], np.zeros(len(counts), np.int64)
    if len(hashes) >= k:
        rolled = hashes[:len(hashes) - k + 1] * _PLACE[0]
        for j in range(1, k):
            rolled = rolled + hashes[j:len(hashes) - k + 1 + j] * _PLACE[j]
        rolled = mix(rolled)
    for i, (a, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        if e - a >= k:
            s = np.sort(rolled[a:e - k + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif e > a:
            s = mix((hashes[a:e] * _PLACE[:e - a]).sum(keepdims=True) + np.uint64(e - a))
        else:
            continue
        sizes[i] = len(s)
        out.append(s)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes
