"""Word hashes of whole Arrow text columns, computed on the column's byte buffer.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing ``A-Z``. A word's hash is a
polynomial over its bytes modulo 2^64, mixed; it is the same in every task and run.
Only Python helpers for use inside tasks: Spark partitions and shuffles the work.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 16


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every input bit over the whole 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
with np.errstate(over="ignore"):
    _BYTE_CODE = mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_BASE))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, _BLOCK), _powers(_INVERSE, _BLOCK)


def _word_bounds(data: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; a document's start always separates words."""
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = doc_starts[(doc_starts > 0) & (doc_starts < len(data))]
    first[inner] = word[inner]
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[inner - 1] = word[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hash_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges ``data[start[i]:end[i]]`` (ascending, apart from each
    other), a block of bytes at a time."""
    out = np.zeros(len(start), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for lo in range(0, len(data), _BLOCK):
            code = _BYTE_CODE[data[lo:lo + _BLOCK]]
            n = len(code)
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(code * _DOWN[:n], out=total[1:])
            a, b = np.searchsorted(end, lo, "right"), np.searchsorted(start, lo + n, "left")
            s, e = start[a:b] - lo, np.minimum(end[a:b] - lo, n)
            head = np.maximum(s, 0)
            # a word cut by the block border adds up over both blocks: the part that
            # lies in this block is shifted by the bytes that came before it
            part = (total[e] - total[head]) * _UP[np.minimum(head, n - 1)]
            before = head - s
            if before.any():
                cut = np.flatnonzero(before)
                part[cut] *= np.array([pow(_INVERSE, int(k), 1 << 64) for k in before[cut]],
                                      dtype=np.uint64)
            out[a:b] += part
        return mix64(out ^ ((end - start).astype(np.uint64) * np.uint64(_BASE)))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(data, offsets)``: text ``i`` is ``data[offsets[i]:offsets[i + 1]]``; null counts as empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + n + 1]
    buf = texts.buffers()[2]
    if buf is None or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(buf, dtype=np.uint8)[bounds[0]:bounds[-1]], bounds - bounds[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, offsets)``: document ``i`` has ``hashes[offsets[i]:offsets[i + 1]]``.

    A null text counts as empty."""
    data, bounds = text_bytes(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    start, end = _word_bounds(data, bounds[:-1])
    return hash_bytes(_LOWER[data], start, end), np.searchsorted(start, bounds, "left")


def slices(texts: pa.Array, max_bytes: int = 4 << 20):
    """``(lo, hi)`` row ranges whose texts hold about ``max_bytes`` at most (one row at least)."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(size)])
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + max_bytes, "right")) - 1)
        yield lo, hi
        lo = hi


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k``-word windows of each document, repeats included, with offsets.

    A document of one to ``k - 1`` words has one window: its whole sequence."""
    n = np.diff(offsets)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    out_off = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(n)), count)
    at = np.arange(out_off[-1]) - out_off[:-1][doc] + offsets[:-1][doc]
    size = np.minimum(n, k)[doc]
    h = np.zeros(len(at), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            inside = size > j
            h = np.where(inside, mix64(h * np.uint64(_BASE) + words[np.minimum(at + j, len(words) - 1)]), h) \
                if len(words) else h
        h = mix64(h + size.astype(np.uint64))
    return h, out_off
