"""Words and word n-grams of whole Arrow string columns, as 64-bit hashes, in numpy.

A word is a run of ``a-z``, ``0-9`` and non-ASCII characters of the lower-case
text: in SQL ``regexp_extract_all(lower(text), '[a-z0-9\\x{80}-\\x{10FFFF}]+')``.
Lower-casing is left to the JVM. No Python object is made for a word, which is
what makes a pass over all words of a corpus cheap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20240607)
BYTE = (_rng.integers(1, 2**63, 256, dtype=np.uint64) << U(1)) | U(1)
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
BYTE[~IS_WORD] = 0
MULT = U(0x9E3779B97F4A7C15)
ORDER = _rng.integers(1, 2**63, 64, dtype=np.uint64) | U(1)
#: Bytes of text that are worked on at once; bounds the memory of a task.
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads entropy over all bits."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


_POW = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        _POW = np.concatenate([np.ones(1, dtype=np.uint64), np.cumprod(np.full(max(n, 256) - 1, MULT, dtype=np.uint64))])
    return _POW


def _hash(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in ``data`` and how many each row has; rows are cut at ``offsets``."""
    rows = len(offsets) - 1
    if not len(data):
        return np.empty(0, dtype=np.uint64), np.zeros(rows, dtype=np.int64)
    word = IS_WORD[data]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    cut = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[cut] = word[cut]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return np.empty(0, dtype=np.uint64), np.zeros(rows, dtype=np.int64)
    data = data[starts[0] :]
    counts = np.diff(np.searchsorted(starts, offsets))
    starts = starts - starts[0]
    length = np.diff(starts, append=len(data))
    at = np.arange(len(data), dtype=np.int32) - np.repeat(starts.astype(np.int32), length)
    value = BYTE[data]
    value *= _powers(int(length.max()) + 1)[at]
    return mix(np.add.reduceat(value, starts)), counts


def words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Chunks of rows: (first row, row after the last, hashes of their words, words of each row).

    A row is never cut; a chunk has at least one row. A null is an empty text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    _, off, buf = column.buffers()
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None else np.empty(0, dtype=np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, side="right")) - 1)
        b = min(b, n)
        yield a, b, *_hash(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        a = b


def ngrams(h: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams, the row of each, and the place of its first word in ``h``.

    A row of 1 to n-1 words has one n-gram, of all its words.
    """
    total = len(h)
    first = np.concatenate([[0], np.cumsum(counts)])
    row = np.repeat(np.arange(len(counts)), counts)
    if total >= n:
        g = h[: total - n + 1] * ORDER[0]
        for k in range(1, n):
            g += h[k : total - n + 1 + k] * ORDER[k]
        ok = row[: total - n + 1] == row[n - 1 :]
        at = np.flatnonzero(ok)
        g, where = g[ok], row[at]
    else:
        g, where, at = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        extra = np.array([np.add.reduce(h[first[r] : first[r + 1]] * ORDER[32 : 32 + counts[r]]) for r in short], dtype=np.uint64)
        g, where, at = np.concatenate([g, extra]), np.concatenate([where, short]), np.concatenate([at, first[short]])
        o = np.argsort(where, kind="stable")
        g, where, at = g[o], where[o], at[o]
    return mix(g), where, at


def sets(g: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of each row, sorted within it, and how many each row has."""
    cut = np.searchsorted(row, np.arange(rows + 1))
    each = [np.unique(g[cut[r] : cut[r + 1]]) for r in range(rows)]
    return (np.concatenate(each) if each else g[:0]), np.array([len(x) for x in each], dtype=np.int64)
