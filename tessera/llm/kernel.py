"""Whole texts as flat byte arrays: the numpy kernel behind the Arrow operators.

An Arrow string column is one byte buffer with offsets.  Words, word hashes,
shingles and byte n-grams of *all* texts of a chunk are computed with a few
array operations, so the cost per byte does not depend on Python.  A chunk is
about a megabyte of text (or one longer text), which bounds the memory of a
task whatever the batch size.  Texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: word bytes of ``[^\x20\x09-\x0D]+``
SOLID = np.ones(256, dtype=bool)
SOLID[[9, 10, 11, 12, 13, 32]] = False
#: letters, digits and every byte of a non-ASCII character
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
ALNUM[128:] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_pow = np.ones(1, dtype=U64)
_inv = np.ones(1, dtype=U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, mod 2^64."""
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, CHUNK + 4096)
        for name, base in (("_pow", _BASE), ("_inv", _INV)):
            p = np.full(size, base, dtype=U64)
            p[0] = 1
            globals()[name] = np.cumprod(p, dtype=U64)
    return _pow[:n], _inv[:n]


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on all of them."""
    h = h + U64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    h = (h ^ (h >> U64(31))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(29))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(32))


def chunks(col: pa.Array | pa.ChunkedArray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``limit``
    bytes; a null text counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        base = 0
        for part in col.chunks:
            for lo, hi, data, offs in chunks(part, limit):
                yield base + lo, base + hi, data, offs
            base += len(part)
        return
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    n = len(col)
    if n == 0:
        return
    _, off, data = col.buffers()
    offs = np.frombuffer(off, dtype=np.int64)[col.offset:col.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, raw[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def runs(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text index of each maximal run of true bytes in a text."""
    n = len(mask)
    if n == 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = mask[:-1]
    starts = np.flatnonzero(mask & (~before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = mask[1:]
    ends = np.flatnonzero(mask & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; equal bytes give equal hashes anywhere."""
    n = len(data)
    p, inv = _powers(n + 1)
    pre = np.zeros(n + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * p[:n], dtype=U64, out=pre[1:])
    h = (pre[ends] - pre[starts]) * inv[starts]
    return mix(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray = SOLID):
    """(hash, text index, start, end) of the words of a lower-cased chunk."""
    low = LOWER[data]
    s, e, d = runs(table[low], offs)
    return span_hash(low, s, e), d, s, e


def window_hash(h: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start index of each window of k words inside one text."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(d[:m] == d[k - 1:])
    acc = np.zeros(len(at), dtype=U64)
    for j in range(k):
        acc = acc * U64(_BASE) + h[at + j]
    return mix(acc, k), at


def unique_pairs(d: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) pairs with their counts, sorted by text, then hash."""
    if len(h) == 0:
        return d[:0], h[:0], np.zeros(0, dtype=np.int64)
    order = np.lexsort((h, d))
    ds, hs = d[order], h[order]
    new = np.ones(len(hs), dtype=bool)
    new[1:] = (ds[1:] != ds[:-1]) | (hs[1:] != hs[:-1])
    at = np.flatnonzero(new)
    return ds[at], hs[at], np.diff(np.append(at, len(hs)))


def shingles(data: np.ndarray, offs: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles (text, hash), sorted by text; a text of fewer
    words has its whole word sequence as the only one, a text of none has none."""
    h, d, _, _ = words(data, offs)
    w, at = window_hash(h, d, k)
    docs = d[at]
    n_words = np.bincount(d, minlength=len(offs) - 1) if len(d) else np.zeros(len(offs) - 1, np.int64)
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):
        first = np.searchsorted(d, short)
        acc = np.zeros(len(short), dtype=U64)
        for j in range(k - 1):
            has = n_words[short] > j
            acc[has] = acc[has] * U64(_BASE) + h[first[has] + j]
        whole = mix(acc + n_words[short].astype(U64) * U64(0xA0761D6478BD642F), 77)
        w, docs = np.concatenate([w, whole]), np.concatenate([docs, short])
    docs, w, _ = unique_pairs(docs, w)
    return docs, w


def per_text(fn, values: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Reduce values (sorted by text index) to one number a text; 0 for none.
    ``fn`` is a ufunc such as np.add."""
    out = np.zeros((n,) + values.shape[1:], dtype=values.dtype)
    if len(d):
        at = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
        out[d[at]] = fn.reduceat(values, at, axis=0)
    return out


def int_list(values: np.ndarray, lengths: np.ndarray, kind=pa.int64()) -> pa.Array:
    """An Arrow list column from flat values and one length a row."""
    offs = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values, type=kind))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
