"""Hashed word and character n-gram frequencies of whole texts.

A text's features are the relative frequencies of its words (lower-cased) and
of its byte n-grams (case kept), hashed into ``2**bits`` columns each.  A
linear score is then the mean weight of the words plus that of the n-grams,
so scoring is one gather and one segmented sum; nothing is sorted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from . import kernel as K
from .linear import Rows

#: lifts frequencies to a scale on which one step size suits all columns
SCALE = 30.0
#: bytes of sample text that the driver turns into features at a time
FIT_CHUNK = 1 << 18


@dataclass(frozen=True)
class Grams:
    bits: int = 14
    orders: tuple[int, ...] = (3,)

    @property
    def dim(self) -> int:
        return (1 + len(self.orders)) << self.bits

    def parts(self, data: np.ndarray, offs: np.ndarray):
        """(column ids, text index) of every occurrence, one pair a feature family."""
        shift = np.uint64(64 - self.bits)
        h, d, _, _ = K.words(data, offs)
        yield (h >> shift).astype(np.int64), d
        size = np.diff(offs)
        doc = np.repeat(np.arange(len(size)), size)
        for j, n in enumerate(self.orders, 1):
            m = max(len(data) - n + 1, 0)
            g = np.zeros(m, dtype=np.uint32)
            for i in range(n):
                g = g * np.uint32(0x01000193) + data[i:m + i]
            g = (g ^ (g >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            inside = doc[:m] == doc[n - 1:] if m else np.zeros(0, bool)
            yield ((g >> np.uint32(32 - self.bits)).astype(np.int64) + (j << self.bits))[inside], doc[:m][inside]

    def score(self, weights: np.ndarray, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """One score a text, or one a column of two-dimensional weights."""
        n = len(offs) - 1
        out = np.zeros((n, *weights.shape[1:]))
        for ids, d in self.parts(data, offs):
            count = np.maximum(np.bincount(d, minlength=n), 1).reshape(-1, *[1] * (weights.ndim - 1))
            out += SCALE * K.per_text(np.add, weights[ids], d, n) / count
        return out

    def rows(self, texts: pa.Array) -> Rows:
        ids, values, lengths = [], [], []
        for _, _, data, offs in K.chunks(texts, FIT_CHUNK):
            n = len(offs) - 1
            per = []
            for i, d in self.parts(data, offs):
                dd, ii, c = K.unique_pairs(d, i)
                per.append((dd, ii, SCALE * c / np.bincount(d, minlength=n)[dd]))
            dd, ii, vv = (np.concatenate(x) for x in zip(*per, strict=True))
            order = np.argsort(dd, kind="stable")
            ids.append(ii[order].astype(np.int32))
            values.append(vv[order].astype(np.float32))
            lengths.append(np.bincount(dd, minlength=n))
        cat = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
        return Rows(cat(ids, np.int32), cat(values, np.float32), cat(lengths, np.int64), self.dim)
