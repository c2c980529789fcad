"""Vectorised word handling on Arrow string buffers, shared by the text operators.

Everything works on the UTF-8 bytes of a column in blocks of at most ``BLOCK`` bytes (or one document), so memory
does not depend on the length of a batch. A word is hashed by a polynomial over random 64-bit letter values.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK = 2 << 20
#: Bytes whose words are hashed at once: eight times as many are held, several times over.
CHUNK = 128 << 10
_SEED = 20240611
_STEP = np.uint64(0x9E3779B97F4A7C13)


def _lut(keep) -> np.ndarray:
    return np.array([keep(b) for b in range(256)], dtype=bool)


#: Letters a-z (after lower-casing A-Z), digits and every byte of a non-ASCII character.
ALNUM = _lut(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
#: Everything but space and the control characters tab to carriage return.
SOLID = _lut(lambda b: not (b == 32 or 9 <= b <= 13))
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


@lru_cache(1)
def _letters() -> np.ndarray:
    values = np.random.default_rng(_SEED).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return values[LOWER]


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_STEP), -1, 2**64))
    out = []
    for base in (_STEP, inverse):
        p = np.full(n + 1, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs


class Block:
    """Words of some consecutive rows: first row ``lo``, word hashes, and row borders within them."""

    def __init__(self, lo: int, data: np.ndarray, offs: np.ndarray, table: np.ndarray):
        self.lo, self.rows = lo, len(offs) - 1
        self.data = data[offs[0] : offs[-1]]
        self.offs = offs - offs[0]
        solid = table[self.data]
        start, end = solid.copy(), solid.copy()
        if len(solid):
            start[1:] &= ~solid[:-1]
            end[:-1] &= ~solid[1:]
            full = self.offs[1:] > self.offs[:-1]
            a, b = self.offs[:-1][full], self.offs[1:][full] - 1
            start[a], end[b] = solid[a], solid[b]
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        #: The words of row i are first[i] to first[i + 1].
        self.first = np.searchsorted(self.starts, self.offs)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        out, letters, lo = np.empty(len(self.starts), dtype=np.uint64), _letters(), 0
        while lo < len(out):
            # Whole words: those that end within a chunk, or one that is longer.
            a = int(self.starts[lo])
            hi = max(lo + 1, int(np.searchsorted(self.ends, a + CHUNK, side="right")))
            start, end = self.starts[lo:hi] - a, self.ends[lo:hi] - a
            n = int(end[-1])
            power, inverse = _powers(CHUNK if n <= CHUNK else 1 << int(n - 1).bit_length())
            total = np.zeros(n + 1, dtype=np.uint64)
            np.multiply(letters[self.data[a : a + n]], power[:n], out=total[1:])
            np.cumsum(total, out=total)
            out[lo:hi] = mix((total[end] - total[start]) * inverse[start])
            lo = hi
        return out

    def row_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, side="right") - 1

    def word(self, i: int) -> str:
        return LOWER[self.data[self.starts[i] : self.ends[i]]].tobytes().decode("utf-8", "replace")


def blocks(col: pa.Array, table: np.ndarray) -> Iterator[Block]:
    data, offs = buffers(col)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + BLOCK, side="right")) - 1)
        yield Block(lo, data, offs[lo : hi + 1], table)
        lo = hi


def grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows inside rows, and the index of each window's first word."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(h) - n + 1
    inside = np.ones(m, dtype=bool)
    for border in first[1:-1]:
        inside[max(0, border - n + 1) : border] = False
    at = np.flatnonzero(inside)
    return gram_at(h, at, n), at


def gram_at(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    g = np.zeros(len(at), dtype=np.uint64)
    for k in range(n):
        g = mix(g * np.uint64(0xD1342543DE82EF95) + h[at + k] + np.uint64(k + 1))
    return g


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offs = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values, type=kind))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
