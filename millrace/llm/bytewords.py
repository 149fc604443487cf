"""Words of whole texts as numpy arrays, straight from Arrow's UTF-8 buffers.

A chunk is a run of documents of about CHUNK (half a million) bytes (a longer document is a chunk of its own). Words are
maximal runs of word bytes inside one document; each gets a 64-bit hash of its bytes, so n-grams, shingles
and features are computed for a chunk at once, with no Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_BASE, _GRAM = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95  # odd: invertible modulo 2**64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words [^\x20\x09-\x0D]+ ; words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (of lower-cased text)
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit reaches each output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Powers:
    """Powers of _BASE and of its inverse, as far as they have been needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, CHUNK + 4096)
            f = np.full(n, _BASE, U)
            g = np.full(n, pow(_BASE, -1, 2**64), U)
            f[0] = g[0] = 1
            self.up, self.down = np.cumprod(f), np.cumprod(g)
        return self.up, self.down


_powers = _Powers()


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its row bounds in them; a null row is empty."""
    if pa.types.is_string_view(col.type) or isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays([c.cast(pa.large_string()) for c in getattr(col, "chunks", [col])] or [pa.array([], pa.large_string())])
    col = col.fill_null("") if col.null_count else col
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, bounds, data = col.buffers()
    at = np.frombuffer(bounds, kind, len(col) + 1, col.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8, at[-1]) if data is not None and at[-1] else np.zeros(0, np.uint8)
    return raw[at[0] :], at - at[0]


def spans(at: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about size bytes each."""
    i, n = 0, len(at) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1))
        yield i, j
        i = j


@dataclass
class Words:
    """Words of rows first..last-1 of a batch. Row numbers in `row` count from `first`."""

    first: int
    last: int
    low: np.ndarray  # the chunk's bytes, A-Z lower-cased
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    head: np.ndarray  # of each row, its first word's index; one more at the end
    hash: np.ndarray
    bounds: np.ndarray | None = None  # of each row, its first byte; one more at the end
    raw: np.ndarray | None = None  # the chunk's bytes as they are

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.head)

    def text(self, i: int, j: int) -> str:
        """Words i..j-1, joined by single spaces."""
        low = self.low
        return b" ".join(low[a:b].tobytes() for a, b in zip(self.start[i:j], self.end[i:j], strict=True)).decode()


def _hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), U)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + CHUNK, "right")))
        a, b = int(start[i]), int(end[j - 1])
        up, down = _powers.to(b - a + 1)
        c = np.zeros(b - a + 1, U)
        np.cumsum(_BYTE[low[a:b]] * up[: b - a], out=c[1:])
        s = start[i:j] - a
        out[i:j] = (c[end[i:j] - a] - c[s]) * down[s]
        i = j
    return mix(out ^ (end - start).astype(U))


def words(col: pa.Array, kind: np.ndarray, size: int = CHUNK, hashes: bool = True) -> Iterator[Words]:
    """The words of each row, chunk by chunk; kind: for each byte value, whether it is part of a word."""
    raw, at = utf8(col)
    for i, j in spans(at, size):
        low = LOWER[raw[at[i] : at[j]]]
        bounds = at[i : j + 1] - at[i]
        inside = np.zeros(len(low) + 2, bool)
        inside[1:-1] = kind[low]
        opens = inside[1:-1] & ~inside[:-2]
        shuts = inside[1:-1] & ~inside[2:]
        cut = bounds[1:-1]
        cut = cut[(cut > 0) & (cut < len(low))]
        opens[cut] = inside[1:-1][cut]
        shuts[cut - 1] = inside[1:-1][cut - 1]
        start, end = np.flatnonzero(opens), np.flatnonzero(shuts) + 1
        head = np.searchsorted(start, bounds)
        row = np.repeat(np.arange(j - i), np.diff(head))
        yield Words(i, j, low, start, end, row, head, _hashes(low, start, end) if hashes else start, bounds, raw[at[i] : at[j]])


def grams(w: Words, k: int, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, by their first word, and which of them lie in one row."""
    h = w.hash if of is None else of
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, U)
    for j in range(k):
        out = out * U(_GRAM) + h[j : j + n]
    return mix(out + U(k)), w.row[:n] == w.row[k - 1 : k - 1 + n]


def bitmap(rows, column, max_bits: int = 27) -> np.ndarray:
    """Words of a bit table with a bit for each 64-bit hash in a DataFrame's column, modulo its size: a power of two of about 16
    bits a hash, at most 2**max_bits. At most 2**max_bits / 64 words come to the driver; a fuller table only lets more through."""
    from pyspark.sql import functions as F

    n = rows.select(F.approx_count_distinct(column)).first()[0]
    bits = 1 << min(max_bits, max(16, int(np.ceil(np.log2(16 * n + 1)))))
    slot = F.col(column).bitwiseAND(F.lit(bits - 1))
    cells = rows.groupBy(F.shiftright(slot, 6).alias("cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 63 as int))")).alias("bits")).collect()
    out = np.zeros(bits // 64, np.int64)
    out[[r.cell for r in cells]] = [r.bits for r in cells]
    return out.view(U)


def marked(cells: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set."""
    s = g & U(len(cells) * 64 - 1)
    return (cells[(s >> U(6)).astype(np.int64)] >> (s & U(63))) & U(1) == 1
