"""Words as Arrow text, rows grouped by key inside a task before Spark sees them, and bit tables of many hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def texts(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """low[start:end] of each pair, as strings. Bounds must lie between characters."""
    size = end - start
    at = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    data = low[np.arange(at[-1]) + np.repeat(start - at[:-1], size)]
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(data))


def grouped(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal rows are neighbours, and where in it each run of equal rows begins."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for c in columns:
            c = c[order]
            new[1:] |= c[1:] != c[:-1]
    return order, np.flatnonzero(new)


def totals(values: np.ndarray, order: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum of each group of `grouped`."""
    return np.add.reduceat(values[order], at) if len(at) else values[:0]


def codes(column: pa.Array, known: dict[str, int]) -> np.ndarray:
    """A number for each value of a string column without nulls; known gets new values at its end."""
    d = column.dictionary_encode()
    of = np.array([known.setdefault(v, len(known)) for v in d.dictionary.to_pylist()], np.int64)
    return of[d.indices.to_numpy(zero_copy_only=False)] if len(of) else np.zeros(len(column), np.int64)


def bit_table(rows: DataFrame, column: str, max_bits: int = 28) -> np.ndarray:
    """Cells of a bit table with a bit for each 64-bit hash in a column, modulo its size: a power of two of about 32 bits a hash, at
    most 2**max_bits (32 MB, so much reaches the driver). A fuller table only lets more through."""
    n = rows.count()
    bits = 1 << min(max_bits, max(16, int(np.ceil(np.log2(32 * n + 1)))))
    slot = F.col(column).bitwiseAND(F.lit(bits - 1))
    cells = rows.groupBy(F.shiftright(slot, 6).alias("cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy()
    return out.view(np.uint64)
