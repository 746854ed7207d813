"""What the two embedding operators share: which vectors count, arrays of them, and packed one-bit codes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vec: Column) -> Column:
    """Neither null nor empty, all components present and finite, not all zero."""
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(ok & F.exists(vec, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """A list column of ``dim`` numbers each as a double matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component near 1: exact, and no square of it over- or underflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])


@lru_cache(maxsize=8)
def rotation(dim: int, spread: int, seed: int = 9) -> np.ndarray:
    """``spread`` independent random rotations one below the other, (spread * dim) x dim, scaled to keep lengths.

    The same on every worker.
    """
    rng = np.random.default_rng(seed + dim)
    out = []
    for _ in range(spread):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.concatenate(out) / np.sqrt(spread)


def pack(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words; missing bits of the last word are zero."""
    wide = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), dtype=bool)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1).view(np.uint64)


def binary(words: np.ndarray) -> pa.Array:
    """Each row of words as one binary value."""
    size = words.shape[1] * 8
    raw = pa.py_buffer(np.ascontiguousarray(words).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(np.arange(0, size * len(words) + 1, size, dtype=np.int32).tobytes()), raw])


def words(column: pa.Array, width: int) -> np.ndarray:
    """Binary values of ``width`` words each as rows of words."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(-1, width)
