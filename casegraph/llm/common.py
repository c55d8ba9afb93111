"""Helpers that the training-data operators share: written tables, text buffers, hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..sources.scratch import new_path, shared_dir, written

__all__ = ["SPACES", "WORD", "binary_column", "components", "mix", "new_path", "release_memory", "shared_dir", "total_bytes", "written"]

#: Bytes that separate words: space and \t \n \v \f \r.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: The same as a regular expression for one word.
WORD = r"[^\x20\x09-\x0D]+"


def total_bytes(df: DataFrame, col: str) -> int:
    """Bytes of a text column."""
    return df.agg(F.sum(F.octet_length(col)).alias("b")).first()["b"] or 0


def binary_column(array) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string or binary array as (all bytes, n + 1 offsets) without copying; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def release_memory() -> None:
    """Gives a Python worker's free memory back to the system: it outlives its task, and other stages need the memory."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finisher of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
