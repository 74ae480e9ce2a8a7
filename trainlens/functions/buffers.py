"""Arrow string columns as bytes and offsets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def buffer_of(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; nulls count as empty."""
    arr = arr.cast(pa.large_binary()).fill_null(b"")
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = arr.buffers()
    off = np.frombuffer(ends, np.int64)[arr.offset:arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]
