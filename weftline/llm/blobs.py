"""Numpy arrays as compressed values of a binary column."""

from __future__ import annotations

import struct

import numpy as np
import zstandard


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; integers in as few bytes as they need."""
    parts = []
    for x in arrays:
        if x.dtype.kind in "iu" and x.dtype != np.uint64:
            most, least = (int(x.max()), int(x.min())) if len(x) else (0, 0)
            x = x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= least and most <= np.iinfo(t).max))
        raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()  # bytes of equal weight together
        parts += [struct.pack("<2sq", x.dtype.str[1:].encode(), len(x)), raw]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpacked(body: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(body), 0, []
    while at < len(data):
        kind, n = struct.unpack_from("<2sq", data, at)
        width = int(kind[1:])
        raw = np.frombuffer(data, np.uint8, n * width, at + 10).reshape(width, n)
        x = np.ascontiguousarray(raw.T).reshape(-1).view(np.dtype(kind.decode()))
        out.append(x.astype(np.int64) if x.dtype.kind == "i" else x)
        at += 10 + n * width
    return out
