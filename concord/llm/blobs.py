"""Packed numpy columns in binary cells, for shuffles of many small records."""

from __future__ import annotations

import numpy as np
import zstandard


def packed(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays of one length; integers go by byte planes, so that like bytes lie together."""
    out = [len(arrays[0]).to_bytes(8, "little")]
    for array in arrays:
        planes = np.ascontiguousarray(array).view(np.uint8).reshape(len(array), -1)
        if array.ndim == 1:
            planes = np.ascontiguousarray(planes.T)
        part = zstandard.ZstdCompressor(level=level).compress(planes.tobytes())
        out += [len(part).to_bytes(8, "little"), part]
    return b"".join(out)


def unpacked(blob: bytes, *kinds: tuple[str, int]) -> list[np.ndarray]:
    """``kinds``: dtype and width (0: a flat array) of each array."""
    n, at, out = int.from_bytes(blob[:8], "little"), 8, []
    for kind, width in kinds:
        size = int.from_bytes(blob[at : at + 8], "little")
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[at + 8 : at + 8 + size]), np.uint8)
        at += 8 + size
        if width:
            out.append(raw.view(kind).reshape(n, width))
        else:
            item = np.dtype(kind).itemsize
            out.append(np.ascontiguousarray(raw.reshape(item, n).T).view(kind).reshape(n))
    return out


def delta(sorted_values: np.ndarray) -> np.ndarray:
    out = sorted_values.copy()
    out[1:] -= sorted_values[:-1]
    return out
