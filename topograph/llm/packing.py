"""Numbers as compressed bytes, and spans of arrays."""

from __future__ import annotations

import numpy as np
import zstandard


def pack_numbers(x: np.ndarray) -> bytes:
    """Whole numbers under 2**28 as bytes of seven bits, the last one marked, compressed; larger ones raise."""
    if len(x) and (x.max() >= 1 << 28 or x.min() < 0):
        raise OverflowError("numbers from 0 to 2**28 - 1 can be packed")
    x = x.astype(np.uint32)
    size = 1 + (x >= 1 << 7).astype(np.int8) + (x >= 1 << 14) + (x >= 1 << 21)
    last = np.cumsum(size, dtype=np.int64) - 1
    out = np.empty(int(last[-1]) + 1 if len(x) else 0, np.uint8)
    out[last] = (x & 127) | 128
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        out[last[more] - k] = (x[more] >> np.uint32(7 * k)) & 127
    return zstandard.ZstdCompressor(level=3).compress(out.tobytes())


def unpack_numbers(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    last = np.flatnonzero(raw & 128)
    size = np.diff(last, prepend=-1)
    out = (raw[last] & 127).astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        out[more] |= raw[last[more] - k].astype(np.uint32) << np.uint32(7 * k)
    return out


def pack_rising(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as byte planes of their differences, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0))
    planes = steps.view(np.uint8).reshape(-1, 8).T
    used = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([used]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes[:used]).tobytes())


def unpack_rising(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, : data[0]] = raw.T
    return np.cumsum(out.view(np.uint64).ravel())


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each span, end to end."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
