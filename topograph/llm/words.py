"""Whitespace words of whole Arrow text columns, hashed with numpy and without one Python object a word.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Its hash is the sum modulo 2**64 of one
random number for each byte and its place in the word, then mixed with the length: words that differ in any
way have equal hashes with probability 2**-64, whatever their letters' pattern.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SALT = 0x9E3779B97F4A7C15
STEP = 0xD6E8FEB86659FD93 | 1
CHUNK = 1 << 18
#: Places in a word whose random numbers are kept in a table; later ones are made anew.
PLACES = 64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; tables of up to CHUNK entries are kept."""
    have = _powers.get(base)
    if have is not None and len(have) >= n:
        return have[:n]
    size = max(n, CHUNK + 1)
    out = np.ones(size, dtype=np.uint64)
    done, step = 1, base % (1 << 64)
    while done < size:
        more = min(done, size - done)
        np.multiply(out[:more], np.uint64(step), out=out[done : done + more])
        step = step * step % (1 << 64)
        done += more
    if size <= 1 << 20:
        _powers[base] = out
    return out[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _numbers(places: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A random number for each place in a word and byte there."""
    at = (places << 8) | values
    if not len(at) or places.max() < PLACES:
        return TABLE[at]
    out = np.empty(len(at), np.uint64)
    near = places < PLACES
    out[near] = TABLE[at[near]]
    out[~near] = _random(at[~near])
    return out


def _random(at: np.ndarray) -> np.ndarray:
    return mix(mix(at.astype(np.uint64) + np.uint64(SALT)) ^ np.uint64(STEP))


TABLE = _random(np.arange(PLACES << 8))


def _windows(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[s:e] for each start and end, independent of where the span lies."""
    prefix = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values)), out=prefix[1:])
    inverse = pow(base, -1, 1 << 64)
    return (prefix[ends] - prefix[starts]) * powers(inverse, len(values) + 1)[starts]


@dataclass
class Words:
    """Words of some rows: byte spans in buf, and offsets[i]:offsets[i+1] are the words of row i."""

    buf: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray

    def hashes(self, prefix: int | None = None) -> np.ndarray:
        """64-bit hash of each word, or of its first `prefix` bytes."""
        ends = self.ends if prefix is None else np.minimum(self.starts + prefix, self.ends)
        sizes = ends - self.starts
        stops = np.cumsum(sizes)
        narrow = np.int32 if len(self.buf) < 1 << 22 else np.int64
        places = np.arange(stops[-1] if len(stops) else 0, dtype=narrow) - np.repeat((stops - sizes).astype(narrow), sizes)
        sums = np.zeros(len(places) + 1, np.uint64)
        np.cumsum(_numbers(places, self.buf[np.repeat(self.starts.astype(narrow), sizes) + places]), out=sums[1:])
        return mix(sums[stops] - sums[stops - sizes] + sizes.astype(np.uint64) * np.uint64(STEP))

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))

    def texts(self, row: int) -> list[bytes]:
        return self.buf[self.bounds[row] : self.bounds[row + 1]].tobytes().split()


def string_hashes(strings: pa.Array, limit: int = CHUNK) -> np.ndarray:
    """64-bit hash of each whole string; a word hashes as in Words.hashes()."""
    out = [np.zeros(0, np.uint64)]
    for data, off in _parts(strings, limit):
        n = len(off) - 1
        out.append(Words(data, off, off[:-1], off[1:], np.arange(n + 1)).hashes())
    return np.concatenate(out)


def _parts(text: pa.Array, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, bounds) of consecutive rows of at most `limit` bytes, or of one longer row."""
    if text.null_count:
        text = text.fill_null("")
    text = text.cast(pa.large_string())
    n = len(text)
    off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def ngrams(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of n consecutive words that stay within a row, each one's first word, and offsets by row."""
    counts = np.maximum(np.diff(offsets) - n + 1, 0)
    out = np.concatenate([[0], np.cumsum(counts)])
    first = np.arange(out[-1]) - np.repeat(out[:-1] - offsets[:-1], counts)
    if not len(first):
        return np.zeros(0, np.uint64), first, out
    return mix(_windows(hashes, STEP, first, first + n)), first, out


def split(text: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) of parts of at most `limit` bytes, or of one longer row. Null: no words."""
    text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
    if pa.types.is_dictionary(text.type):
        text = text.dictionary_decode()
    lo = 0
    for data, bounds in _parts(text, limit):
        yield lo, lo + len(bounds) - 1, words(data, bounds)
        lo += len(bounds) - 1


def words(buf: np.ndarray, bounds: np.ndarray, parting: np.ndarray = SPACE) -> Words:
    """Words of rows laid end to end in buf, row i at bounds[i]:bounds[i+1]; parting: the bytes between words."""
    space = parting[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[bounds] = True
    before = np.ones(len(buf) + 1, dtype=bool)
    before[1:] = space
    after = np.ones(len(buf) + 1, dtype=bool)
    after[:-1] = space
    starts = np.flatnonzero(~space & (before | edge)[:-1])
    ends = np.flatnonzero(~space & (after[1:] | edge[1:])) + 1
    return Words(buf, bounds, starts, ends, np.searchsorted(starts, bounds))
