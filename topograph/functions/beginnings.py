"""Keys of the beginnings of terms, and of the strings in a query that may be one, for vocabularies of any size.

A key is a rolling hash of UTF-8 bytes with the length mixed in, so all strings of a length in a batch are a few numpy
steps. Keys only pair; whoever joins by them compares the strings.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths of beginnings, at most, and bits (as a power of 2, at most) of the filter that says which keys a vocabulary may have.
LENGTHS, FILTER_BITS = 24, 29
#: Bits of the filter for each key at least, below that limit, and how many of them a key sets.
KEY_BITS, PROBES = 32, 4
#: Bits of one piece of the filter, as bitmap_construct_agg() makes them. A key's bits are in one piece.
PIECE_BITS = 15
PIECE = 1 << PIECE_BITS
_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def lengths_of(terms: DataFrame, term: str) -> list[int]:
    """The lengths, in bytes, that the terms have; of more than LENGTHS the least and the others' quantiles."""
    counts = sorted((r["size"], r["n"]) for r in terms.groupBy(F.octet_length(term).alias("size")).agg(F.count("*").alias("n")).collect())
    sizes = np.array([s for s, _ in counts])
    if len(sizes) <= LENGTHS:
        return sizes.tolist()
    passed = np.cumsum([n for _, n in counts])
    at = np.searchsorted(passed, passed[-1] * np.arange(1, LENGTHS) / LENGTHS)
    return sorted({int(sizes[0]), *sizes[at].tolist()})


class _Rolled:
    """Hashes of all strings in a batch of texts."""

    def __init__(self, texts: Sequence[bytes]):
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.text = np.repeat(np.arange(len(texts)), sizes)
        self.first = np.cumsum(sizes) - sizes
        self.left = np.repeat(self.first + sizes, sizes) - np.arange(len(data))  # bytes to the text's end
        with np.errstate(over="ignore"):
            powers, self.back = (np.concatenate(([np.uint64(1)], np.cumprod(np.full(len(data), b)))) for b in (_BASE, _INVERSE))
            self.sums = np.concatenate(([np.uint64(0)], np.cumsum(_BYTES[data] * powers[:-1])))

    def keys(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Keys of the strings of a size that begin at these bytes."""
        with np.errstate(over="ignore"):
            h = (self.sums[at + size] - self.sums[at]) * self.back[at] + np.asarray(size, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            return h ^ (h >> np.uint64(29))


def key_of(term: Column | str, lengths: Sequence[int]) -> Column:
    """The key of a term's longest beginning that has one of the lengths."""
    sizes = np.array(sorted(lengths))

    def run(batch: pd.Series) -> pd.Series:
        texts = [t.encode() for t in batch]
        rolled = _Rolled(texts)
        own = sizes[np.searchsorted(sizes, np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)), "right") - 1]
        return pd.Series(rolled.keys(rolled.first, own).view(np.int64))

    return F.pandas_udf(run, "bigint")(term)


def filter_of(keys: DataFrame, key: str) -> np.ndarray:
    """PROBES bits for each key, in a map that grows with the number of keys up to 2**FILTER_BITS bits."""
    size = min(max((KEY_BITS * keys.count() - 1).bit_length(), PIECE_BITS + 1), FILTER_BITS)
    dealt = keys.select(F.shiftrightunsigned(key, 64 - size + PIECE_BITS).alias("piece"), F.col(key).alias("key")).repartition("piece")
    step = F.shiftrightunsigned("key", PIECE_BITS).bitwiseAND(PIECE - 1).bitwiseOR(1)
    bits = dealt.select("piece", F.explode(F.array(*((F.col("key").bitwiseAND(PIECE - 1) + step * i).bitwiseAND(PIECE - 1) for i in range(PROBES)))).alias("bit"))
    out = np.zeros((1 << size) // 8, dtype=np.uint8)
    for r in bits.groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        out[r["piece"] * PIECE // 8 : (r["piece"] + 1) * PIECE // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def _there(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of the keys whose bits are all set."""
    left = np.arange(len(keys))
    low = np.uint64(PIECE - 1)
    piece = (keys >> np.uint64(64 - (bits.size.bit_length() + 2) + PIECE_BITS)) << np.uint64(PIECE_BITS)
    for i in range(PROBES):
        own = keys[left]
        step = (own >> np.uint64(PIECE_BITS)) & low | np.uint64(1)
        bit = piece[left] | ((own & low) + step * np.uint64(i)) & low
        left = left[((bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)]
    return left


def _passing(rolled: _Rolled, lengths: Sequence[int], bits: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length, where the strings begin that the filter lets through, and their keys."""
    for n in lengths:
        at = np.flatnonzero(rolled.left >= n)
        keys = rolled.keys(at, n)
        kept = _there(bits, keys)
        yield n, at[kept], keys[kept]


def keys_in(queries: DataFrame, query: str, lengths: Sequence[int], bits: np.ndarray) -> Column:
    """The distinct keys of the strings in a query that the filter lets through."""
    shared = queries.sparkSession.sparkContext.broadcast(bits)

    def run(batch: pd.Series) -> pd.Series:
        rolled = _Rolled([b"" if q is None else q.encode() for q in batch])
        texts, found = [], []
        for _, at, keys in _passing(rolled, lengths, shared.value):
            texts.append(rolled.text[at])
            found.append(keys.view(np.int64))
        rows = pd.DataFrame({"text": np.concatenate(texts), "key": np.concatenate(found)}).drop_duplicates().sort_values("text", kind="stable")
        ends = np.searchsorted(rows["text"], np.arange(len(batch) + 1))
        keys = rows["key"].to_numpy()
        return pd.Series([keys[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], dtype=object)

    return F.pandas_udf(run, "array<bigint>")(F.col(query))


def strings_in(queries: DataFrame, query: str, lengths: Sequence[int], bits: np.ndarray) -> Column:
    """The distinct strings in a query, of these lengths, that the filter lets through."""
    shared = queries.sparkSession.sparkContext.broadcast(bits)

    def run(batch: pd.Series) -> pd.Series:
        texts = [b"" if q is None else q.encode() for q in batch]
        rolled, data = _Rolled(texts), b"".join(texts)
        found: list[set[bytes]] = [set() for _ in texts]
        for n, at, _ in _passing(rolled, lengths, shared.value):
            for text, a in zip(rolled.text[at].tolist(), at.tolist(), strict=True):
                found[text].add(data[a : a + n])
        return pd.Series([sorted(s for x in own if (s := _decoded(x)) is not None) for own in found], dtype=object)

    return F.pandas_udf(run, "array<string>")(F.col(query))


def _decoded(data: bytes) -> str | None:
    """None for bytes that begin or end inside a character, and so are no term."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        return None
