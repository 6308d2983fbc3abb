"""SimHash near-duplicates, linked by pigeonring filtering.

Texts are lower-cased (A-Z only) and cut into shingles of three words, repeats included; a fingerprint has a bit set if
it is set in over half of the shingles' XXH64 values. Equal fingerprints are one node, so a group of copies costs one
row from here on.

Fingerprints are rings of SEGMENTS equal segments. Two that differ in at most `bits` bits have a segment from which on
every chain of l consecutive segments differs in at most l * bits / SEGMENTS bits (the pigeonring principle). So the
first segments of that chain are equal, up to where the budget reaches one bit, and those that follow, up to where it
reaches two, differ in one bit at most: one half of these is equal as well. A node's keys are, for each start and half,
the equal segments (40 of 64 bits for two differing bits in eight segments). Nodes that share a key meet; their pairs
are pruned segment by segment along the chain, and those that stay get the full Hamming check.

A key leaves 24 bits open, so no bucket holds more than 2**24 nodes, whatever the input. Small buckets compare all
pairs at once; larger ones look each node's neighbours up in the sorted bucket instead (301 for 24 open bits), so the
work is in proportion to the nodes. Only a spanning forest of each bucket leaves a task.

Null text is empty text. Texts without words have fingerprint zero and link as others do. Null doc_ids link, and name no
component unless it has no other. Repeated rows are rows of their own. Extra columns are ignored; no rows give none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topograph.llm.graph import by_key, components, groups, spanning, tree
from topograph.llm.packing import spans
from topograph.llm.storage import stored
from topograph.llm.words import Words, split
from topograph.workers import thrifty

SHINGLE = 3
SEED = 42
#: Differing bits at which two fingerprints still link.
BITS = 2
SEGMENTS = 8
#: Buckets up to SMALL compare all pairs at once, up to MEDIUM row by row; larger ones look neighbours up.
SMALL, MEDIUM = 64, 1024
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
PIECE = 1 << 15


def shingle_hashes(w: Words, n: int = SHINGLE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each row's shingles of n words (fewer words: all of them), end to end, and their offsets."""
    size = w.ends - w.starts
    at = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.full(at[-1], 0x20, np.uint8)
    text[spans(at[:-1], size)] = LOWER[w.buf[spans(w.starts, size)]]
    held = np.diff(w.offsets)
    counts = np.where(held >= n, held - n + 1, np.minimum(held, 1))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    first = spans(w.offsets[:-1], counts)
    ends = at[first + np.repeat(np.minimum(held, n), counts)] - 1
    data, digest = text.tobytes(), xxhash.xxh64_digest
    found = b"".join([digest(data[a:z], seed) for a, z in zip(at[first].tolist(), ends.tolist(), strict=True)])
    return np.frombuffer(found, ">u8").astype(np.uint64), offsets


def majority(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each row's values, the bits that over half of them have; zero for a row without."""
    sizes = np.diff(offsets)
    ones = np.zeros((len(sizes), 64), np.int64)
    for lo in range(0, len(values), PIECE):
        hi = min(lo + PIECE, len(values))
        rows = np.unique(np.searchsorted(offsets, [lo, hi - 1], side="right") - 1)
        rows = np.flatnonzero(sizes[rows[0] : rows[-1] + 1]) + rows[0]
        bits = np.unpackbits(values[lo:hi].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones[rows] += np.add.reduceat(bits, np.maximum(offsets[rows] - lo, 0), axis=0, dtype=np.int32)
    return np.packbits(2 * ones > sizes[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, w in split(b.column("text")):
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), _nodes(majority(*shingle_hashes(w)))], ["doc_id", "node"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and node, the fingerprint's eight bytes, of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(thrifty(_fingerprints), f"doc_id {kind}, node binary")


class Ring:
    """What the pigeonring principle says of fingerprints that differ in at most `bits` of 64 bits."""

    def __init__(self, bits: int = BITS, segments: int = SEGMENTS) -> None:
        if 64 % segments or not 0 < bits < segments:
            raise ValueError("segments has to divide 64 and to be larger than bits")
        self.bits, self.segments, self.width = bits, segments, 64 // segments
        self.budget = [n * bits // segments for n in range(1, segments + 1)]  # of chains of 1, 2, ... segments
        equal, near = self.budget.count(0), sum(x <= 1 for x in self.budget)
        middle = equal + (near - equal + 1) // 2
        self.equal = [[*range(middle)], [*range(equal), *range(middle, near)]]
        self.open = [np.array([i for s in range(segments) if s not in own for i in range(s * self.width, (s + 1) * self.width)], np.uint64) for own in self.equal]

    def turned(self, x: np.ndarray, start: int) -> np.ndarray:
        """The ring with segment `start` first, that is in the lowest bits."""
        s = np.uint64(start * self.width)
        return x if not start else (x >> s) | (x << (np.uint64(64) - s))

    def mask(self, half: int) -> np.uint64:
        return np.uint64(sum(((1 << self.width) - 1) << (s * self.width) for s in self.equal[half]))

    def viable(self, x: np.ndarray) -> np.ndarray:
        """Places of the differences x, turned to their start, that stay within the budgets of every chain."""
        at, seen = np.arange(len(x)), np.zeros(len(x), np.int64)
        for k, most in enumerate(self.budget):
            part = (x[at] >> np.uint64(k * self.width)) & np.uint64((1 << self.width) - 1)
            seen = seen + np.bitwise_count(part)
            keep = seen <= most
            at, seen = at[keep], seen[keep]
        return at[np.bitwise_count(x[at]) <= self.bits]

    def neighbours(self, half: int) -> np.ndarray:
        """Viable differences, other than none, that keep a key's segments."""
        some = [np.bitwise_or.reduce(np.left_shift(np.uint64(1), np.array(c, np.uint64))) for n in range(1, self.bits + 1) for c in combinations(self.open[half], n)]
        x = np.array(some, np.uint64)
        return x[self.viable(x)]


def keys(batches: Iterable[pa.RecordBatch], ring: Ring) -> Iterator[pa.RecordBatch]:
    """A row for each node, start and half: place (which start and half), key, and the fingerprint as a long."""
    for b in batches:
        x = _prints(b.column("node"))
        for start in range(ring.segments):
            y = ring.turned(x, start)
            for half in range(2):
                place = np.full(len(x), 2 * start + half, np.int8)
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array((y & ring.mask(half)).view(np.int64)), pa.array(x.view(np.int64))], ["place", "key", "print"])


def _nodes(prints: np.ndarray) -> pa.Array:
    """Eight bytes of each fingerprint, the highest first, so that they sort as the numbers do."""
    return pa.Array.from_buffers(pa.binary(), len(prints), [None, pa.py_buffer(np.arange(0, 8 * len(prints) + 8, 8, dtype=np.int32)), pa.py_buffer(prints.astype(">u8").tobytes())])


def _prints(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64)


def linked(x: np.ndarray, place: int, ring: Ring) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of one bucket: pairs of rows of the distinct fingerprints x."""
    start, half = divmod(place, 2)
    turned = ring.turned(x, start)
    order = np.argsort(turned)
    y = turned[order]
    if len(y) <= MEDIUM:
        pairs = [*spanning(len(y), lambda i, rest: rest[ring.viable(y[rest] ^ y[i])])]
    else:
        pairs = [*_probed(y, ring.neighbours(half))]
    found = order[np.array(pairs, np.int64).reshape(-1, 2)]
    return found[:, 0], found[:, 1]


def _probed(y: np.ndarray, near: np.ndarray) -> Iterator[tuple[int, int]]:
    """As spanning(), of a sorted bucket, by looking up what differs by one of `near`."""
    met = np.zeros(len(y), bool)
    for root in range(len(y)):
        todo = [] if met[root] else [root]
        met[root] = True
        while todo:
            i = todo.pop()
            want = y[i] ^ near
            at = np.minimum(np.searchsorted(y, want), len(y) - 1)
            hit = at[(y[at] == want) & ~met[at]]
            met[hit] = True
            yield from tree(i, hit)
            todo += hit.tolist()


def _edges(ring: Ring) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in groups(batches, ["place", "key"]):
            x, place = table.column("print").to_numpy().view(np.uint64), table.column("place").to_numpy()
            size, found = np.diff(starts), []
            for n in range(2, SMALL + 1):  # all pairs of all buckets of one size at once
                begin = starts[:-1][size == n]
                i, j = np.triu_indices(n, 1)
                step = max(1, 200_000 // len(i))
                for at in range(0, len(begin), step):
                    part = begin[at : at + step, None]
                    a, z = (part + i).ravel(), (part + j).ravel()
                    turn = (place[a].astype(np.uint64) >> np.uint64(1)) * np.uint64(ring.width)
                    d = x[a] ^ x[z]
                    d = (d >> turn) | (d << ((np.uint64(64) - turn) & np.uint64(63)))
                    stay = ring.viable(d)
                    found.append((a[stay], z[stay]))
            for begin, end in zip(starts[:-1], starts[1:], strict=True):
                if end - begin > SMALL:
                    a, z = linked(x[begin:end], int(place[begin]), ring)
                    found.append((a + begin, z + begin))
            if found:
                yield pa.RecordBatch.from_arrays([_nodes(x[np.concatenate(c)]) for c in zip(*found, strict=True)], ["a", "b"])

    return run


def links(nodes: DataFrame, bits: int = BITS, segments: int = SEGMENTS) -> DataFrame:
    """a and b: links whose graph has the components of all pairs of nodes with at most `bits` differing bits."""
    ring, parts = Ring(bits, segments), int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = nodes.select("node").mapInArrow(thrifty(lambda x: keys(x, ring)), "place byte, key long, print long")
    met = keyed.repartition(parts, "place", "key").sortWithinPartitions("place", "key")
    return met.mapInArrow(thrifty(_edges(ring)), "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, bits: int = BITS, segments: int = SEGMENTS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (the least doc_id reachable by links) of every row."""
    rows = stored(fingerprints(docs))  # read twice
    nodes = stored(rows.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    found = components(links(nodes, bits, segments)).join(nodes, "node")
    least = found.groupBy("component").agg(F.min("rep").alias("least"))
    known = nodes.join(found.select("node", "component").join(least, "component"), "node", "left")
    known = stored(known.select("node", "copies", F.coalesce("least", "rep").alias("component_id")))
    return by_key(rows, known, "node", "copies").select("doc_id", _hex(F.col("node")).alias("fingerprint"), "component_id")


def _hex(node: Column) -> Column:
    return F.lower(F.hex(node))
