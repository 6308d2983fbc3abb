"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of hashed shingles of five words (a shorter text is one shingle of all its words). Equal texts are one
node, named by their MD5, so a group of copies costs one row. Nodes get HASHES MinHash values; those that share one of
the bands of four meet in a bucket. There, pairs compare their values sixteen at a time and are dropped as soon as the
posterior probability (uniform prior) that their similarity reaches the threshold falls below `tolerance`. What is left
links nodes into candidate groups; each group's sets meet once. Its pairs go through the same pruning, and those that
survive are counted exactly, by matrix products of the shingles that at least two of them have. A surviving pair at the
threshold or above is a link.

Buckets and groups larger than a block are dealt out as pairs of blocks, so no task gets an unbounded group and no row
is emitted for a pair: tasks emit a spanning forest of what they find and each node's number of links. A tree of the
forest branches FAN times at most, so the centre of a large group is no hot key of the joins by node. A pair of
similarity 0.8 shares no band with probability 3.2e-6 and is pruned with probability 7.6e-6, so it is missed with
probability 1.1e-5 (2.0e-6 at 0.82, 1.6e-7 at 0.85); no cap drops a pair.

Null text is empty text. A text without words is in a class of its own and has no link, also to other such texts. Rows
that repeat a doc_id are rows of their own, and so are those with a null one: they link as others do, and are a class's
least only if it has no other. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topograph.lineage import cut
from topograph.llm.columns import back, held
from topograph.llm.graph import by_key, components, groups, spanning
from topograph.llm.storage import shared_folder, stored
from topograph.llm.words import STEP, Words, _windows, mix, split
from topograph.workers import thrifty

SHINGLE = 5
THRESHOLD = 0.8
BANDS, BAND = 24, 4
HASHES = BANDS * BAND
STAGE = 16
TOLERANCE = 1e-6
BUCKET_BLOCK = 2048
SET_BLOCK, SET_SHINGLES = 1024, 1 << 20
SMALL = 32
#: Nodes of candidate groups that are broadcast to the texts; more are joined by shuffle.
MOST_BROADCAST = 500_000


def node(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def shingles(w: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's shingles, end to end and with repeats, and their offsets."""
    sizes = np.diff(w.offsets)
    counts = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    first = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - w.offsets[:-1], counts)
    length = np.repeat(np.minimum(sizes, n), counts)
    raw = _windows(w.hashes(), STEP, first, first + length)
    return mix(raw + length.astype(np.uint64)), offsets


def factors() -> np.ndarray:
    return mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(STEP)) | np.uint64(1)


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Low 16 bits of HASHES MinHash values of each row [rows, HASHES]; zeros for a row without shingles."""
    out = np.zeros((len(offsets) - 1, HASHES), np.uint16)
    some = np.flatnonzero(np.diff(offsets))
    lo = 0
    while lo < len(some):
        hi = max(lo + 1, int(np.searchsorted(offsets[some], offsets[some[lo]] + (1 << 15))))
        rows = some[lo:hi]
        part = values[offsets[rows[0]] : offsets[rows[-1] + 1]]
        starts, spare = offsets[rows] - offsets[rows[0]], np.empty_like(part)
        for k, a in enumerate(factors()):
            np.multiply(part, a, out=spare)
            np.right_shift(spare, np.uint64(32), out=spare)
            out[rows, k] = np.minimum.reduceat(spare, starts).astype(np.uint16)
        lo = hi
    return out


def least_matches(threshold: float, tolerance: float, stage: int = STAGE, hashes: int = HASHES) -> list[int]:
    """For each number of values compared: the matches below which the posterior of the threshold is too small."""
    grid = np.linspace(0, 1, 20001)[1:-1]
    out = []
    for n in range(stage, hashes + 1, stage):
        for m in range(n + 1):
            density = m * np.log(grid) + (n - m) * np.log(1 - grid)
            density = np.exp(density - density.max())
            if density[grid >= threshold].sum() / density.sum() >= tolerance:
                break
        out.append(m)
    return out


def survive(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Places of the pairs (a[i], b[i]) that stay; b may be one row."""
    at, seen = np.arange(len(a)), np.zeros(len(a), np.int32)
    for k, m in enumerate(least):
        s = slice(k * STAGE, (k + 1) * STAGE)
        seen += (a[at, s] == (b[s] if b.ndim == 1 else b[at, s])).sum(1)
        keep = seen >= m
        at, seen = at[keep], seen[keep]
    return at


def surviving(sig: np.ndarray, least: list[int]) -> np.ndarray:
    """Which pairs of all rows stay [rows, rows]."""
    out = np.zeros((len(sig), len(sig)), bool)
    for lo in range(0, len(sig), 64):
        near = (sig[lo : lo + 64, None, :STAGE] == sig[None, :, :STAGE]).sum(2) >= least[0]
        i, j = np.nonzero(np.triu(near, lo + 1))
        stay = survive(sig[i + lo], sig[j], least)
        out[i[stay] + lo, j[stay]] = True
    return out | out.T


def reach(sig: np.ndarray, side: np.ndarray | None, least: list[int]) -> Iterator[tuple[int, int]]:
    """A spanning forest of the surviving pairs of one bucket: each row met is compared with the rows not yet met."""

    def near(i: int, left: np.ndarray) -> np.ndarray:
        other = left if side is None else left[side[left] != side[i]]
        return other[survive(sig[other], sig[i], least)]

    return spanning(len(sig), near)


def _bucket_links(least: list[int]) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in groups(batches, ["place", "band", "lo", "hi"]):
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
            bands = np.ascontiguousarray(sig).view(np.uint64)
            nodes, place, side = table.column("node").combine_chunks(), table.column("place").to_numpy(), table.column("side").to_numpy()
            lo, hi = table.column("lo").to_numpy(), table.column("hi").to_numpy()
            size = np.diff(starts)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for n in range(2, SMALL + 1):  # all pairs of all buckets of one size at once
                begin = starts[:-1][size == n]
                i, j = np.triu_indices(n, 1)
                for at in range(0, len(begin), max(1, 200_000 // len(i))):
                    part = begin[at : at + max(1, 200_000 // len(i)), None]
                    a, b = (part + i).ravel(), (part + j).ravel()
                    use = (lo[a] == hi[a]) | (side[a] != side[b])
                    a, b = a[use], b[use]
                    stay = survive(sig[a], sig[b], least)
                    a, b = a[stay], b[stay]
                    first = (bands[a] == bands[b]).argmax(1) == place[a]  # else an earlier bucket has the pair
                    found.append((a[first], b[first]))
            for begin, end in zip(starts[:-1], starts[1:], strict=True):
                if end - begin > SMALL:
                    pairs = list(reach(sig[begin:end], None if lo[begin] == hi[begin] else side[begin:end], least))
                    if pairs:
                        x = np.array(pairs) + begin
                        found.append((x[:, 0], x[:, 1]))
            if found:
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([nodes.take(pa.array(a)), nodes.take(pa.array(b))], ["a", "b"])

    return run


def exact_links(sets: list[np.ndarray], copies: np.ndarray, candidates: np.ndarray, ratio: Fraction) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Each set's links, weighted by copies, and a spanning forest of them; candidates: which pairs may be one."""
    use = np.flatnonzero(candidates.any(1))
    links = np.zeros(len(sets), np.int64)
    if not len(use):
        return links, []
    sets, candidates = [sets[i] for i in use], candidates[np.ix_(use, use)]
    m, sizes = len(sets), np.array([len(x) for x in sets])
    _, at, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(m), sizes)
    keep = seen[at] > 1
    columns = np.cumsum(seen > 1) - 1
    rows, at = rows[keep], columns[at[keep]]
    order = np.argsort(at, kind="stable")
    rows, at = rows[order], at[order]
    common = np.zeros((m, m), np.float32)
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
        a, z = np.searchsorted(at, [lo, lo + 4096])
        x = np.zeros((m, min(4096, int(at[-1]) + 1 - lo)), np.float32)
        x[rows[a:z], at[a:z] - lo] = 1
        common += x @ x.T
    p, q = ratio.numerator, ratio.denominator
    linked = candidates & (common.astype(np.int64) * (p + q) >= p * (sizes[:, None] + sizes[None, :]))
    forest = spanning(m, lambda i, left: left[linked[i, left]])
    links[use] = linked @ copies[use]
    return links, [(int(use[i]), int(use[j])) for i, j in forest]


def _verify(ratio: Fraction, least: list[int]) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in groups(batches, ["component", "lo", "hi"]):
            out: dict[str, list] = {"node": [], "other": [], "links": []}
            for begin, end in zip(starts[:-1], starts[1:], strict=True):
                rows = {r["node"]: r for r in table.slice(begin, end - begin).select(["node", "side", "lo", "hi", "copies", "sig", "shingles"]).to_pylist()}
                rows = [rows[k] for k in sorted(rows)]  # a repeated row is one
                sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
                pairs = surviving(np.frombuffer(b"".join(r["sig"] for r in rows), np.uint16).reshape(-1, HASHES), least)
                if rows[0]["lo"] != rows[0]["hi"]:  # two blocks; the pairs within one are counted elsewhere
                    side = np.array([r["side"] for r in rows])
                    pairs &= side[:, None] != side[None, :]
                links, forest = exact_links(sets, np.array([r["copies"] for r in rows]), pairs, ratio)
                hit = np.flatnonzero(links)
                out["node"] += [rows[i]["node"] for i in hit] + [rows[i]["node"] for i, _ in forest]
                out["other"] += [None] * len(hit) + [rows[j]["node"] for _, j in forest]
                out["links"] += links[hit].tolist() + [0] * len(forest)
            yield pa.RecordBatch.from_pydict({"node": pa.array(out["node"], pa.binary()), "other": pa.array(out["other"], pa.binary()), "links": pa.array(out["links"], pa.int64())})

    return run


def _block_pairs(rows: DataFrame, blocks: Column) -> DataFrame:
    """A row for each pair of blocks that the node's block is in: lo, hi, and side, the node's block."""
    rows = rows.withColumn("side", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)))
    return rows.withColumns({"lo": F.least("side", "other"), "hi": F.greatest("side", "other")}).drop("other")


def _signed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, w in split(b.column("text")):
            values, offsets = shingles(w)
            sig = [x.tobytes() for x in signatures(values, offsets)]
            yield pa.RecordBatch.from_arrays([b.column("node").slice(lo, hi - lo), b.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(offsets)), pa.array(sig, pa.binary())], ["node", "doc_id", "n", "sig"])


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, w in split(b.column("text")):
            values, offsets = shingles(w)
            held = [np.unique(values[a:z]).tobytes() for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
            sig = [x.tobytes() for x in signatures(values, offsets)]
            yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, hi - lo) for c in ("node", "component", "copies", "blocks")), pa.array(sig, pa.binary()), pa.array(held, pa.binary())], ["node", "component", "copies", "blocks", "sig", "shingles"])


def _classified(docs: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """doc_id and node of every row, with the node's least doc_id, copies, shingles, links, and the class's lead."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = docs.select("doc_id", "text", node(F.col("text")).alias("node"))
    path = shared_folder(spark)
    signed = named.mapInArrow(thrifty(_signed), "node binary, doc_id bigint, n bigint, sig binary")
    signed.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig")).write.parquet(path)
    nodes = spark.read.parquet(path)

    key = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.col("sig").substr(i * (2 * BAND) + 1, F.lit(2 * BAND)))))
    bands = nodes.where("n > 0").select("node", key.alias("place", "band"))
    met = bands.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    meeting = _block_pairs(bands.join(met, "band"), F.ceil(F.col("size") / BUCKET_BLOCK))
    meeting = meeting.select("node", "place", "band", "lo", "hi", "side").join(nodes.select("node", "sig"), "node")
    order, least = ["place", "band", "lo", "hi"], least_matches(threshold, tolerance)
    edges = meeting.repartition(parts, "band", "lo", "hi").sortWithinPartitions(*order).mapInArrow(thrifty(_bucket_links(least)), "a binary, b binary")
    found = components(edges).join(nodes.select("node", "rep", "copies", "n"), "node")
    sizes = found.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / SET_BLOCK), F.ceil(F.sum("n") / SET_SHINGLES)).alias("blocks"))
    found = cut(found.join(sizes, "component"))

    small = found.count() <= MOST_BROADCAST
    members = found.select(F.col("node").alias("_node"), "component", "copies", "blocks", "rep")
    texts = named.join(F.broadcast(members) if small else members, (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    texts = texts.groupBy("node").agg(*(F.first(c).alias(c) for c in ("component", "copies", "blocks", "text")))  # rows without doc_id, and repeated ones
    sets = texts.mapInArrow(thrifty(_sets), "node binary, component binary, copies bigint, blocks bigint, sig binary, shingles binary")
    pairs = _block_pairs(sets, F.col("blocks")).drop("blocks")
    path = shared_folder(spark)
    pairs.repartition(parts, "component", "lo", "hi").sortWithinPartitions("component", "lo", "hi").mapInArrow(thrifty(_verify(Fraction(threshold).limit_denominator(1000), least)), "node binary, other binary, links bigint").write.parquet(path)
    verified = spark.read.parquet(path)
    links = verified.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(verified.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    classes = classes.join(nodes.select("node", "rep"), "node")
    leads = classes.groupBy("component").agg(F.min(F.struct(F.col("rep").isNull().alias("unnamed"), "rep", "node")).alias("lead"))
    classes = classes.join(leads, "component").select("node", F.col("lead.rep").alias("class_id"), F.col("lead.node").alias("lead"))
    out = nodes.select("node", "rep", "copies", "n").join(classes, "node", "left").join(links, "node", "left")
    return by_key(docs.select("doc_id", node(F.col("text")).alias("node")), stored(out), "node", "copies")  # read three times


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, class_id (the least doc_id that it is linked to, by any number of steps) and n_links (the number of
    other rows at or over the threshold) of every row."""
    return _classified(docs, threshold, tolerance).select(
        "doc_id",
        F.when(F.col("n") > 0, F.coalesce("class_id", "rep")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(F.col("n") > 0, F.col("copies") - 1 + F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """The rows of docs, all columns kept, without those of a class's other documents: the least doc_id stays, and of
    rows that repeat it and its text, one. Texts without words all stay."""
    path = shared_folder(docs.sparkSession)
    rows = _classified(docs, threshold, tolerance)
    stays = (F.col("n") == 0) | (F.col("doc_id").eqNullSafe(F.col("rep")) & (F.coalesce("lead", "node") == F.col("node")))
    again = rows.groupBy("doc_id", "node").agg(F.first(stays).alias("stays"), ((F.count("*") > 1) & (F.first("n") > 0)).alias("repeats")).where("not stays or repeats")
    again.select(F.col("doc_id").alias("_doc"), F.col("node").alias("_node"), "repeats", "stays").write.parquet(path)
    other = docs.sparkSession.read.parquet(path)
    few = other.count() <= MOST_BROADCAST
    rows, names = held(docs, "doc_id", "text")
    named = rows.withColumn("_node", node(F.col("text")))

    def match(frame: DataFrame) -> tuple[DataFrame, Column]:
        frame = frame.select("_doc", F.col("_node").alias("_other"))
        return F.broadcast(frame) if few else frame, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_node") == F.col("_other"))

    kept = named.join(*match(other), "left_anti").select(names)
    twice = other.where("stays and repeats")
    if not twice.isEmpty():
        kept = kept.unionByName(named.join(*match(twice), "left_semi").dropDuplicates(["doc_id", "_node"]).select(names))
    return kept.select(back(docs, names))
