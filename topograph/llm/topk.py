"""Exact top-k search over an impact-ordered index, score at a time.

Vectors become whole numbers. The index is a table of shards, built once; a shard holds posting segments, one for each
(impact level, dimension): the rows whose component has that level (the bit length of its magnitude, so zero has no
posting) and their exact impacts. A block of queries walks a shard's segments from the largest impacts down and adds
each posting to the accumulators of its row, for the queries that are still going. After a level, what a row may still
gain is bounded by the norms of the query and of the row's unvisited components (Cauchy-Schwarz). The exact scores
of the k leading rows give a threshold: a row whose accumulator plus bound is below the k-th of them is proven out.
A query stops, and skips all smaller postings, when few rows aren't proven out or when no level is left; those rows are
scored exactly, ties go to the smaller id.

Scores are sums of whole numbers in 32 or 64 bits, whichever the norms prove to be enough. Vectors that are too long for
that ("wide", a norm of 2**30 or more) are met by exact integers of any size, beside the segments. A score outside
of a long is ranked by its exact value and shown as the nearest long.

Vectors that are null or hold a null or non-finite component take no part; shorter ones are padded with zeros.
Equal vectors under several ids are all kept. If an id repeats, each of its rows is a candidate, its smallest vector
is the query, and no row of the query's own id is a candidate. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topograph.llm.storage import shared_folder
from topograph.workers import thrifty_group, thrifty_pair

SCALE = 64
SHARD_ROWS = 1 << 13
#: Queries that are sent to a shard at once, and those that walk it together.
TILE_ROWS, BLOCK = 1 << 12, 256
#: A query stops when at most this share of a shard's rows isn't proven out.
FEW = 0.03
#: Proofs are tried once the unvisited components hold at most this share of a shard's norms; before, they would fail.
REST = 0.4
WIDE = float(1 << 30)
LONG = (1 << 63) - 1
FOUND = "query_id bigint, vec_id bigint, score bigint, beyond binary"


def quantise(x: np.ndarray, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of the rows, as double, and which rows are wide."""
    with np.errstate(over="ignore", invalid="ignore"):
        v = np.floor(x * scale)
        return v, ~(np.sqrt((v * v).sum(1)) < WIDE)


def whole(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The same as Python integers, for components of any size."""
    out = np.empty(x.shape, object)
    for at, c in np.ndenumerate(x):
        c = float(c)
        out[at] = int(c) * scale if abs(c) >= 1 << 60 else int(np.floor(c * scale))
    return out


def _narrow(v: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds them."""
    most = np.abs(v).max(initial=0)
    return v.astype(np.int16 if most < 1 << 15 else np.int32)


class Shard:
    """The posting segments of some rows. `bytes` is the stored form."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        """vectors: whole numbers, none of them wide."""
        self.ids, self.dims = ids, vectors.shape[1]
        level = np.frexp(np.abs(vectors).astype(np.float64))[1]
        self.levels = []
        for x in sorted(set(np.unique(level).tolist()) - {0}, reverse=True):
            at = [np.flatnonzero(level[:, d] == x).astype(np.int32) for d in range(self.dims)]
            self.levels.append((np.array([len(a) for a in at], np.int32), np.concatenate(at), np.concatenate([vectors[a, d] for d, a in enumerate(at)])))

    def to_bytes(self) -> bytes:
        sink = pa.BufferOutputStream()
        kind = self.levels[0][2].dtype if self.levels else np.dtype(np.int16)
        rows = {"sizes": [x[0].tobytes() for x in self.levels], "rows": [x[1].tobytes() for x in self.levels], "impacts": [x[2].astype(kind).tobytes() for x in self.levels]}
        table = pa.table({k: pa.array(v, pa.large_binary()) for k, v in rows.items()}).replace_schema_metadata({"ids": self.ids.tobytes().hex(), "dims": str(self.dims), "kind": kind.str})
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        return sink.getvalue().to_pybytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        table = pa.ipc.open_stream(data).read_all()
        about = {k.decode(): v.decode() for k, v in table.schema.metadata.items()}
        out = cls.__new__(cls)
        out.ids, out.dims = np.frombuffer(bytes.fromhex(about["ids"]), np.int64), int(about["dims"])
        out.levels = [tuple(np.frombuffer(r[k], t) for k, t in (("sizes", np.int32), ("rows", np.int32), ("impacts", about["kind"]))) for r in table.to_pylist()]
        return out

    def segments(self, level: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        sizes, rows, impacts = self.levels[level]
        ends = np.cumsum(sizes)
        for d in np.flatnonzero(sizes).tolist():
            s = slice(ends[d] - sizes[d], ends[d])
            yield d, rows[s], impacts[s]

    def vectors(self, dims: int) -> np.ndarray:
        out = np.zeros((len(self.ids), dims), np.int64)
        for at in range(len(self.levels)):
            for d, rows, impacts in self.segments(at):
                out[rows, d] = impacts
        return out


def search(shard: Shard, query_ids: np.ndarray, queries: np.ndarray, k: int, walked: list | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of the query, scores, ids) of each query's k best rows of a shard; the query's own id is left out. queries:
    int64, none wide. walked: gets the number of postings visited for each level and query."""
    ids, n = shard.ids, len(shard.ids)
    dims = max(shard.dims, queries.shape[1])
    full = shard.vectors(dims)
    left = (full * full).sum(1)
    most = np.sqrt(left.max(initial=0))
    total = max(float(left.sum()), 1.0)
    q_all = np.zeros((len(queries), dims), np.int64)
    q_all[:, : queries.shape[1]] = queries
    rests = []
    for at in range(len(shard.levels)):
        for _, rows, impacts in shard.segments(at):
            left[rows] -= impacts.astype(np.int64) ** 2
        rests.append(np.sqrt(left.astype(np.float64)))
    for lo in range(0, len(queries), BLOCK):
        q = q_all[lo : lo + BLOCK]
        norm = np.sqrt((q * q).sum(1).astype(np.float64))
        kind = np.int32 if norm.max(initial=0) * most < 1 << 30 else np.int64
        seen = np.zeros((n, len(q)), kind)
        going = np.arange(len(q))
        for at, rest in enumerate(rests):
            mine = np.ascontiguousarray(q[going].T.astype(kind))
            for d, rows, impacts in shard.segments(at):
                seen[rows] += impacts.astype(kind)[:, None] * mine[d]
                if walked is not None:
                    walked.append(len(rows) * len(going))
            last = at + 1 == len(rests)
            if not last and (rest * rest).sum() > REST**2 * total:
                continue
            stay = []
            for j, i in enumerate(going.tolist()):
                done = _finish(seen[:, j], norm[i] * rest, q[i], full, ids, int(query_ids[lo + i]), k, n if last else max(4 * k, int(FEW * n)))
                if done is None:
                    stay.append(j)
                else:
                    yield lo + i, *done
            if len(stay) < len(going):
                going, seen = going[stay], np.ascontiguousarray(seen[:, stay])
            if not len(going):
                break
        for i in going.tolist():  # a shard of zero vectors has no level
            yield lo + i, *_finish(np.zeros(n, np.int64), np.zeros(n), q[i], full, ids, int(query_ids[lo + i]), k, n)


def _finish(seen: np.ndarray, gain: np.ndarray, q: np.ndarray, full: np.ndarray, ids: np.ndarray, own: int, k: int, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The k best rows, exactly, if at most `most` rows aren't proven out."""
    possible = np.flatnonzero(ids != own)
    if len(possible) > k:
        lead = possible[np.argpartition(-seen[possible], k - 1)[:k]]
        threshold = int((full[lead] @ q).min())
        reached, gain = seen[possible].astype(np.float64), gain[possible]
        possible = possible[reached + gain + 1 + (np.abs(reached) + gain + abs(threshold)) * 1e-9 >= threshold]  # with room for rounding
        if len(possible) > most:
            return None
    scores = full[possible] @ q
    order = np.lexsort((ids[possible], -scores))[:k]
    return scores[order], ids[possible][order]


def usable(vector: Column) -> Column:
    """The components as double; null if the vector can't take part."""
    fit = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fit, F.transform(vector, lambda x: x.cast("double")))


def _matrix(column: pa.Array) -> np.ndarray:
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), int(sizes.max(initial=0))))
    rows = np.repeat(np.arange(len(column)), sizes)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy()
    return out


def _split(table: pa.Table, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids and whole numbers of a group's narrow rows, ids and components of its wide ones."""
    ids, x = table.column("id").to_numpy(), _matrix(table.column("v").combine_chunks())
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    v, wide = quantise(x, scale)
    return ids[~wide], _narrow(v[~wide]), ids[wide], x[wide]


def _packed(key: str, rest: dict, wide_ids: np.ndarray, wide: np.ndarray, table: pa.Table) -> pa.Table:
    held = {key: table.column(key).slice(0, 1)} | {k: pa.array([v], pa.binary()) for k, v in rest.items()}
    return pa.table(held | {"wide_ids": pa.array([wide_ids.tobytes()], pa.binary()), "wide": pa.array([wide.tobytes()], pa.binary())})


def _index(scale: int):
    def run(table: pa.Table) -> pa.Table:
        ids, v, wide_ids, wide = _split(table, scale)
        return _packed("shard", {"postings": Shard(ids, v).to_bytes()}, wide_ids, wide, table)

    return run


def _asked(scale: int):
    def run(table: pa.Table) -> pa.Table:
        ids, v, wide_ids, wide = _split(table, scale)
        sink = pa.BufferOutputStream()
        np.save(sink, v)
        return _packed("tile", {"ids": ids.tobytes(), "v": sink.getvalue().to_pybytes()}, wide_ids, wide, table)

    return run


def _wide(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["wide_ids"], np.int64)
    return ids, np.frombuffer(row["wide"], np.float64).reshape(len(ids), -1) if len(ids) else np.zeros((0, 0))


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of whole rows of any size [a, b]; the shorter rows end in zeros."""
    d = min(a.shape[1], b.shape[1])
    return a[:, :d].astype(object) @ b[:, :d].astype(object).T if d else np.zeros((len(a), len(b)), object)


def _beyond(score: int) -> bytes | None:
    """A key in the order of scores, of those that no long holds."""
    return None if abs(score) < LONG else (score + (1 << 2303)).to_bytes(288, "big")


def _merge(k: int, scale: int):
    """The k best rows of a tile's queries in a shard."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        large: list[tuple[int, int, int]] = []
        for s in left.drop_columns(["tile"]).to_pylist():
            shard = Shard.from_bytes(s["postings"])
            near_ids, near = _wide(s)
            near = whole(near, scale)
            for t in right.drop_columns(["shard"]).to_pylist():
                ids, v = np.frombuffer(t["ids"], np.int64), np.load(pa.BufferReader(t["v"])).astype(np.int64)
                for i, scores, rows in search(shard, ids, v, k):
                    found.append((np.full(len(rows), ids[i]), rows, scores))
                ask_ids, ask = _wide(t)
                ask = whole(ask, scale)
                pairs = [(ids, v, near_ids, near), (ask_ids, ask, near_ids, near)] if len(near_ids) else []
                if len(ask_ids):
                    pairs.append((ask_ids, ask, shard.ids, shard.vectors(shard.dims)))
                for a_ids, a, b_ids, b in pairs:
                    for i in range(len(a_ids)):
                        scores = _dot(a[i : i + 1], b)[0].tolist()
                        best = sorted((-int(x), int(j)) for x, j in zip(scores, b_ids.tolist(), strict=True) if j != a_ids[i])[:k]
                        large += [(int(a_ids[i]), j, -x) for x, j in best]
        query, row, score = (np.concatenate([np.zeros(0, np.int64), *(x[c] for x in found)]) for c in range(3))
        more = [pa.array([x[c] for x in large], pa.int64()) for c in range(2)] + [pa.array([max(-LONG - 1, min(LONG, x[2])) for x in large], pa.int64())]
        beyond = pa.array([None] * len(query) + [_beyond(x[2]) for x in large], pa.binary())
        return pa.table([*(pa.concat_arrays([pa.array(a), b]) for a, b in zip((query, row, score), more, strict=True)), beyond], ["query_id", "vec_id", "score", "beyond"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = SCALE, shard_rows: int = SHARD_ROWS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best candidates; both frames have id long and v array<double>.

    Shards and tiles of queries hold bounded numbers of rows, dealt by hash. Shards are built once and written to the
    shared folder. Each tile meets each shard once, and their bests are merged by rank.
    """
    spark = vectors.sparkSession
    n, m = vectors.count(), queries.count()
    shards, tiles = max(1, -(-n // shard_rows)), max(1, -(-m // tile_rows))
    path = shared_folder(spark)
    dealt = vectors.select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int").alias("shard"))
    dealt.groupBy("shard").applyInArrow(thrifty_group(_index(scale)), "shard int, postings binary, wide_ids binary, wide binary").write.parquet(path)
    index = spark.read.parquet(path).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    asked = queries.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int").alias("tile")).groupBy("tile").applyInArrow(thrifty_group(_asked(scale)), "tile int, ids binary, v binary, wide_ids binary, wide binary")
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    got = index.groupBy("shard", "tile").cogroup(asked.groupBy("shard", "tile")).applyInArrow(thrifty_pair(_merge(k, scale)), FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return got.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_embeddings(embeddings: DataFrame, every: int = 20, k: int = 20, scale: int = SCALE) -> DataFrame:
    """Top k of the rows whose vec_id is a multiple of `every`, among all other rows."""
    rows = embeddings.select(F.col("vec_id").alias("id"), usable(F.col("embedding")).alias("v")).where("id is not null and v is not null")
    return top_k(rows, rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")), k, scale)
