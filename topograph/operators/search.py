"""Filtered top-k similarity search over a chunk table.

chunks has chunk_id, doc_id, filename, text, embedding (array<float>) and a column for each level. An attempt's filter is
an equality on some levels: the number of its set of keys and the values of these, compared as values. The nodes of the
table (see operators.store) say which of them a filter wants, so no pair of query and chunk is looked at that the filter
doesn't allow. A filter's chunks are dealt out in slices and its queries in tiles, both of bounded size (those of
everything are no hot key); a slice meets a tile in blocks as one matrix product, and the slices' bests are merged by
rank.

A chunk or query without a usable vector (null, with null or non-finite components, or all zero) has no score and isn't
found. A query whose vector has another length than a chunk that it meets fails, as in a store that refuses it: its
attempt has a row with `error`, first in rank, and no chunk there. Ties go to the smaller chunk_id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from topograph.functions import text as T
from topograph.lineage import cut
from topograph.operators.store import Store
from topograph.plans.filters import to_column
from topograph.workers import reach

SLICE, TILE, BLOCK = 1 << 15, 1 << 13, 128
#: Pairs of a node and a filter that pass the driver and are broadcast to the chunks; more are written and joined.
FEW_NODES = 20_000
TOP_K = 6
HIT = "struct<score:double,snippet:string,metadata:map<string,string>,doc_id:string,filename:string>"


def embedded(queries: DataFrame, embed: Callable[[pd.Series], pd.Series], text: str = "message") -> DataFrame:
    """Queries with `vector`, from a function of a batch of texts, for stores that don't embed by themselves."""
    return queries.withColumn("vector", F.pandas_udf(embed, ArrayType(FloatType()))(F.col(text)))


def clamp(k: int) -> int:
    return max(1, int(k))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double, null without a direction; for a few pairs, where no block is worth it."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)


def _unit(column: pa.ChunkedArray, width: int) -> np.ndarray:
    rows = column.combine_chunks()
    x = np.zeros((len(rows), width))
    sizes = rows.value_lengths().to_numpy(zero_copy_only=False)
    at = np.repeat(np.arange(len(rows)), sizes)
    x[at, np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = rows.flatten().to_numpy()
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _meet(k: int) -> Callable:
    """The k best of a slice's chunks for each query of a tile; queries of another length than any of them fail."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[str, list[np.ndarray]] = {"query": [], "row": [], "score": []}
        failed = pa.table({c: left.column(c).slice(0, 0) for c in ("query_id", "attempt")} | {"error": pa.array([], pa.string())})
        if left.num_rows and right.num_rows:
            widths = pa.compute.unique(pa.compute.list_value_length(right.column("vector"))).to_pylist()
            fits = pa.compute.equal(pa.compute.list_value_length(left.column("vector")), widths[0] if len(widths) == 1 else -1)
            bad = left.filter(pa.compute.invert(fits))
            said = [f"StoreError: a vector of {n} components, chunks have {', '.join(map(str, sorted(widths)))}" for n in pa.compute.list_value_length(bad.column("vector")).to_pylist()]
            failed, left = bad.select(["query_id", "attempt"]).append_column("error", pa.array(said, pa.string())), left.filter(fits)
        if left.num_rows and right.num_rows:
            rows = _unit(right.column("vector"), widths[0]).T
            place = np.argsort(np.argsort(np.array(right.column("chunk_id").to_pylist(), dtype=object), kind="stable"))
            for lo in range(0, left.num_rows, BLOCK):
                scores = _unit(left.column("vector").slice(lo, BLOCK), widths[0]) @ rows
                for i, own in enumerate(scores):
                    near = np.round(own, 12)  # sums in another order may differ in the last bits
                    best = np.flatnonzero(near >= np.partition(near, -k)[-k]) if len(near) > k else np.arange(len(near))
                    best = best[np.lexsort((place[best], -near[best]))[:k]]
                    found["query"].append(np.full(len(best), lo + i))
                    found["row"].append(best)
                    found["score"].append(own[best])
        q, r, s = (np.concatenate([np.zeros(0, kind), *found[c]]) for c, kind in (("query", int), ("row", int), ("score", float)))
        good = pa.table({"query_id": left.column("query_id").take(pa.array(q)), "attempt": left.column("attempt").take(pa.array(q)), "chunk_id": right.column("chunk_id").take(pa.array(r)), "score": s})
        return pa.concat_tables([good, failed], promote_options="default").select(["query_id", "attempt", "chunk_id", "score", "error"])

    return run


def key_sets(steps: Iterable[Sequence[str]]) -> list[tuple[str, ...]]:
    """All sets of keys that a plan's filters can come down to when levels are missing."""
    return sorted({c for s in steps for n in range(len(s) + 1) for c in combinations(sorted(s), n)})


def _wanted(pairs: Column, sets: Sequence[Sequence[str]]) -> tuple[Column, Column]:
    """The number of a filter's set of keys, and its values in the order of keys."""
    ordered = F.array_sort(pairs)
    known = F.array(*(F.array(*map(F.lit, s)) if s else F.array().cast("array<string>") for s in sets))
    at = F.array_position(known, F.transform(ordered, lambda p: p["key"])).cast("int")
    missing = F.raise_error(F.concat(F.lit("no set of keys for a filter on "), F.array_join(F.transform(ordered, lambda p: p["key"]), ", "))).cast("int")
    return F.when(at == 0, missing).otherwise(at - 1), F.transform(ordered, lambda p: p["value"])


def _matched(attempts: DataFrame, store: Store, sets: Sequence[Sequence[str]], slice_rows: int, tile_rows: int) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """The attempts with their filter's set and values, the nodes that these want, the numbers of slices and tiles of each
    filter, and whether these two are few; then they are local, and what follows deals neither."""
    number, values = _wanted(F.col("pairs"), sets)
    asked = attempts.where(_usable(F.col("vector"))).select("query_id", "attempt", "vector", number.alias("set"), values.alias("values"))
    queries = asked.groupBy("set", "values").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("tiles"))
    nodes = store.offers(sets).join(queries, ["set", "values"])
    head = nodes.limit(FEW_NODES + 1).toArrow()
    few = head.num_rows <= FEW_NODES
    nodes = attempts.sparkSession.createDataFrame(head) if few else cut(nodes)
    sizes = nodes.groupBy("set", "values").agg(F.ceil(F.sum("chunks") / slice_rows).cast("int").alias("slices"), F.first("tiles").alias("tiles"))
    if few:
        sizes = attempts.sparkSession.createDataFrame(sizes.toArrow())
    return asked, nodes, sizes, few


def _searched(attempts: DataFrame, chunks: DataFrame | Store, sets: Sequence[Sequence[str]], k: int, slice_rows: int, tile_rows: int) -> tuple[DataFrame, DataFrame]:
    """What search() returns, and the chunks that it had to read."""
    reach(attempts.sparkSession)
    sets = [tuple(sorted(s)) for s in sets]
    store = chunks if isinstance(chunks, Store) else Store.of(chunks, sorted({key for s in sets for key in s}))
    asked, nodes, sizes, few = _matched(attempts, store, sets, slice_rows, tile_rows)
    rows = store.pruned(nodes)
    kinds = dict(attempts.dtypes) | {"chunk_id": dict(rows.dtypes)["chunk_id"]}
    usable = rows.where(_usable(F.col("embedding"))).select("chunk_id", F.col("embedding").alias("vector"), *(c for c in (*store.levels, "node", "zone") if c in rows.columns))
    sizes = F.broadcast(sizes) if few else sizes
    offered = store.beside(usable, nodes.drop("chunks", "tiles").join(sizes, ["set", "values"]), few)
    offered = offered.select("set", "values", "chunk_id", "vector", F.pmod(F.xxhash64("chunk_id"), F.col("slices")).cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    asked = asked.join(sizes, ["set", "values"])
    asked = asked.select("set", "values", "query_id", "attempt", "vector", F.pmod(F.xxhash64("query_id", "attempt"), F.col("tiles")).cast("int").alias("tile"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    kind = f"query_id {kinds['query_id']}, attempt {kinds['attempt']}, chunk_id {kinds['chunk_id']}, score double, error string"
    key = ["set", "values", "slice", "tile"]
    met = asked.groupBy(*key).cogroup(offered.groupBy(*key)).applyInArrow(_meet(clamp(k)), kind)
    best = Window.partitionBy("query_id", "attempt").orderBy(F.col("error").isNull(), F.desc(F.round("score", 12)), "chunk_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= clamp(k)), rows


def search(attempts: DataFrame, chunks: DataFrame | Store, sets: Sequence[Sequence[str]], k: int = TOP_K, slice_rows: int = SLICE, tile_rows: int = TILE) -> DataFrame:
    """query_id, attempt, rank, score and chunk_id of each attempt's best chunks, and error; attempts has query_id, attempt,
    pairs and vector. An attempt that failed anywhere has an error at rank 1; what else was found for it isn't all."""
    return _searched(attempts, chunks, sets, k, slice_rows, tile_rows)[0]


def hits(found: DataFrame, chunks: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Adds `hit` to search results: score, snippet, metadata (levels, doc_id, filename), doc_id and filename. It's null
    beside an error."""
    meta = F.create_map(*(x for n in [*levels, "doc_id", "filename"] for x in (F.lit(n), F.col(n).cast("string"))))
    held = chunks.select("chunk_id", T.snippet(F.col("text")).alias("snippet"), meta.alias("metadata"), F.col("doc_id").cast("string"), "filename")
    hit = F.struct("score", "snippet", "metadata", F.coalesce("doc_id", F.col("chunk_id").cast("string")).alias("doc_id"), F.coalesce("filename", F.element_at("metadata", F.lit("filename"))).alias("filename"))
    error = F.col("error") if "error" in found.columns else F.lit(None).cast("string")
    return found.join(held, "chunk_id", "left").select("query_id", "attempt", "rank", F.when(F.col("chunk_id").isNotNull(), hit).alias("hit"), error.alias("error"))


def find(attempts: DataFrame, store: Store, sets: Sequence[Sequence[str]], k: int = TOP_K) -> DataFrame:
    """search() and hits(); texts, too, are read only from the ranges that the filters want."""
    found, rows = _searched(attempts, store, sets, k, SLICE, TILE)
    return hits(found, rows, store.levels)


def narrowed(chunks: DataFrame, tree: dict | None, namespace: str | None = None) -> DataFrame:
    """Chunks that a filter and a namespace leave, as predicates that reach the scan."""
    rows = chunks.where(to_column(tree))
    return rows if namespace is None else rows.where(F.col("namespace") == namespace)


def fixture_search(attempts: DataFrame, fixture: DataFrame, k: int = TOP_K) -> DataFrame:
    """A store of canned results: query_id, attempt, rank and the row, for tests.

    fixture has bucket, position, signature, row_no, score, snippet, metadata and doc_id. A query's bucket is the one of
    its text, else of its lower-case text, else the first whose name it contains; the first k rows are taken before
    they are sorted by score. attempts has query_id, message, attempt and pairs.
    """
    names = fixture.groupBy("bucket").agg(F.min("position").alias("position"))
    q = attempts.select("query_id", "message").distinct()
    low = F.lower("message")
    choice = F.when(F.col("bucket") == F.col("message"), 0).when(F.col("bucket") == low, 1).otherwise(2)
    # a fixture is a handful of rows written by hand
    near = q.join(F.broadcast(names), F.contains(low, F.lower("bucket"))).withColumn("choice", choice)
    near = near.groupBy("query_id").agg(F.min_by("bucket", F.struct("choice", "position")).alias("bucket"))
    rows = attempts.withColumn("signature", T.filter_signature(F.col("pairs"))).join(near, "query_id").join(fixture.drop("position"), ["bucket", "signature"]).where(F.col("row_no") <= clamp(k))
    order = Window.partitionBy("query_id", "attempt").orderBy(F.desc("score"), "row_no")
    return rows.withColumn("rank", F.row_number().over(order)).select("query_id", "attempt", "rank", "score", "snippet", "metadata", "doc_id")
