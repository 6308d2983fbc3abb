"""Groups of sorted rows, components of graphs, spanning forests, and joins with what is known of keys of which few have very many rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topograph.llm.storage import stored

#: Branches of a node in a spanning tree.
FAN = 16
#: A key with more than one of so many rows is hot.
HOT = 1000


def tree(root: int, others: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect a row with others, FAN at most from each to later ones."""
    line = [root, *others.tolist()]
    return [(line[(k - 1) // FAN], line[k]) for k in range(1, len(line))]


def spanning(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
    """A spanning forest of n rows; near: which of some rows are linked with one."""
    left = np.arange(n)
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            i = todo.pop()
            hit = near(i, left)
            yield from tree(i, hit)
            todo += hit.tolist()
            left = np.setdiff1d(left, hit, assume_unique=True)


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows sorted by keys, and where the groups start (with the end at last)."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        code = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in code], axis=0)) + 1
        first = tuple(x[0] for x in code)
        if held and first != last:
            yield _starts(pa.Table.from_batches(held), keys)
            held = []
        if len(cuts):
            yield _starts(pa.Table.from_batches([*held, b.slice(0, cuts[-1])]), keys)
            held = [b.slice(cuts[-1])]
        else:
            held.append(b)
        last = tuple(x[-1] for x in code)
    if held:
        yield _starts(pa.Table.from_batches(held), keys)


def _starts(table: pa.Table, keys: list[str]) -> tuple[pa.Table, np.ndarray]:
    table = table.combine_chunks()
    code = [table.column(k).to_numpy() for k in keys]
    return table, np.concatenate([[0], np.flatnonzero(np.any([x[1:] != x[:-1] for x in code], axis=0)) + 1, [table.num_rows]])


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) of a graph of edges(a, b). In each round every node moves to the first of its
    neighbours and itself, in an order by a hash that changes from round to round, and edges are drawn anew between where
    their ends have moved. What has become one node has no edges left, so in each round a share of nodes and edges goes,
    whatever the graph's shape; all rounds together shuffle a few times the edges. Then the moves are put together."""
    ways = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    # both ways come from one run over the edges: another run may find another forest
    left = stored(edges.where("a <> b").select(F.explode(ways).alias("w")).select("w.*").distinct())
    moves: list[DataFrame] = []
    while not left.isEmpty():
        first = left.groupBy("u").agg(F.min(_placed("v", len(moves))).alias("near"))
        to = stored(first.select("u", F.least(_placed("u", len(moves)), F.col("near"))["n"].alias("to")))
        moved = left.join(to, "u").select(F.col("to").alias("u"), "v").join(to.select(F.col("u").alias("v"), "to"), "v")
        left = stored(moved.select("u", F.col("to").alias("v")).where("u <> v").distinct())
        moves.append(to)
    if not moves:
        return left.select(F.col("u").alias("node"), F.col("v").alias("component"))
    ends = moves.pop()
    while moves:
        later = ends.select(F.col("u").alias("to"), F.col("to").alias("end"))
        ends = moves.pop().join(later, "to", "left").select("u", F.coalesce("end", "to").alias("to"))
    ends = stored(ends)
    least = ends.groupBy("to").agg(F.count("*").alias("n"), F.min("u").alias("component"))
    return by_key(ends, least, "to", "n").select(F.col("u").alias("node"), "component")


def _placed(node: str, round_: int) -> Column:
    return F.struct(F.xxhash64(F.lit(round_), F.col(node)).alias("h"), F.col(node).alias("n"))


def by_key(rows: DataFrame, known: DataFrame, key: str, weight: str) -> DataFrame:
    """rows(key, ...) with the other columns of known(key, weight, ...), which has one row for each key and, as weight,
    how many rows have it. A key with more than one of HOT rows is hot; these are fewer than HOT, so they are broadcast,
    and their rows aren't dealt by the key. Keys are binary and not null."""
    least = (known.agg(F.sum(weight)).first()[0] or 0) / HOT
    own = F.struct(*(c for c in known.columns if c != key))
    hot = F.broadcast(known.where(F.col(weight) > least).select(F.col(key).alias("_hot"), own.alias("_known")))
    dealt = rows.join(hot, F.col(key) == F.col("_hot"), "left")
    apart = F.concat(F.lit(b"-"), F.encode(F.xxhash64(*rows.columns).cast("string"), "utf-8"))  # no key is so named: it is joined with nothing
    dealt = dealt.withColumn("_key", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(apart))
    cold = known.where(F.col(weight) <= least).select(F.col(key).alias("_key"), own.alias("_own"))
    return dealt.join(cold, "_key", "left").select(*rows.columns, F.coalesce("_known", "_own").alias("_own")).select(*rows.columns, "_own.*")
