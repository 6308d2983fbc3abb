"""A chunk table with a tree of its level values, and clustered by it on disk.

A node is a combination of level values that chunks have; in the order of its values it has a number, so all nodes below
a branch are neighbours. A clustered table keeps chunks in the order of their node's number, in zones (folders) of equal
numbers of nodes. A search asks the nodes, of which there are few, which of them its filters want; their numbers reach
the scan of the chunks as ranges, zones that aren't wanted aren't opened, and in the others the statistics of row groups
leave out what lies between. A table that isn't clustered is joined with its nodes by the level values.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from topograph.errors import StoreConfigurationError
from topograph.lineage import cut, numbered

ZONES = 64
#: Ranges that a search's filters come down to at most; nodes between that nobody asks for are left out by the join.
RANGES = 32


class Store:
    """rows: the chunk table. nodes: one row for each combination of its level values, with `chunks`, their number, and
    `node`, its number, if the rows have one."""

    def __init__(self, rows: DataFrame, levels: Sequence[str], nodes: DataFrame, zones: int | None = None, node_count: int = 0):
        self.rows, self.levels, self.nodes, self.zones, self.node_count = rows, list(levels), nodes, zones, node_count

    @classmethod
    def of(cls, chunks: DataFrame, levels: Sequence[str]) -> Store:
        """Any chunk table. Its level columns are read once for the nodes."""
        for c in set(levels) - set(chunks.columns):
            raise StoreConfigurationError(f"the chunk table has no column {c!r}")
        return cls(chunks, levels, cut(_nodes(chunks, levels)))

    @classmethod
    def write(cls, chunks: DataFrame, levels: Sequence[str], folder: str, zones: int = ZONES) -> Store:
        """Clusters a chunk table below a folder. A node with very many chunks is cut by their hash, so no task gets it whole."""
        spark = chunks.sparkSession
        if clash := {"node", "zone"} & set(chunks.columns):
            raise StoreConfigurationError(f"the chunk table can't have columns {sorted(clash)}")
        nodes = numbered(_nodes(chunks, levels), [F.asc_nulls_first(c) for c in levels] or [F.lit(0)], "node")
        count = nodes.count()
        nodes.withColumn("zone", _zone(count, zones)).write.parquet(f"{folder}/nodes")
        held = spark.read.parquet(f"{folder}/nodes")
        rows = _beside(chunks, held.select(*levels, "node", "zone"), levels)
        rows.repartitionByRange("node", F.xxhash64("chunk_id")).sortWithinPartitions("zone", "node").write.partitionBy("zone").parquet(f"{folder}/chunks")
        kind = rows.select(*(c for c in rows.columns if c != "zone"), "zone").schema.json()  # no chunks leave no file that has it
        about = spark.createDataFrame([(list(levels), zones, count, kind)], "levels array<string>, zones int, nodes long, kind string")
        about.coalesce(1).write.parquet(f"{folder}/about")  # written last: without it there is no table
        return cls.open(spark, folder)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Store:
        about = spark.read.parquet(f"{folder}/about").first()
        if about is None:
            raise StoreConfigurationError(f"{folder} has no chunk table")
        rows = spark.read.schema(StructType.fromJson(json.loads(about["kind"]))).parquet(f"{folder}/chunks")
        return cls(rows, about["levels"], spark.read.parquet(f"{folder}/nodes"), about["zones"], about["nodes"])

    def offers(self, sets: Sequence[Sequence[str]]) -> DataFrame:
        """Each node once for every set of keys of which it has all values: set (its number) and values, in the order of keys."""
        made = [F.when(F.lit(True) if not s else F.forall(F.array(*s), lambda v: v.isNotNull()), F.struct(F.lit(i).alias("set"), (F.array(*(F.col(c).cast("string") for c in s)) if s else F.array().cast("array<string>")).alias("values"))) for i, s in enumerate(sets)]
        return self.nodes.select("*", F.explode(F.array_compact(F.array(*made))).alias("_offer")).select("*", "_offer.*").drop("_offer")

    def pruned(self, wanted: DataFrame) -> DataFrame:
        """The rows of the ranges in which wanted(node) lie; RANGES short rows come to the driver."""
        if self.zones is None:
            return self.rows
        step = max(1, -(-self.node_count // RANGES))
        found = wanted.groupBy(F.floor(F.col("node") / step)).agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.min("zone").alias("first"), F.max("zone").alias("last")).collect()
        ranges: list[list[int]] = []
        for lo, hi, first, last in sorted((r["lo"], r["hi"], r["first"], r["last"]) for r in found):
            if ranges and lo == ranges[-1][1] + 1:
                ranges[-1][1], ranges[-1][3] = hi, last
            else:
                ranges.append([lo, hi, first, last])
        if not ranges:
            return self.rows.limit(0)
        return self.rows.where(reduce(or_, (F.col("zone").between(first, last) & F.col("node").between(lo, hi) for lo, hi, first, last in ranges)))

    def beside(self, rows: DataFrame, wanted: DataFrame, few: bool) -> DataFrame:
        """rows with what is known of their nodes."""
        wanted = F.broadcast(wanted) if few else wanted
        if self.zones is not None:
            return rows.drop("zone", *self.levels).join(wanted.drop("zone", *self.levels), "node")
        return _beside(rows, wanted, self.levels)


def _nodes(chunks: DataFrame, levels: Sequence[str]) -> DataFrame:
    return chunks.groupBy(*levels).agg(F.count("*").alias("chunks"))


def _zone(nodes: int, zones: int) -> Column:
    return F.floor(F.col("node") * min(zones, max(1, nodes)) / max(1, nodes)).cast("int")


def _beside(rows: DataFrame, nodes: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Joined by level values, of which a missing one equals a missing one."""
    named = nodes.select(*(F.col(c).alias(f"_own{i}") if c in levels else F.col(c) for i, c in enumerate(nodes.columns)))
    own = {c: f"_own{i}" for i, c in enumerate(nodes.columns) if c in levels}
    same = reduce(and_, (rows[c].eqNullSafe(F.col(n)) for c, n in own.items()), F.lit(True))
    return rows.join(named, same).drop(*own.values())
