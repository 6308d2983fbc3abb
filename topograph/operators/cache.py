"""A result cache as a keyed table: one entry a key, in buckets of keys, kept apart by corpus version."""

from __future__ import annotations

import asyncio
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topograph.functions.text import cache_key, signature
from topograph.lineage import store_of
from topograph.operators.search import HIT

LIMIT = 1024
FIELDS = ("reason", "confidence", "top_score", "attempts_made", "results")
ENTRY = f"key string, reason string, confidence string, top_score double, attempts_made int, results array<{HIT}>, cached_at timestamp, seq bigint, place bigint, first struct<seq:bigint,place:bigint>, corpus_version string"
#: Folders that the keys are dealt to, and keys of a lookup up to which the files' Bloom filters are asked.
BUCKETS, FEW_KEYS = 64, 10
#: Keys that the Bloom filters of a cache without a limit are made for; with more they let more row groups pass.
UNLIMITED = 1 << 20


def keyed(contexts: DataFrame, version: str) -> DataFrame:
    """Contexts with their cache key: of the normal form of the query, so that writings of one query share an entry."""
    return contexts.withColumn("key", cache_key(F.col("normalized_query"), F.lit(version), signature(F.col("resolved"))))


def _order(entries: DataFrame) -> list[str]:
    """When an entry came: its batch, and its place in it."""
    return [c for c in ("seq", "place") if c in entries.columns]


def lookup(keys: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keys with their newest entry, keys without one). An empty version is never cached."""
    newest = entries.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(*(F.desc(c) for c in _order(entries))))).where("_n = 1").drop("_n")
    return keys.join(newest, "key"), keys.join(entries, "key", "left_anti")


def admitted(outcomes: DataFrame) -> DataFrame:
    """Outcomes that may be stored: executed and without an error, whatever their confidence."""
    return outcomes.where(F.col("executed") & F.col("error").isNull())


def pruned(entries: DataFrame, version: str) -> DataFrame:
    """Entries of one corpus version."""
    return entries.where(F.col("corpus_version") == version)


def evicted(entries: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The last `limit` keys by first insertion, each with its newest entry: writing a key again doesn't move it.

    The limit is first applied to each partition of the keys by a top-n over seq, so no task sorts all entries.
    """
    when = F.struct(*_order(entries))
    keys = entries.groupBy("key").agg(F.min(when).alias("first"), F.max_by(F.struct(*(F.col(c) for c in entries.columns if c != "key")), when).alias("entry"))
    return keys.orderBy(F.desc("first"), "key").limit(limit).select("key", "entry.*")


def bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def kept(entries: DataFrame, limit: int | None) -> DataFrame:
    """One entry a key, the newest, with the time its key first came; the last `limit` keys by that time (None: all)."""
    when = F.struct("seq", "place")
    one = entries.groupBy("key").agg(F.min("first").alias("first"), F.max_by(F.struct(*(c for c in entries.columns if c not in ("key", "first"))), when).alias("_entry"))
    return (one if limit is None else one.orderBy(F.desc("first"), "key").limit(limit)).select("key", "_entry.*", "first")


class Cache:
    """Entries below a folder that all executors see. Every put makes a new generation of its version: one entry a key,
    the newest, and no more than `limit` of them (None: all), sorted in one file a bucket with a Bloom filter of its keys. A
    generation is seen once it is whole; the one before stays for those who are reading it. Of two puts at one time the
    later one's generation counts, and what only the other had is a miss, as is what a damaged file held."""

    def __init__(self, spark: SparkSession, root: str, limit: int | None = LIMIT):
        self.spark, self.path, self.limit = spark, f"{root}/retrieval_cache", limit

    def _folders(self, path: str) -> list[str]:
        fs, own = store_of(self.spark, path)
        return sorted(s.getPath().getName() for s in fs.listStatus(own)) if fs.exists(own) else []

    def _version(self, version: str) -> str:
        return f"{self.path}/corpus_version={version}"

    def _generations(self, version: str) -> list[str]:
        """Those that are whole, the oldest first."""
        fs, _ = store_of(self.spark, self.path)
        found = (f"{self._version(version)}/{g}" for g in self._folders(self._version(version)) if g.startswith("gen-"))
        return [g for g in found if fs.exists(store_of(self.spark, f"{g}/_SUCCESS")[1])]

    def entries(self, version: str | None = None) -> DataFrame | None:
        """Entries of one version or of all, with their bucket."""
        versions = [version] if version is not None else [f.removeprefix("corpus_version=") for f in self._folders(self.path) if f.startswith("corpus_version=")]
        newest = [(v, self._generations(v)[-1:]) for v in versions]
        read = self.spark.read.schema(f"{ENTRY.rpartition(',')[0]}, bucket int").option("ignoreCorruptFiles", "true")
        out = None
        for v, path in newest:
            if path:
                own = read.parquet(path[0]).withColumn("corpus_version", F.lit(v))
                out = own if out is None else out.unionByName(own)
        return out

    def _write(self, rows: DataFrame, version: str) -> None:
        old = self._generations(version)
        name = f"{self._version(version)}/gen-{int(old[-1].rpartition('gen-')[2].split('-')[0]) + 1 if old else 0:012d}-{uuid.uuid4().hex[:8]}"
        rows = rows.drop("corpus_version").withColumn("bucket", bucket(F.col("key"))).repartition("bucket").sortWithinPartitions("bucket", "key")
        rows.write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", str(max(1000, (UNLIMITED if self.limit is None else self.limit) // BUCKETS))).partitionBy("bucket").parquet(name)
        for g in old[:-1]:
            fs, own = store_of(self.spark, g)
            fs.delete(own, True)

    def put(self, outcomes: DataFrame, keys: DataFrame, version: str) -> None:
        """Adds outcomes (by query_id) under the keys of their contexts, and lets go of the keys that came first, if there
        are more than the limit. Rows of one put come in the order of their query_id if it's a number."""
        if not version:
            return
        rows = admitted(outcomes).join(keys.select("query_id", "key"), "query_id")
        number = dict(outcomes.dtypes)["query_id"] in ("tinyint", "smallint", "int", "bigint")
        place = F.col("query_id").cast("long") if number else F.xxhash64("query_id")
        rows = rows.select("key", *FIELDS, F.current_timestamp().alias("cached_at"), F.unix_micros(F.current_timestamp()).alias("seq"), place.alias("place")).withColumn("first", F.struct("seq", "place"))
        held = self.entries(version)
        rows = rows if held is None else rows.unionByName(held.drop("bucket", "corpus_version"))
        self._write(kept(rows, self.limit), version)

    def keep_last(self, version: str, limit: int | None = LIMIT) -> None:
        """A new generation with fewer entries."""
        held = self.entries(version)
        if held is not None:
            self._write(kept(held.drop("bucket"), limit), version)

    def get(self, keys: DataFrame, version: str) -> tuple[DataFrame | None, DataFrame]:
        """(keys with their entry, keys without one). Only the buckets of the keys are read, and of few keys only the row
        groups whose Bloom filters may have them."""
        held = self.entries(version) if version else None
        if held is None:
            return None, keys
        wanted = keys.select("key").distinct().limit(FEW_KEYS + 1).collect()
        if len(wanted) <= FEW_KEYS:
            held = held.where(F.col("key").isin([r["key"] for r in wanted]) & F.col("bucket").isin([r["b"] for r in self.spark.createDataFrame(wanted, "key string").select(bucket(F.col("key")).alias("b")).collect()]))
        else:
            held = held.where(F.col("bucket").isin([r["b"] for r in keys.select(bucket(F.col("key")).alias("b")).distinct().collect()]))  # BUCKETS at most
        return lookup(keys, held)

    def prune(self, version: str) -> int:
        """Drops the entries of other versions; says of how many."""
        old = [f for f in self._folders(self.path) if f.startswith("corpus_version=") and f != f"corpus_version={version}"]
        for f in old:
            fs, own = store_of(self.spark, f"{self.path}/{f}")
            fs.delete(own, True)
        return len(old)

    def clear(self) -> None:
        fs, own = store_of(self.spark, self.path)
        fs.delete(own, True)

    async def aget(self, keys: DataFrame, version: str) -> list:
        """The rows of the keys that have an entry, collected in a thread."""
        return await asyncio.to_thread(lambda: [] if (hit := self.get(keys, version)[0]) is None else hit.collect())

    async def aput(self, outcomes: DataFrame, keys: DataFrame, version: str) -> None:
        await asyncio.to_thread(self.put, outcomes, keys, version)
