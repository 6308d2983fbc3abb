"""The engine: resolve, plan, retrieve, choose and clarify for a batch of queries."""

from __future__ import annotations

import asyncio
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topograph.errors import StoreConfigurationError
from topograph.functions.confidence import Thresholds
from topograph.lineage import cut
from topograph.operators import clarify, retrieve, search
from topograph.operators.cache import FIELDS, LIMIT, Cache, keyed
from topograph.operators.resolve import Catalog, resolve
from topograph.operators.store import Store
from topograph.operators.vectors import Vectors
from topograph.plans.template import Attempt, default_attempts, resolve_plan
from topograph.sources import artifacts


class Engine:
    """chunks: the chunk table (see operators.search), with a column for each level, or a clustered one (operators.store).

    search() takes queries(query_id, message, vector array<float>, and explicit and conversation if there are any) and
    returns one outcome a query. Contexts and outcomes are made once, in a few jobs, and written to the checkpoint folder;
    the questions are planned on top of them. The cache never holds more than cache_limit entries of a version (None: no limit). `catalog` is
    one that is kept up by versions (operators.catalogs), which engines share; without it one is made of the documents.
    With `vectors`, queries without a vector column get the vectors of their messages, each embedded once.
    """

    def __init__(self, documents: DataFrame, chunks: DataFrame | Store, level_names: Sequence[str], *, attempts: Sequence[Attempt] | None = None, thresholds: Thresholds = Thresholds(), k: int = search.TOP_K, version: str = "", cache_root: str | None = None, cache_limit: int | None = LIMIT, values: DataFrame | None = None, catalog: Catalog | None = None, vectors: Vectors | None = None):
        if not isinstance(chunks, (DataFrame, Store)):
            raise StoreConfigurationError("chunks must be a DataFrame or a Store")
        rows = chunks.rows if isinstance(chunks, Store) else chunks
        if missing := {"chunk_id", "doc_id", "filename", "text", "embedding", *level_names} - set(rows.columns):
            raise StoreConfigurationError(f"the chunk table lacks {sorted(missing)}")
        self.documents, self.levels = documents, list(level_names)
        self.store = chunks if isinstance(chunks, Store) else Store.of(chunks, self.levels)  # probed once
        self.attempts = default_attempts(self.levels) if attempts is None else list(attempts)
        self.thresholds, self.k, self.version = thresholds, search.clamp(k), version
        self.cache = Cache(documents.sparkSession, cache_root, cache_limit) if cache_root else None
        if catalog is not None and catalog.levels != self.levels:
            raise StoreConfigurationError(f"the catalog has the levels {catalog.levels}")
        self.vectors = vectors
        self.catalog = (Catalog.of(documents, self.levels, values) if catalog is None else catalog).keep()  # filled by the first batch, used by all

    @classmethod
    def from_artifacts(cls, spark: SparkSession, folder: str | Path, chunks: DataFrame | Store, **more) -> Engine:
        """The corpus map is needed; plan and confidence configuration are used if they are there."""
        folder = Path(folder)
        levels, version, documents = artifacts.load_documents(spark, folder / artifacts.NAMES["corpus_map"])
        if (path := folder / artifacts.NAMES["search_plan"]).exists():
            more.setdefault("attempts", artifacts.load_template(path).attempts)
        if (path := folder / artifacts.NAMES["confidence_config"]).exists():
            more.setdefault("thresholds", artifacts.load_thresholds(path))
        return cls(documents, chunks, levels, version=version, **more)

    @classmethod
    def from_tables(cls, spark: SparkSession, folder: str, chunks: DataFrame | Store, **more) -> Engine:
        """From the Parquet tables of artifacts.write_tables(): any size, in any store that Spark reads."""
        held = artifacts.load_tables(spark, folder)
        more = {"attempts": held.template.attempts, "thresholds": held.thresholds, "values": held.values} | more
        return cls(held.documents, chunks, held.level_names, version=held.version, **more)

    def close(self) -> None:
        """Lets go of the catalog that is held between batches."""
        self.catalog.release()

    def resolve(self, queries: DataFrame) -> DataFrame:
        return resolve(queries, self.catalog)

    def plan(self, contexts: DataFrame) -> DataFrame:
        return resolve_plan(contexts, self.levels, self.attempts)

    def retrieve(self, contexts: DataFrame, vectors: DataFrame) -> DataFrame:
        """Outcomes of contexts; vectors has query_id and vector."""
        plan = self.plan(contexts)
        sets = search.key_sets(a.filter_keys for a in self.attempts) or [()]

        def find(attempts: DataFrame) -> DataFrame:
            return search.find(attempts.join(vectors, "query_id"), self.store, sets, self.k)

        return retrieve.with_unplanned(retrieve.choose(retrieve.run(plan, find, self.thresholds)), contexts)

    def search(self, queries: DataFrame, ask: bool = True) -> DataFrame:
        """One outcome a query, with the resolved context and, if `ask`, a clarification where one is needed."""
        if self.vectors is not None and "vector" not in queries.columns:
            queries = cut(self.vectors.of(queries))
        contexts = cut(self.resolve(queries))
        keys = keyed(contexts, self.version)
        held, todo = (None, keys) if self.cache is None else self.cache.get(keys, self.version)
        fresh = self.retrieve(todo.drop("key"), queries.select("query_id", "vector"))
        outcomes = fresh
        if held is not None:
            fixed = {"executed": F.lit(True), "attempt": F.lit(None).cast("int"), "result_count": F.size("results"), "cache_hit": F.lit(True), "error": F.lit(None).cast("string")}
            old = held.select("query_id", *FIELDS, *(v.alias(k) for k, v in fixed.items()))
            outcomes = fresh.unionByName(old.withColumn("should_answer", retrieve.should_answer(F.col("executed"), F.col("confidence"), F.col("result_count"))))
        outcomes = cut(outcomes)
        if self.cache is not None and self.version:
            self.cache.put(outcomes.where("not cache_hit"), keys, self.version)
        if ask:
            first = self.catalog.values.where("level = 0")
            outcomes = clarify.attach(outcomes, clarify.clarify(contexts, outcomes, first, self.levels))
        return outcomes.join(contexts.select("query_id", "effective_query", "resolved", "next_level", "next_values"), "query_id")

    async def asearch(self, queries: DataFrame, ask: bool = True) -> list:
        """The rows of search(), collected in a thread so that an event loop can go on."""
        return await asyncio.to_thread(lambda: self.search(queries, ask).collect())

    async def aresolve(self, queries: DataFrame) -> list:
        """The rows of resolve(), likewise."""
        return await asyncio.to_thread(lambda: self.resolve(queries).collect())

    async def aretrieve(self, contexts: DataFrame, vectors: DataFrame) -> list:
        """The rows of retrieve(), likewise."""
        return await asyncio.to_thread(lambda: self.retrieve(contexts, vectors).collect())
