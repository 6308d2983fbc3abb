"""Versions of a chunk table: what a new version changes, and a stored table that takes change sets.

A stored table is a base, the change sets since it, and a state row for each version that names them. An upload writes
its change set (added, changed and removed chunks) first and its state row last, so one that is interrupted leaves the
version before it in force, and can be repeated. Reading takes each chunk's newest change in place of its base row; once
the changes are a quarter of the base they are written together as a new base. Only state rows come to the driver.

Every chunk has a chunk_id of its own: one that is null or repeated raises, as do columns other than the stored ones. Other
columns may be null and may have any name. An empty version removes everything.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from topograph.errors import StoreConfigurationError
from topograph.lineage import store_of
from topograph.operators.corpus import upload_due

#: Changes as a share of the base's chunks from which on a new base is written.
COMPACT_AT = 0.25
STATE = "number long, version string, base string, changes array<string>, chunks long, changed long, kind string"
#: Instants keep their microseconds, and a null isn't a missing key.
EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def _row(columns: Sequence[str]) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in columns))


def demand_keys(rows: DataFrame, key: str) -> None:
    """Raises if a row's key is null or another row's."""
    wrong = rows.groupBy(F.col(f"`{key}`").alias("key")).count().where("key is null or count > 1").first()
    if wrong is not None:
        raise StoreConfigurationError(f"{wrong['count']} rows have {key} {wrong['key']!r}")


def change_set(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """key, change (added, changed, removed) and row (the new row, null if removed) of the chunks that differ. Of the old
    version only keys and digests are shuffled."""
    if set(old.columns) != set(new.columns):
        raise StoreConfigurationError(f"columns differ: {sorted(set(old.columns) ^ set(new.columns))}")
    digest = F.sha2(F.to_json(_row(sorted(old.columns)), EXACT), 256)
    was = old.select(F.col(f"`{key}`").alias("key"), digest.alias("was"))
    now = new.select(F.col(f"`{key}`").alias("key"), digest.alias("now"), _row(old.columns).alias("row"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
    return was.join(now, "key", "full").where(~F.col("was").eqNullSafe(F.col("now"))).select("key", change.alias("change"), "row")


class Versions:
    """A chunk table in a folder, by versions."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "chunk_id"):
        self.spark, self.folder, self.key = spark, folder, key

    def state(self) -> Row | None:
        """The newest version's state row, None before the first."""
        fs, path = store_of(self.spark, f"{self.folder}/state")
        if not fs.exists(path):
            return None
        return self.spark.read.schema(STATE).parquet(f"{self.folder}/state").orderBy(F.desc("number")).first()

    def upload(self, chunks: DataFrame, version: str, force: bool = False) -> dict[str, int] | None:
        """Makes chunks the table's newest version. Returns how many were added, changed and removed; None if the version
        is there already (and not forced)."""
        state = self.state()
        if not upload_due(state and {"corpus_version": state["version"]}, version, state is not None, force):
            return None
        demand_keys(chunks, self.key)
        if state is None:
            n = self._write(chunks, path := self._new("base"))
            self._record(0, version, path, [], n, 0, chunks.schema.json())
            return {"added": n, "changed": 0, "removed": 0}
        path = self._new("changes")
        change_set(self.read(), chunks, self.key).write.parquet(f"{self.folder}/{path}")
        counts = {r["change"]: r["count"] for r in self._changes([path], state).groupBy("change").count().collect()}
        self._record(state["number"] + 1, version, state["base"], [*state["changes"], path], state["chunks"], state["changed"] + sum(counts.values()), state["kind"])
        if state["changed"] + sum(counts.values()) > COMPACT_AT * state["chunks"]:
            self.compact()
        return {c: counts.get(c, 0) for c in ("added", "changed", "removed")}

    def read(self) -> DataFrame:
        """The newest version's chunks."""
        state = self.state()
        if state is None:
            raise StoreConfigurationError(f"{self.folder} has no version")
        base = self.spark.read.schema(StructType.fromJson(json.loads(state["kind"]))).parquet(f"{self.folder}/{state['base']}")
        if not state["changes"]:
            return base
        newest = self._changes(state["changes"], state).groupBy("key").agg(F.max_by(F.struct("change", "row"), "at").alias("last"))
        kept = base.join(newest.select(F.col("key").alias("_key")), base[f"`{self.key}`"].eqNullSafe(F.col("_key")), "left_anti")
        return kept.unionByName(newest.where("last.change <> 'removed'").select("last.row.*"))

    def compact(self) -> None:
        """Writes the newest version as a base without changes."""
        state = self.state()
        if state is not None and state["changes"]:
            n = self._write(self.read(), path := self._new("base"))
            self._record(state["number"] + 1, state["version"], path, [], n, 0, state["kind"])

    def _new(self, what: str) -> str:
        return f"{what}-{uuid.uuid4().hex}"

    def _write(self, chunks: DataFrame, path: str) -> int:
        chunks.write.parquet(f"{self.folder}/{path}")
        return self.spark.read.schema(chunks.schema).parquet(f"{self.folder}/{path}").count()

    def _changes(self, paths: Sequence[str], state: Row) -> DataFrame:
        """The rows of change sets, with `at`, which of them."""
        row = StructType.fromJson(json.loads(state["kind"]))
        kind = StructType().add("key", row[self.key].dataType).add("change", "string").add("row", row)
        return reduce(DataFrame.unionByName, (self.spark.read.schema(kind).parquet(f"{self.folder}/{p}").withColumn("at", F.lit(i)) for i, p in enumerate(paths)))

    def _record(self, *values: object) -> None:
        self.spark.createDataFrame([values], STATE).coalesce(1).write.mode("append").parquet(f"{self.folder}/state")
