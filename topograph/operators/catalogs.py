"""Catalogs by version, kept up by change sets instead of made again from all documents.

A catalog is counted: how many documents have a tuple of level values, say a term, or say a term and have a value at a
level. A change set lowers the counts of the rows that go and raises those of the rows that come, so a new version reads
the documents that differ and, of the terms that these say, the counts. What is made from counts (the first documents of a
term, the lowest and highest value it goes with) is taken over for all other terms.

The counts of terms are a base and the changes since it, which are added up when they are read and become a new base at a
quarter of it. The state row is written last, so a version that is interrupted isn't there, and can be repeated. Files of
earlier versions stay, as engines may hold them. One writer at a time.

Every document has a relative_path of its own: one that is null or repeated raises. Levels may be null, blank or missing;
columns of other names are left alone. An empty version has an empty catalog.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from functools import reduce
from weakref import WeakValueDictionary

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from topograph.errors import StoreConfigurationError
from topograph.lineage import cut, store_of
from topograph.operators import corpus
from topograph.operators.changes import COMPACT_AT, change_set, demand_keys
from topograph.operators.resolve import Catalog, leading, marks, spanning

KEY = "relative_path"
STATE = "number long, version string, documents long, levels array<string>, base string, changes array<string>, made string, counted long, changed long"
#: What is counted, with the columns that tell its rows apart.
TERMS, MARKS, TUPLES = ("terms", ("term", "name", KEY)), ("marks", ("term", "level", "value")), ("tuples", ("tuple",))
#: Catalogs that engines of this driver hold, by application, folder, version and number of documents.
_HELD: WeakValueDictionary[tuple, Catalog] = WeakValueDictionary()


def _added(frames: Iterable[DataFrame], by: Sequence[str]) -> DataFrame:
    """Counts of the same rows in one; those that come to nothing go."""
    return reduce(DataFrame.unionByName, frames).groupBy(*by).agg(F.sum("n").alias("n")).where("n <> 0")


def _named(documents: DataFrame) -> DataFrame:
    """What a catalog is made of."""
    return documents.select(*(c for c in (KEY, "filename", "display_name", "levels", "aliases") if c in documents.columns))


def _counts(documents: DataFrame, levels: Sequence[str], each: int) -> dict[str, DataFrame]:
    rows = {"terms": corpus.alias_terms(documents), "marks": marks(documents, levels), "tuples": documents.select(corpus.level_array(levels).alias("tuple"))}
    return {what: f.withColumn("n", F.lit(each).cast("long")) for what, f in rows.items()}


class Catalogs:
    """The catalogs of a corpus in a folder."""

    def __init__(self, spark: SparkSession, folder: str, levels: Sequence[str]):
        self.spark, self.folder, self.levels = spark, folder, list(levels)

    def state(self, version: str | None = None) -> Row | None:
        """The state row of a version (of the newest, without one), None if it isn't there."""
        fs, path = store_of(self.spark, f"{self.folder}/state")
        if not fs.exists(path):
            return None
        rows = self.spark.read.schema(STATE).parquet(f"{self.folder}/state")
        row = (rows if version is None else rows.where(F.col("version") == version)).orderBy(F.desc("number")).first()
        if row is not None and row["levels"] != self.levels:
            raise StoreConfigurationError(f"{self.folder} has the levels {row['levels']}")
        return row

    def build(self, documents: DataFrame, version: str) -> None:
        """Makes a version's catalog from all its documents."""
        documents = cut(_named(documents))  # what makes them is run once, not once for each table
        demand_keys(documents, KEY)
        documents = corpus.spread(documents)
        base, made = self._new("base"), self._new("made")
        counts = _counts(documents, self.levels, 1)
        for what, by in (TERMS, MARKS):
            self._write(_added([counts[what]], by), f"{base}/{what}")
        self._write(_added([counts["tuples"]], TUPLES[1]), f"{made}/tuples")
        self._write(leading(self._read(f"{base}/terms").drop("n")), f"{made}/leads")
        self._write(spanning(self._read(f"{base}/marks")), f"{made}/spans")
        self._record(version, base, [], made, self._read(f"{base}/terms").count(), 0)

    def advance(self, old: DataFrame, new: DataFrame, version: str) -> bool:
        """Makes new's catalog of that of old, which are the documents of the newest version. False if it is there
        already. A catalog that isn't old's raises where a count would fall below nothing."""
        state = self.state()
        if state is not None and state["version"] == version:
            return False
        if state is None:
            self.build(new, version)
            return True
        demand_keys(new, KEY)
        differ = cut(change_set(old, new, KEY))
        gone = cut(_named(old).join(differ.where("change <> 'added'").select(F.col("key").alias(KEY)), KEY, "left_semi"))
        come = _named(differ.where("change <> 'removed'").select("row.*"))
        lowered, raised = _counts(corpus.spread(gone), self.levels, -1), _counts(corpus.spread(come), self.levels, 1)
        path, made = self._new("changes"), self._new("made")
        for what, by in (TERMS, MARKS, TUPLES):
            self._write(_added([lowered[what], raised[what]], by), f"{path}/{what}")

        tuples = _added([self._read(f"{state['made']}/tuples"), self._read(f"{path}/tuples")], TUPLES[1])
        self._write(tuples, f"{made}/tuples")
        if self._read(f"{made}/tuples").where("n < 0").head(1):
            raise StoreConfigurationError(f"the catalog of {state['version']!r} isn't that of the old documents")
        paths = [state["base"], *state["changes"], path]
        touched = cut(self._read(f"{path}/terms").select("term").unionByName(self._read(f"{path}/marks").select("term")).distinct())
        for name, (what, by), make in (("leads", TERMS, leading), ("spans", MARKS, spanning)):
            kept = self._read(f"{state['made']}/{name}").join(touched, "term", "left_anti")
            again = _added((self._read(f"{p}/{what}").join(touched, "term", "left_semi") for p in paths), by)
            self._write(kept.unionByName(make(again.drop("n"))), f"{made}/{name}")
        changed = state["changed"] + self._read(f"{path}/terms").count()
        self._record(version, state["base"], paths[1:], made, state["counted"], changed)
        if changed > COMPACT_AT * state["counted"]:
            self.compact()
        return True

    def compact(self) -> None:
        """Writes the newest version's counts as a base without changes."""
        state = self.state()
        if state is not None and state["changes"]:
            base = self._new("base")
            for what, by in (TERMS, MARKS):
                self._write(_added((self._read(f"{p}/{what}") for p in [state["base"], *state["changes"]]), by), f"{base}/{what}")
            self._record(state["version"], base, [], state["made"], self._read(f"{base}/terms").count(), 0)

    def catalog(self, version: str | None = None) -> Catalog:
        """A version's catalog (the newest, without one): one object for all engines of this driver that hold it."""
        state = self.state(version)
        if state is None:
            raise StoreConfigurationError(f"{self.folder} has no version {version or ''}")
        key = (self.spark.sparkContext.applicationId, self.folder, state["version"], state["documents"], state["made"])
        if (held := _HELD.get(key)) is None:
            names = F.array(*map(F.lit, self.levels)) if self.levels else F.array().cast("array<string>")
            shapes = self._read(f"{state['made']}/tuples").select(F.map_from_arrays(names, F.col("tuple")).alias("levels"))
            leads, spans = (self._read(f"{state['made']}/{name}") for name in ("leads", "spans"))
            held = _HELD[key] = Catalog.made(shapes, leads, leads, spans, self.levels)
        return held

    def _new(self, what: str) -> str:
        return f"{what}-{uuid.uuid4().hex}"

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{path}")

    def _write(self, frame: DataFrame, path: str) -> None:
        frame.write.parquet(f"{self.folder}/{path}")

    def _record(self, version: str, base: str, changes: Sequence[str], made: str, counted: int, changed: int) -> None:
        documents = self._read(f"{made}/tuples").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        before = self.state()
        row = (before["number"] + 1 if before is not None else 0, version, documents, self.levels, base, list(changes), made, counted, changed)
        self.spark.createDataFrame([row], STATE).coalesce(1).write.mode("append").parquet(f"{self.folder}/state")
