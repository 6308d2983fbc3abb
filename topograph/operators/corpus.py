"""Frames that are built from documents: level values, tree, ancestors, terms, manifest, checks, chunk stamps.

documents has doc_id, filename, relative_path, levels (map of level name to value), aliases, checksum and size_bytes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topograph.functions import text as T
from topograph.lineage import cut


#: Documents of one part where their terms are sorted: a file that packs well may have any number.
PART_ROWS = 100_000


def spread(documents: DataFrame) -> DataFrame:
    """The documents in parts of a bounded number of rows, so that no task sorts more of them the larger the corpus is."""
    parts = -(-documents.count() // PART_ROWS)
    return documents.repartition(parts, "relative_path") if parts > 1 else documents


def level_array(levels: Sequence[str], of: Column | None = None) -> Column:
    """Level values in order, from the map."""
    of = F.col("levels") if of is None else of
    return F.array(*(F.element_at(of, F.lit(n)) for n in levels)) if levels else F.array().cast("array<string>")


def level_values(documents: DataFrame, levels: Sequence[str]) -> DataFrame:
    """level (its number), value and pos (place among the level's sorted values); blank values are none."""
    rows = documents.select(F.posexplode(level_array(levels)).alias("level", "value")).where("value is not null and value <> ''").distinct()
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("level").orderBy("value")) - 1)


def _reach(levels: Column) -> Column:
    """Values up to the first missing level."""
    first = F.array_position(F.transform(levels, lambda v: v.isNull()), True)
    return F.when(first > 0, F.slice(levels, F.lit(1), first.cast("int") - 1)).otherwise(levels)


def tree_nodes(documents: DataFrame, levels: Sequence[str]) -> DataFrame:
    """path (array of values), depth and doc_count: documents attach where their first level is missing."""
    return documents.select(_reach(level_array(levels)).alias("path")).groupBy("path").agg(F.count("*").alias("doc_count")).withColumn("depth", F.size("path"))


def subtree_counts(documents: DataFrame, levels: Sequence[str]) -> DataFrame:
    """path, depth and doc_count of everything at or below each node."""
    nodes = tree_nodes(documents, levels).select("doc_count", F.explode(F.transform(F.sequence(F.lit(0), F.col("depth")), lambda d: F.slice("path", F.lit(1), d))).alias("path"))
    return nodes.groupBy("path").agg(F.sum("doc_count").alias("doc_count")).withColumn("depth", F.size("path"))


def level_tuples(documents: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Distinct arrays of level values."""
    return documents.select(level_array(levels).alias("tuple")).distinct()


def ancestors(documents: DataFrame, levels: Sequence[str]) -> DataFrame:
    """child_level, child_value, parent_level, parent_value over all pairs of levels of a document, not only neighbours."""
    pairs = [F.struct(F.lit(c).alias("child_level"), F.get("tuple", F.lit(c)).alias("child_value"), F.lit(p).alias("parent_level"), F.get("tuple", F.lit(p)).alias("parent_value")) for c in range(len(levels)) for p in range(c)]
    made = F.array(*pairs) if pairs else F.array().cast("array<struct<child_level:int,child_value:string,parent_level:int,parent_value:string>>")
    return level_tuples(documents, levels).select(F.explode(made).alias("a")).select("a.*").where("child_value <> '' and parent_value <> ''").distinct()


def single_ancestors(documents: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Ancestors of values that have just one at that level."""
    return ancestors(documents, levels).groupBy("child_level", "child_value", "parent_level").agg(F.count("*").alias("n"), F.min("parent_value").alias("parent_value")).where("n = 1").drop("n")


def alias_terms(documents: DataFrame, *more: Column) -> DataFrame:
    """relative_path, name and term (and more): each document's normalized aliases, file name and shown name."""
    shown = F.coalesce(T.given(F.col("display_name")), F.col("filename")) if "display_name" in documents.columns else F.col("filename")
    terms = F.transform(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array(F.col("filename"), shown)), T.normalize)
    return documents.select("relative_path", shown.alias("name"), *more, F.explode(F.array_distinct(terms)).alias("term")).where("term <> ''")


def manifest(documents: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Rows to stamp on chunks: metadata has the levels, doc_id and source_path, which win over levels of that name."""
    own = F.create_map(F.lit("doc_id"), F.col("doc_id"), F.lit("source_path"), F.col("relative_path"))
    names = F.array(*map(F.lit, levels)) if levels else F.array().cast("array<string>")
    kept = F.map_filter(F.map_from_arrays(names, level_array(levels)), lambda k, _: ~k.isin("doc_id", "source_path"))
    keep = [c for c in ("doc_id", "filename", "relative_path", "text_sample", "aliases", "checksum", "size_bytes") if c in documents.columns]
    return documents.select(*keep, F.map_concat(kept, own).alias("metadata"))


def find(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Point lookup by doc_id or relative_path; of rows that repeat it, the last in path order."""
    return rows.where(F.col(key) == value).orderBy(F.desc("relative_path")).limit(1)


def lookup(keys: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """find() for a batch: keys (with the column `key`) with the manifest row of each that has one."""
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != key)), "relative_path").alias("_row"))
    return keys.join(newest, key).select(*keys.columns, "_row.*")


def issues(rows: DataFrame, levels: Sequence[str], existing: DataFrame | None = None, complete: bool = False) -> DataFrame:
    """kind, subject and detail of what is wrong in a manifest: repeated doc_id or path (once for each further row), a
    level that metadata lacks, a null level (if `complete`), a path that `existing`(relative_path) doesn't have."""
    found = []
    for key in ("doc_id", "relative_path"):
        again = F.row_number().over(Window.partitionBy(key).orderBy("relative_path", "doc_id"))
        found.append(rows.withColumn("_n", again).where("_n > 1").select(F.lit(f"duplicate {key}").alias("kind"), F.col(key).alias("subject"), F.lit(None).cast("string").alias("detail")))
    if levels:
        each = rows.select("relative_path", "metadata", F.explode(F.array(*map(F.lit, levels))).alias("level"))
        there = F.map_contains_key("metadata", F.col("level"))
        found.append(each.where(~there).select(F.lit("missing level").alias("kind"), F.col("relative_path").alias("subject"), F.col("level").alias("detail")))
        if complete:
            empty = there & F.element_at("metadata", F.col("level")).isNull()
            found.append(each.where(empty).select(F.lit("null level").alias("kind"), F.col("relative_path").alias("subject"), F.col("level").alias("detail")))
    if existing is not None:
        gone = rows.join(existing.select("relative_path").distinct(), "relative_path", "left_anti")
        found.append(gone.select(F.lit("missing file").alias("kind"), F.col("relative_path").alias("subject"), F.lit(None).cast("string").alias("detail")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def stamp(chunks: DataFrame, rows: DataFrame, levels: Sequence[str], drop_null: bool = True) -> DataFrame:
    """Chunks with their document's metadata and filename, and a column for each level, for pushdown."""
    meta = F.map_concat("metadata", F.create_map(F.lit("text"), F.col("text"), F.lit("filename"), F.col("filename")))
    out = chunks.join(rows.select("doc_id", "filename", "metadata"), "doc_id").withColumn("metadata", T.known(meta) if drop_null else meta)
    return out.withColumns({n: F.element_at("metadata", F.lit(n)) for n in levels}) if levels else out


def upload_due(state: dict | None, version: str, store_exists: bool, force: bool = False) -> bool:
    """Whether chunks have to be written again: not if the recorded version is this one and the store is still there."""
    return force or not (state and store_exists and state.get("corpus_version") == version)


#: A digest is summed in pieces of 60 bits, which long decimals add up exactly.
PIECES = 4


def _joined(name: Column, *sums: Column) -> Column:
    return F.sha2(F.concat_ws(":", name, *(s.cast("string") for s in sums)), 256)


def digests(documents: DataFrame) -> DataFrame:
    """path, depth, files and digest of every folder ("" is the root) of documents(relative_path, checksum, size_bytes).

    A file's digest is the SHA-256 of its name, checksum and size; a folder's that of its name, how many it holds, and
    the sums of their digests' pieces. Sums don't depend on an order, so a folder of any size is added up by tasks before
    anything is shuffled, level by level from the deepest; the driver learns only how many levels there are.
    """
    path = F.col("relative_path")
    folder = F.regexp_replace(path, "/?[^/]*$", "")
    depth = F.when(folder == "", 0).otherwise(F.size(F.split(folder, "/")))
    files = cut(documents.select(folder.alias("path"), depth.alias("depth"), _joined(F.element_at(F.split(path, "/"), -1), F.col("checksum"), F.col("size_bytes")).alias("digest"), F.lit(1).cast("long").alias("files")))
    deepest = files.agg(F.max("depth")).first()[0] or 0
    found: list[DataFrame] = []
    below = files.limit(0).select("path", "digest", "files")
    for level in range(deepest, -1, -1):
        held = files.where(F.col("depth") == level).select("path", "digest", "files").unionByName(below)
        pieces = [F.sum(F.conv(F.substring("digest", 15 * i + 1, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(PIECES)]
        made = held.groupBy("path").agg(F.sum("files").alias("files"), F.count("*").alias("n"), *pieces)
        made = cut(made.select("path", F.lit(level).alias("depth"), "files", _joined(F.regexp_extract("path", "[^/]*$", 0), F.col("n"), *(F.col(f"s{i}") for i in range(PIECES))).alias("digest")))
        found.append(made)
        below = made.select(F.regexp_replace("path", "/?[^/]*$", "").alias("path"), "digest", "files")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def tree_version(documents: DataFrame) -> str:
    """A version from the root's digest: equal for equal trees of files, whatever the size of the corpus."""
    root = digests(documents).where("path = ''").first()
    return (root["digest"] if root else "").ljust(16, "0")[:16]


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, depth and change (added, removed, changed) of the folders of two digests() that differ."""
    a, b = old.select("path", "depth", F.col("digest").alias("_old")), new.select("path", "depth", F.col("digest").alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    return a.join(b, ["path", "depth"], "full").where(~F.col("_old").eqNullSafe(F.col("_new"))).select("path", "depth", change.alias("change"))
