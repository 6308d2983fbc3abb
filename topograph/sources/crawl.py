"""Crawling a folder into a documents frame.

Crawler lists a folder (see sources.listing), and reads, hashes and turns its files into text once, all on the
executors. (Spark's binaryFile source leaves out empty files and names with an underscore, so it isn't used for that.)
documents_of() applies the same rules to a frame of files with their content, as binary_files() reads it from any store
that Spark reads, listed and read by Spark.
"""

from __future__ import annotations

import hashlib
import json
import warnings
from collections.abc import Callable, Iterable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topograph.errors import MissingDependency, UnsupportedFileType
from topograph.functions import identity
from topograph.functions import text as T
from topograph.lineage import cut, store_of
from topograph.sources.extract import Registry
from topograph.sources.listing import BESIDE, CYCLE, FILE, SIDECAR, UNREADABLE, content, listing, remote
from topograph.workers import reach

#: Of each kind of problem, so many are told as warnings; issues() has all.
TOLD = 20
LISTED = "relative_path string, local_path string, extension string, size_bytes bigint, last_modified timestamp"


def check_level_names(names: Sequence[str]) -> list[str]:
    if any(not isinstance(n, str) or not n for n in names):
        raise ValueError("level names are strings that aren't empty")
    if len(set(names)) < len(names):
        raise ValueError("level names are unique")
    return list(names)


def infer_levels(root: str | Path, skip_hidden: bool = True, spark: SparkSession | None = None) -> list[str]:
    """level_0, ... for the most folders that any file is below, whatever its extension; links aren't followed."""
    spark = spark or SparkSession.builder.getOrCreate()
    return [f"level_{i}" for i in range(listing(spark, str(root), False, skip_hidden).where(F.col("kind") == FILE).agg(depth_of(None, skip_hidden)).first()[0])]


#: What is known of a file once it has been read.
SEEN = {"checksum": pa.string(), "text_sample": pa.string(), "has_text": pa.bool_(), "problem": pa.string()}
ROWS = 256


def _seen(registry: Registry, sample: int, extension: str, data: bytes) -> tuple:
    problem = None
    try:
        text = registry.get(extension)(data)
    except MissingDependency:
        raise
    except Exception as e:  # the document stays, without text
        text, problem = "", f"{type(e).__name__}: {e}"
    return hashlib.sha256(data).hexdigest(), text[:sample], bool(text.strip()), problem


def _read(registry: Registry, sample: int, stored: bool = False) -> Callable:
    """Adds SEEN to rows of files, whose content is a column or, if they are `stored`, is read from local_path."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part, new = b.slice(lo, ROWS), []
                for k in range(part.num_rows):
                    if stored:
                        data = content(part.column("local_path")[k].as_py())
                    else:
                        data = part.column("content")[k].as_py() or b""
                    new.append(_seen(registry, sample, part.column("extension")[k].as_py(), data))
                kept = [n for n in part.schema.names if n != "content"]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), *(pa.array([x[c] for x in new], kind) for c, kind in enumerate(SEEN.values()))], [*kept, *SEEN])

    return run


def extension_of(path: Column) -> Column:
    """The last suffix in lower case; a name that only begins with a dot, or ends with one, has none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def hidden(path: Column) -> Column:
    """Whether the name of the file or of any folder begins with a dot."""
    return F.exists(identity.path_parts(path), lambda p: p.startswith("."))


def depth_of(files: DataFrame, skip_hidden: bool = True) -> Column:
    """Aggregate: the most folders that any file of `files`(relative_path) is below, whatever its extension."""
    path = F.col("relative_path")
    counts = ~path.rlike(f"(^|/){SIDECAR}$") & (~hidden(path) if skip_hidden else F.lit(True))
    return F.coalesce(F.max(F.when(counts, F.size(identity.path_parts(path)) - 1)), F.lit(0))


def binary_files(spark: SparkSession, root: str) -> DataFrame:
    """relative_path, local_path, size_bytes, last_modified and content of the files below a folder in any store."""
    files = reach(spark).read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    fs, own = store_of(spark, root)
    base = fs.makeQualified(own).toString().rstrip("/") + "/"
    return files.select(F.substring(F.col("path"), len(base) + 1, 1 << 30).alias("relative_path"), F.col("path").alias("local_path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("last_modified"), "content")


def unknown_extensions(files: DataFrame, registry: Registry | None = None, skip_hidden: bool = True) -> DataFrame:
    """extension and n: the files that documents_of() passes by for want of an extractor."""
    path = F.col("relative_path")
    rows = files.where(~path.rlike(f"(^|/){SIDECAR}$") & (~hidden(path) if skip_hidden else F.lit(True))).withColumn("extension", extension_of(path))
    return rows.where(~F.col("extension").isin((registry or Registry()).supported_extensions())).groupBy("extension").agg(F.count("*").alias("n"))


def sidecar_aliases(files: DataFrame) -> DataFrame:
    """folder, filename and own (aliases that aren't blank) from the sidecars among files(relative_path, content). A
    sidecar that isn't a JSON object has none, nor has a name whose value isn't a list."""
    side = files.where(F.col("relative_path").rlike(f"(^|/){SIDECAR}$"))
    held = side.select(folder_of(F.col("relative_path")).alias("folder"), F.explode(F.from_json(F.col("content").cast("string"), "map<string,string>")).alias("filename", "_list"))
    listed = held.where(F.col("_list").startswith("[")).withColumn("own", F.from_json("_list", "array<string>"))
    return listed.select("folder", "filename", F.filter("own", lambda a: a.isNotNull() & (T.strip(a) != "")).alias("own"))


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def documents_of(files: DataFrame, level_names: Sequence[str], *, registry: Registry | None = None, hierarchy: Callable[[Column, int], Column] | None = None, text_sample_chars: int = 1000, require_text: bool = False, strict_unknown_extensions: bool = False, skip_hidden: bool = True) -> DataFrame:
    """The documents frame, in no order, of files(relative_path, local_path, size_bytes, last_modified, content)."""
    names, registry, path = check_level_names(level_names), registry or Registry(), F.col("relative_path")
    if strict_unknown_extensions and (bad := unknown_extensions(files, registry, skip_hidden).first()):
        raise UnsupportedFileType(f"no extractor for {bad['extension']!r}")
    registry.check({r[0] for r in files.select(extension_of(path)).distinct().where(extension_of(path).isin(registry.supported_extensions())).collect()} if set(registry._needs) & set(registry.supported_extensions()) else set())
    rows = files.where(~hidden(path)) if skip_hidden else files
    routed = rows.where(~path.rlike(f"(^|/){SIDECAR}$")).withColumn("extension", extension_of(path)).where(F.col("extension").isin(registry.supported_extensions()))
    kind = f"{LISTED}, checksum string, text_sample string, has_text boolean, problem string"
    read = routed.select(*(c.split()[0] for c in LISTED.split(", ")), F.col("content").cast("binary").alias("content")).mapInArrow(_read(registry, max(0, int(text_sample_chars))), kind)
    return _assembled(read.where("has_text") if require_text else read, sidecar_aliases(rows), names, hierarchy)


def _assembled(read: DataFrame, own: DataFrame, level_names: Sequence[str], hierarchy: Callable[[Column, int], Column] | None) -> DataFrame:
    path, depth = F.col("relative_path"), len(level_names)
    read = read.withColumns({"filename": F.element_at(identity.path_parts(path), -1), "folder": folder_of(path)})
    names = F.array(*map(F.lit, level_names)) if depth else F.array().cast("array<string>")
    out = read.join(own, ["folder", "filename"], "left").withColumn("_levels", (hierarchy or identity.path_levels)(path, depth))
    return out.select(
        identity.doc_id(path).alias("doc_id"), "filename", "relative_path", "local_path", F.map_from_arrays(names, "_levels").alias("levels"),
        (F.array().cast("array<string>") if hierarchy else identity.extra_path(path, depth)).alias("extra_path"),
        "checksum", "size_bytes", "last_modified", T.aliases(F.col("filename"), F.col("_levels"), F.col("own")).alias("aliases"), "text_sample", "extension", "problem",
    )


def _sidecars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """folder, filename and own of the sidecars' names; a sidecar that isn't JSON is a row with `problem` instead."""
    kinds = {"folder": pa.string(), "filename": pa.string(), "own": pa.list_(pa.string()), "path": pa.string(), "problem": pa.string()}
    for b in batches:
        rows: list[tuple] = []
        for folder, path in zip(b.column("folder").to_pylist(), b.column("path").to_pylist(), strict=True):
            try:
                held = json.loads(content(path).decode("utf-8"))
            except (ValueError, OSError) as e:
                rows.append((folder, None, None, path, f"{type(e).__name__}: {e}"))
                continue
            for name, names in held.items() if isinstance(held, dict) else ():
                if isinstance(names, list):
                    rows.append((folder, str(name), [str(a) for a in names if str(a).strip()], path, None))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], [*kinds])


class Crawler:
    """A crawl of one folder. hierarchy: a Column of level values (array) from the relative path, instead of folders;
    documents then have no extra path."""

    def __init__(self, root: str | Path, level_names: Sequence[str] | None = None, *, registry: Registry | None = None, hierarchy: Callable[[Column, int], Column] | None = None, text_sample_chars: int = 1000, follow_symlinks: bool = False, require_text: bool = False, strict_unknown_extensions: bool = False, skip_hidden: bool = True):
        self.root = str(root) if remote(str(root)) else str(Path(str(root).removeprefix("file://")).resolve())
        if not remote(self.root) and not Path(self.root).exists():
            raise FileNotFoundError(self.root)
        if not remote(self.root) and not Path(self.root).is_dir():
            raise NotADirectoryError(self.root)
        if level_names is None:
            level_names = infer_levels(self.root, skip_hidden)
            if level_names:
                warnings.warn(f"levels are named {level_names}; give names that mean something", stacklevel=2)
        self.level_names = check_level_names(level_names)
        self.registry, self.hierarchy = registry or Registry(), hierarchy
        self.text_sample_chars = max(0, int(text_sample_chars))
        self.follow_symlinks, self.require_text, self.skip_hidden = follow_symlinks, require_text, skip_hidden
        self.strict_unknown_extensions = strict_unknown_extensions
        self._held: tuple[DataFrame, DataFrame] | None = None

    def _found(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """The listing with extensions, and what the sidecars say; both are made once."""
        if self._held is None:
            found = listing(spark, self.root, self.follow_symlinks, self.skip_hidden).withColumn("extension", extension_of(F.col("relative_path")))
            sides = found.where(F.col("kind") == BESIDE).select(folder_of(F.col("relative_path")).alias("folder"), "path")
            self._held = found, cut(sides.mapInArrow(_sidecars, "folder string, filename string, own array<string>, path string, problem string"))
        return self._held

    def issues(self, spark: SparkSession) -> DataFrame:
        """kind, path and detail of what a crawl passes by: folders, links and sidecars with problems, and files without an
        extractor."""
        found, sides = self._found(spark)
        rows = found.where(F.col("kind").isin(UNREADABLE, CYCLE)).select("kind", "path", F.col("problem").alias("detail"))
        rows = rows.unionByName(sides.where("problem is not null").select(F.lit("bad sidecar").alias("kind"), "path", F.col("problem").alias("detail")))
        unknown = found.where((F.col("kind") == FILE) & ~F.col("extension").isin(self.registry.supported_extensions()))
        return rows.unionByName(unknown.select(F.lit("no extractor").alias("kind"), "path", F.col("extension").alias("detail")))

    def _tell(self, spark: SparkSession) -> None:
        """The first issues as warnings; of files without an extractor, the extensions and how many there are."""
        issues, lone = self.issues(spark), F.col("kind") == "no extractor"
        for r in issues.where(~lone).orderBy("path").limit(TOLD).collect():
            warnings.warn(f"{r['kind']}: {r['path']}: {r['detail']}", stacklevel=3)
        for r in issues.where(lone).groupBy("detail").agg(F.count("*").alias("n"), F.min("path").alias("path")).orderBy(F.desc("n"), "detail").limit(TOLD).collect():
            if self.strict_unknown_extensions:
                raise UnsupportedFileType(f"no extractor for {r['detail']!r}: {r['path']}")
            warnings.warn(f"{r['n']} files with {r['detail']!r} are passed by: no extractor", stacklevel=3)

    def documents(self, spark: SparkSession) -> DataFrame:
        """One row a file, sorted by path: the documents frame, with `problem` where an extractor failed."""
        reach(spark)
        found, sides = self._found(spark)
        self._tell(spark)
        files = found.where((F.col("kind") == FILE) & F.col("extension").isin(self.registry.supported_extensions()))
        self.registry.check({r[0] for r in files.select("extension").distinct().collect()})  # no more than the registry has
        listed = files.select("relative_path", F.col("path").alias("local_path"), "extension", "size_bytes", "last_modified").repartition(4 * spark.sparkContext.defaultParallelism, "relative_path")
        read = listed.mapInArrow(_read(self.registry, self.text_sample_chars, True), f"{LISTED}, checksum string, text_sample string, has_text boolean, problem string")
        if self.require_text:
            read = read.where("has_text")
        return _assembled(read, sides.where("problem is null").select("folder", "filename", "own"), self.level_names, self.hierarchy).orderBy("relative_path")
