"""Listing what is below a folder, as a job.

Each round lists the folders of one depth on the executors, in the local file system (a folder that all of them see) or
in any store that pyarrow.fs opens by its URI, and writes what it finds to the shared folder; its folders are the next
round's. So no name passes the driver, and a lost executor costs part of a round. A folder that can't be read, and a
link that leads back to a folder above it, is a row that says so.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from topograph.lineage import scratch_folder
from topograph.workers import reach

SIDECAR = "_aliases.json"
FOLDER, FILE, BESIDE, UNREADABLE, CYCLE = "folder", "file", "sidecar", "unreadable folder", "cycle"
FOUND = "kind string, relative_path string, path string, size_bytes bigint, last_modified timestamp, problem string"
FIELDS = {"kind": pa.string(), "relative_path": pa.string(), "path": pa.string(), "size_bytes": pa.int64(), "last_modified": pa.timestamp("us", "UTC"), "problem": pa.string()}
#: Rows of a batch, so that a folder of any size is passed on in pieces.
ROWS = 4096


def remote(path: str) -> bool:
    return "://" in path and not path.startswith("file://")


def content(path: str) -> bytes:
    """A file's bytes, from the local file system or by its URI."""
    if not remote(path):
        with open(path.removeprefix("file://"), "rb") as f:
            return f.read()
    store, own = fs.FileSystem.from_uri(path)
    with store.open_input_stream(own) as f:
        return f.read()


def _local(path: str, follow_symlinks: bool) -> Iterator[tuple]:
    """(kind, name, path, size, time, problem) of what a folder holds."""
    with os.scandir(path) as entries:
        for e in entries:
            if e.is_symlink() and not follow_symlinks:
                continue
            own = os.path.realpath(e.path) if e.is_symlink() else e.path
            if e.is_dir():
                back = e.is_symlink() and os.path.commonpath([os.path.realpath(path), own]) == own
                yield CYCLE if back else FOLDER, e.name, own, None, None, f"leads to {own}" if back else None
            elif e.is_file():
                stat = e.stat()
                yield FILE, e.name, own, stat.st_size, datetime.fromtimestamp(stat.st_mtime, timezone.utc), None


def _stored(path: str) -> Iterator[tuple]:
    store, own = fs.FileSystem.from_uri(path)
    for e in store.get_file_info(fs.FileSelector(own)):
        where = f"{path.rstrip('/')}/{e.base_name}"
        if e.type == fs.FileType.Directory:
            yield FOLDER, e.base_name, where, None, None, None
        elif e.type == fs.FileType.File:
            yield FILE, e.base_name, where, e.size, e.mtime, None


def entries(relative: str, path: str, follow_symlinks: bool, skip_hidden: bool) -> Iterator[tuple]:
    """Rows of one folder, as FIELDS has them."""
    try:
        for kind, name, *rest in _stored(path) if remote(path) else _local(path, follow_symlinks):
            if not (skip_hidden and name.startswith(".")):
                yield BESIDE if kind == FILE and name == SIDECAR else kind, f"{relative}/{name}" if relative else name, *rest
    except OSError as e:
        yield UNREADABLE, relative, path, None, None, f"{type(e).__name__}: {e}"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(FIELDS.values())], [*FIELDS])


def _listed(follow_symlinks: bool, skip_hidden: bool) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for relative, path in zip(b.column("relative_path").to_pylist(), b.column("path").to_pylist(), strict=True):
                held: list[tuple] = []
                for row in entries(relative, path, follow_symlinks, skip_hidden):
                    held.append(row)
                    if len(held) == ROWS:
                        yield _batch(held)
                        held = []
                yield _batch(held)

    return run


def listing(spark: SparkSession, root: str, follow_symlinks: bool = False, skip_hidden: bool = True) -> DataFrame:
    """FOUND of everything below a folder, in no order: files, sidecars, folders, and folders that aren't listed and why."""
    parts, out = 4 * reach(spark).sparkContext.defaultParallelism, scratch_folder(spark)
    frontier, depth = spark.createDataFrame([("", root.removeprefix("file://"))], "relative_path string, path string"), 0
    while True:
        frontier.mapInArrow(_listed(follow_symlinks, skip_hidden), FOUND).write.parquet(f"{out}/depth={depth}")
        frontier = spark.read.schema(FOUND).parquet(f"{out}/depth={depth}").where(f"kind = '{FOLDER}'").select("relative_path", "path")
        if frontier.isEmpty():
            return spark.read.schema(FOUND).parquet(out).drop("depth")
        frontier, depth = frontier.repartition(parts, "path"), depth + 1
