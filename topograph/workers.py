"""What Python workers need: to import this package, Arrow batches of a bounded size, and to give memory back."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
#: Bytes of an Arrow batch to a worker, unless a row is larger; Spark's own default takes much more memory on both sides.
BATCH_BYTES = 4 << 20
#: Workers' allocators: one for Arrow and numpy, few arenas, and large blocks that go back as soon as they are freed.
ALLOCATOR = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(32 << 20)}


def reach(spark: SparkSession) -> SparkSession:
    """Adds the folder of this package to the workers' path, and bounds their batches. Across hosts, ship the package
    with --py-files or install it."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join(x for x in [*paths, ROOT] if x)
    for k, v in ALLOCATOR.items():
        env.setdefault(k, v)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


@cache
def _libc() -> ctypes.CDLL | None:
    try:
        found = ctypes.CDLL("libc.so.6")
        found.malloc_trim  # noqa: B018
    except (OSError, AttributeError):
        return None
    return found


def trim() -> None:
    """Gives freed memory back: workers are kept between tasks, and so would be what they once used."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


def thrifty(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """For mapInArrow: gives memory back at the end of a partition."""

    def of_batches(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return of_batches


def thrifty_group(run: Callable[[pa.Table], pa.Table]) -> Callable:
    """For applyInArrow: gives memory back after a large group."""

    def of_table(table):
        out = run(table)
        if table.nbytes > 1 << 20:
            del table
            trim()
        return out

    return of_table


def thrifty_pair(run: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable:
    """For applyInArrow on cogroups."""

    def of_tables(left, right):
        out = run(left, right)
        if left.nbytes + right.nbytes > 1 << 20:
            del left, right
            trim()
        return out

    return of_tables
