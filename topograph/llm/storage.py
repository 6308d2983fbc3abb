"""Where operators write what they read again, and into how many parts they deal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topograph.lineage import cut, scratch_folder


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir, which all executors and the driver share; it goes with the driver."""
    return scratch_folder(spark)


def stored(frame: DataFrame) -> DataFrame:
    """The frame's rows, written as Parquet and read again."""
    return cut(frame)


def parts_for(docs: DataFrame, part_bytes: int, column: str = "text", finer: int = 1) -> int:
    """Parts to deal the texts' words to: one for part_bytes bytes of text, and at least `finer` for each shuffle
    partition, so that what a part holds in memory doesn't grow with the input."""
    size = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(finer * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))
