"""Frames that are written to the shared folder and read again, where a plan would be repeated many times."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors and the driver share. Only a local master, which has no
    other machines, may go without one and gets a folder below the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return root or f"{spark.conf.get('spark.sql.warehouse.dir')}/shared"


@cache
def _scratch(application: str) -> str:
    """This application's folder below the shared root; it goes when the driver ends."""
    spark = SparkSession.active()
    path = f"{shared_root(spark)}/scratch-{application}"
    fs, own = store_of(spark, path)
    fs.mkdirs(own)
    fs.deleteOnExit(own)
    return path


def store_of(spark: SparkSession, path: str):
    """The file system that holds a path, and the path, as Hadoop has them."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), own


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name for what is written and read again, which all executors and the driver share."""
    return f"{_scratch(spark.sparkContext.applicationId)}/{uuid.uuid4().hex}"


def sweep(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that scratch_folder() named, or anything else below the shared root."""
    fs, own = store_of(spark, folder)
    fs.delete(own, True)


def cut(frame: DataFrame) -> DataFrame:
    """The frame's rows, written as Parquet to a folder of the application and read again. (A checkpointed frame keeps what
    the planner knows of its columns, which grows with each round of a loop, and its files outlive the driver.)"""
    path = scratch_folder(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


def numbered(frame: DataFrame, by: Sequence[str | Column], name: str) -> DataFrame:
    """The frame with a column that counts its rows from 0 in an order. Sorting is distributed: only the number of rows of
    each sorted part, one row a part, meets in one task."""
    held = cut(frame.orderBy(*by).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")))
    parts = held.groupBy("_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return held.join(F.broadcast(parts), "_part").withColumn(name, F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift")
