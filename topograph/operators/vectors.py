"""Vectors of texts, each embedded once.

Rows ask by text. Texts are told apart by their SHA-256, so rows of one text are one question; those whose vector is
stored are joined with it, and only the others reach the embedding function, in batches spread over the cluster. A batch's
vectors are one folder that counts once it is whole, so a call that fails stores nothing and a repeated one asks again.
(Spark may repeat a task that is lost, and with it the calls of that task.)

A null text has no vector and is no question; an empty one is. Where the function gives null, the row's vector is null and
the text is asked again next time. A column of the vector's name is replaced, all others are kept. Two writers at one time
may store a text twice; the smaller vector counts then.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from topograph.lineage import cut, store_of
from topograph.workers import reach

STORED = "text_key string, vector array<float>"


class Vectors:
    """The vectors of one model below a folder that all executors see. embed takes a batch of texts."""

    def __init__(self, spark: SparkSession, folder: str, embed: Callable[[pd.Series], pd.Series], model: str):
        self.spark, self.embed = reach(spark), embed
        self.path = f"{folder}/vectors-{hashlib.sha256(model.encode()).hexdigest()[:16]}"

    def stored(self) -> DataFrame:
        """text_key and vector of all whole batches."""
        fs, own = store_of(self.spark, self.path)
        folders = [s.getPath() for s in fs.listStatus(own)] if fs.exists(own) else []
        whole = [p.toString() for p in folders if fs.exists(store_of(self.spark, f"{p.toString()}/_SUCCESS")[1])]
        return self.spark.read.schema(STORED).parquet(*whole).where("vector is not null") if whole else self.spark.createDataFrame([], STORED)

    def of(self, rows: DataFrame, text: str = "message", into: str = "vector") -> DataFrame:
        """Rows with the vector of their text. The vectors that are missing are made now."""
        asked = rows.drop(into).withColumn("_text_key", F.sha2(F.col(text), 256))
        known = asked.where("_text_key is not null")
        stored = self.stored().select(F.col("text_key").alias("_text_key"))
        wanted = cut(known.select("_text_key").distinct())
        missing = cut(wanted.join(stored, "_text_key", "left_anti"))
        if missing.head(1):
            # only keys were shuffled until here; texts are once, and not at all if none is missing
            texts = known.groupBy("_text_key").agg(F.any_value(text).alias("_text")).join(missing, "_text_key", "left_semi")
            made = F.pandas_udf(self.embed, ArrayType(FloatType()))(F.col("_text"))
            # a filter on the vector here would be a second call of the function
            texts.select(F.col("_text_key").alias("text_key"), made.alias("vector")).write.parquet(f"{self.path}/{uuid.uuid4().hex}")
        found = self.stored().withColumnRenamed("text_key", "_text_key").join(wanted, "_text_key", "left_semi")
        return asked.join(found.groupBy("_text_key").agg(F.min("vector").alias(into)), "_text_key", "left").drop("_text_key")

    def compact(self) -> None:
        """One batch in place of all whole ones, for stores that took very many small ones. Nobody else may write."""
        fs, own = store_of(self.spark, self.path)
        old = list(fs.listStatus(own)) if fs.exists(own) else []
        if len(old) > 1:
            self.stored().groupBy("text_key").agg(F.min("vector").alias("vector")).write.parquet(f"{self.path}/{uuid.uuid4().hex}")
            for s in old:
                fs.delete(s.getPath(), True)
