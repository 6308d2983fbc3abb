"""Queries as a stream: each micro-batch is answered as one batch, and how often a conversation has been asked back is
counted with a watermark. An extension of ours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from topograph.engine import Engine


def answer(queries: DataFrame, engine: Engine, output: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends outcomes to a Parquet table, by batch: a batch that is run again replaces its own rows."""

    def batch(rows: DataFrame, number: int) -> None:
        engine.search(rows).drop("clarification").write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = queries.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if once else writer).start()


def asked_back(turns: DataFrame, late: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Clarifications by conversation and window, from turns(ts, conv_id, type); later turns than `late` are left out."""
    return turns.withWatermark("ts", late).where("type = 'clarification'").groupBy(F.window("ts", window), "conv_id").agg(F.count("*").alias("n"))
