"""Cleans, mixes and tokenizes a corpus, stage by stage.

A stage takes (spark, docs, sf_dir) and returns the next stage's docs; all but the last return the columns of
`documents`. Between stages the rows are written as Parquet to the shared folder and read again, so a lost executor costs
part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topograph.llm import bpe, jaccard, mixing, substrings, toxicity
from topograph.llm.storage import shared_folder
from topograph.workers import reach


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't hold to be toxic."""
    labels = toxicity.labelled(reach(spark).read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject(docs, toxicity.train(docs, labels))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word-shingle similarity 0.8 or more."""
    reach(spark)
    return jaccard.keep_one(docs)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that start earlier; documents that lose all their words go."""
    reach(spark)
    return substrings.clean(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and those of small sources again, up to the repetition limit."""
    return mixing.mix(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the SHA-256 of the text decoded from them."""
    reach(spark)
    return bpe.encode(docs, decoded=True).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("bytes", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard", keep_one_of_near_duplicates),
    ("substring_dedup", remove_repeated_passages),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Learned and hashed stages have no SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = reach(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = shared_folder(spark)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
