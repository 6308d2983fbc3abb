"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed character 1- to 3-grams of lower-cased text by language; each partition sends one
block of counts per language and bucket range, so what is shuffled depends on partitions, not on text. The
log-probability matrix (buckets x languages, at most `max_languages` columns) is broadcast, and texts are
scored in batches: the n-grams of a batch are the non-zeros of a sparse matrix that is multiplied with it.

Null text, or text without a letter: `und` with score 0. No training row at all: `und` for every text.
Extra columns are ignored, repeated rows are counted and predicted each, ties go to the smaller language.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topograph.llm.words import CHUNK, mix
from topograph.workers import thrifty, thrifty_group

BUCKETS = 1 << 15
BLOCK = 1 << 12
ORDERS = (1, 2, 3)
UNKNOWN = "und"


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each text, laid end to end, and their offsets by text."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    ends = np.cumsum([len(t) for t in lowered], dtype=np.int64)
    left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(points))  # characters from here to the end of the text
    keys = np.zeros(len(points), np.uint64)
    out, where = [], []
    for n in range(1, max(ORDERS) + 1):
        keys[: len(points) - n + 1] = keys[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :]
        if n in ORDERS:
            at = np.flatnonzero(left >= n)
            out.append((mix(keys[at] * np.uint64(4) + np.uint64(n)) >> np.uint64(49)).astype(np.int32))
            where.append(at)
    begin = ends - np.diff(ends, prepend=0)
    counts = sum(np.searchsorted(w, ends) - np.searchsorted(w, begin) for w in where)
    flat = np.empty(int(counts.sum()), np.int32)
    base = np.concatenate([[0], np.cumsum(counts)])
    done = base[:-1].copy()
    for values, w in zip(out, where, strict=True):  # each text keeps its n-grams of all orders together
        per = np.searchsorted(w, ends) - np.searchsorted(w, begin)
        flat[np.repeat(done - np.concatenate([[0], np.cumsum(per)[:-1]]), per) + np.arange(len(values))] = values
        done += per
    return flat, base


def parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Row ranges of about CHUNK characters."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > CHUNK:
            yield lo, i
            lo, size = i, 0
        size += len(t or "")
    if lo < len(texts):
        yield lo, len(texts)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for b in batches:
        langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
        for lo, hi in parts(texts):
            for lang in set(langs[lo:hi]):
                flat, _ = grams([t for t, x in zip(texts[lo:hi], langs[lo:hi], strict=True) if x == lang])
                held[lang] = held.get(lang, 0) + np.bincount(flat, minlength=BUCKETS)
    for lang, counts in held.items():
        for k in range(0, BUCKETS, BLOCK):
            if counts[k : k + BLOCK].any():
                yield pa.RecordBatch.from_pydict({"lang": [lang], "block": pa.array([k], pa.int32()), "counts": [counts[k : k + BLOCK].astype(np.int64).tobytes()]})


def _add(table: pa.Table) -> pa.Table:
    total = np.zeros(BLOCK, np.int64)
    for x in table.column("counts"):
        total += np.frombuffer(x.as_py(), np.int64)
    return pa.table({"lang": [table.column("lang")[0].as_py()], "block": pa.array([table.column("block")[0].as_py()], pa.int32()), "counts": [total.tobytes()]})


def train(labelled: DataFrame, max_languages: int = 500, smoothing: float = 0.1) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities [bucket, language] from the columns text and lang; null in either: unused.

    The priors are uniform: a language that is rare in the corpus isn't held to be unlikely.
    """
    kind = "lang string, block int, counts binary"
    rows = labelled.select("lang", "text").where("lang is not null and text is not null").mapInArrow(thrifty(_count), kind)
    spread = F.pmod(F.spark_partition_id(), F.lit(64))
    rows = rows.groupBy("lang", "block", spread.alias("salt")).applyInArrow(thrifty_group(_add), kind).groupBy("lang", "block").applyInArrow(thrifty_group(_add), kind)
    counts: dict[str, np.ndarray] = {}
    for r in rows.toLocalIterator():
        counts.setdefault(r.lang, np.zeros(BUCKETS))[r.block : r.block + BLOCK] = np.frombuffer(r.counts, np.int64)
        if len(counts) > max_languages:
            raise ValueError(f"more than {max_languages} languages")
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((BUCKETS, 0), np.float32)
    table = np.stack([counts[x] for x in langs], 1) + smoothing
    return langs, np.log(table / table.sum(0)).astype(np.float32)


def score(texts: list[str | None], langs: list[str], logs: np.ndarray) -> tuple[list[str], np.ndarray]:
    names, sure = [UNKNOWN] * len(texts), np.zeros(len(texts))
    keep = [i for i, t in enumerate(texts) if t and langs and any(map(str.isalpha, t))]
    kept = [texts[i] for i in keep]
    for lo, hi in parts(kept):
        flat, base = grams(kept[lo:hi])
        sums = np.stack([np.add.reduceat(logs[:, k][flat], base[:-1], dtype=np.float64) for k in range(len(langs))], 1)
        best = sums.argmax(1)
        part = np.exp(sums - sums.max(1, keepdims=True))
        for i, k, p in zip(keep[lo:hi], best, 1 / part.sum(1), strict=True):
            names[i], sure[i] = langs[k], p
    return names, sure


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred and score (the winner's posterior, 0 to 1) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, sure = score(b.column("text").to_pylist(), *shared.value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(sure)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(thrifty(run), "doc_id bigint, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """Trains on the rows with a language whose crc32 of doc_id isn't `held` modulo `folds`, and predicts all."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    model = train(docs.where(fold != held).select("lang", "text"))
    return predict(docs, model).select("doc_id", F.coalesce(fold == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
