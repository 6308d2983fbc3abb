"""Language-model scoring: stupid-backoff scores, computed relationally.

A text's score is the sum over its words of log S: S(w | h) = f(h w) / f(h) if the n-gram h w was seen, else
BACKOFF * S(w | a word less of h); with no word of h left it is f(w) / N, and a word that wasn't seen counts as seen once.

score_corpus() scores each row by the counts of all other rows: its own occurrences are taken off, so what only this row
says backs off, and what other rows say too, copies among them, doesn't. The relations are
1. exploded n-grams: a block of consecutive texts has its distinct n-grams and their counts, dealt by hash;
2. count tables by hash: a part adds up the counts of each n-gram over all blocks, and
3. sends the sums back to the blocks that hold the n-gram (the join), where each word's n-grams meet their counts by
   position, the text's own counts are taken off, and the logarithms are summed by text.
Rows of 1 and 3 hold a block's n-grams of one part as packed arrays in rising order, as a row for each n-gram would take
several times the disk. Nothing is cut off: counts are over whole texts and all of them. score() is for other texts: count
tables of any order as frames, joined level by level.

Parts grow in number with the bytes of the texts, so that a part has about as many n-grams at every size.

Null text is empty text; a text without words has no score (null) and logprob 0. Repeated rows are rows of their own,
also for each other; extra columns are ignored; an empty table gives no rows. Words are told apart by 64-bit hashes in
score_corpus().
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topograph.llm.packing import pack_numbers, pack_rising, unpack_numbers, unpack_rising
from topograph.llm.storage import parts_for, shared_folder
from topograph.llm.words import ngrams, split
from topograph.workers import thrifty, thrifty_group

BACKOFF = 0.4
ORDER = 2
BLOCK_WORDS = 1 << 20
#: Bytes of text for each part of the count tables.
PART_BYTES = 32 << 20


class Block:
    """Consecutive texts: words as numbers of sorted distinct hashes, and how many each text has."""

    def __init__(self, names: np.ndarray, numbers: np.ndarray, counts: np.ndarray, order: int):
        self.hashes, self.counts, self.order = names[numbers], counts, order
        self.offsets = np.concatenate([[0], np.cumsum(counts)])

    def grams(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Keys of all n-grams, those of one n after the other, and the place of the last word of each, by n."""
        keys, last = [], []
        for n in range(1, self.order + 1):
            key, first, _ = ngrams(self.hashes, self.offsets, n)
            keys.append(key ^ np.uint64(n * 0x5851F42D4C957F2D % (1 << 64)))
            last.append(first + n - 1)
        return np.concatenate(keys), last

    def logs(self, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each text's sum of logarithms without the terms of N, and how many words have one; counted: the count of
        each distinct n-gram in rising order of the keys."""
        keys, last = self.grams()
        text = np.repeat(np.arange(len(self.counts)), self.counts)
        _, at = np.unique(keys, return_inverse=True)
        pair = at * np.int64(max(1, len(self.counts))) + text[np.concatenate(last)]
        _, own_at, own = np.unique(pair, return_inverse=True, return_counts=True)
        others = counted[at] - own[own_at]  # of each n-gram, in other rows
        ends = np.cumsum([len(x) for x in last])
        seen = np.zeros((self.order, len(self.hashes)), np.int64)
        for n, x in enumerate(last):
            seen[n, x] = others[ends[n] - len(x) : ends[n]]
        inside = np.arange(len(self.hashes)) - self.offsets[text]
        longest = np.minimum(inside + 1, self.order)
        out, done = np.zeros(len(self.hashes)), np.zeros(len(self.hashes), bool)
        for n in range(self.order, 1, -1):
            use = np.flatnonzero(~done & (seen[n - 1] > 0))
            out[use] = np.log(seen[n - 1, use] / seen[n - 2, use - 1]) + (longest[use] - n) * np.log(BACKOFF)
            done[use] = True
        use = np.flatnonzero(~done)
        out[use] = np.log(np.maximum(seen[0, use], 1)) + (longest[use] - 1) * np.log(BACKOFF)
        m = len(self.counts)
        return np.bincount(text, out, m), np.bincount(text[use], minlength=m)


ROW = "part int, block bigint, keys binary, counts binary, doc_ids array<bigint>, names binary, numbers binary, words binary, parts int"


def _rows(doc_ids: list[int | None], counts: np.ndarray, hashes: np.ndarray, number: int, parts: int, order: int) -> Iterator[pa.RecordBatch]:
    names, numbers = np.unique(hashes, return_inverse=True)
    keys, seen = np.unique(Block(names, numbers, counts, order).grams()[0], return_counts=True)
    block = xxhash.xxh3_64_intdigest(hashes.tobytes() + counts.tobytes(), seed=(TaskContext.get().partitionId() << 32) + number)
    rank = np.empty(len(names), np.int64)
    often = np.argsort(-np.bincount(numbers, minlength=len(names)), kind="stable")
    rank[often] = np.arange(len(often))
    held = {"doc_ids": doc_ids, "names": pack_rising(names) + rank.astype(np.uint32).tobytes(), "numbers": pack_numbers(rank[numbers]), "words": pack_numbers(counts)}
    part = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    cuts = np.searchsorted(part, np.arange(parts + 1))
    used = np.flatnonzero(np.diff(cuts)).tolist() or [0]
    for p in used:
        mine = slice(cuts[p], cuts[p + 1])
        lead = held if p == used[block % len(used)] else {}
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([p], pa.int32()), "block": pa.array([np.uint64(block).astype(np.int64)], pa.int64()), "keys": pa.array([pack_rising(keys[mine])], pa.binary()), "counts": pa.array([pack_numbers(seen[mine])], pa.binary()),
            "doc_ids": pa.array([lead.get("doc_ids")], pa.list_(pa.int64())), **{k: pa.array([lead.get(k)], pa.binary()) for k in ("names", "numbers", "words")}, "parts": pa.array([len(used)], pa.int32()),
        })


def _explode(parts: int, order: int, block_words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        size = number = 0

        def block() -> Iterator[pa.RecordBatch]:
            return _rows([x for ids, _, _ in held for x in ids], *(np.concatenate([x[c] for x in held]) for c in (1, 2)), number, parts, order)

        for b in batches:
            for lo, hi, w in split(b.column("text")):
                held.append((b.column("doc_id").slice(lo, hi - lo).to_pylist(), np.diff(w.offsets), w.hashes()))
                size += len(held[-1][2])
                if size >= block_words:
                    yield from block()
                    held, size, number = [], 0, number + 1
        if held:
            yield from block()

    return run


def _count(table: pa.Table) -> pa.Table:
    """One part of the count tables: the count of each n-gram in all blocks, for each block's n-grams."""
    keys = [unpack_rising(x.as_py()) for x in table.column("keys")]
    sizes = [len(k) for k in keys]
    _, at = np.unique(np.concatenate(keys), return_inverse=True)
    del keys
    total = np.bincount(at, np.concatenate([unpack_numbers(x.as_py()) for x in table.column("counts")])).astype(np.int64)
    ends = np.cumsum(sizes)
    back = [_packed_counts(total[at[z - n : z]]) for n, z in zip(sizes, ends, strict=True)]
    return table.drop_columns(["keys", "counts"]).append_column("counted", pa.array(back, pa.binary()))


def _packed_counts(x: np.ndarray) -> bytes:
    """Counts of any size: pack_numbers for the low 28 bits and, only if there are any, for the others."""
    low = pack_numbers(x & (1 << 28) - 1)
    return len(low).to_bytes(4, "little") + low + (pack_numbers(x >> 28) if x.max(initial=0) >> 28 else b"")


def _unpacked_counts(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    low = unpack_numbers(data[4 : 4 + n]).astype(np.int64)
    return low + (unpack_numbers(data[4 + n :]).astype(np.int64) << 28) if len(data) > 4 + n else low


def _sum(order: int):
    def run(table: pa.Table) -> pa.Table:
        """One block's texts, by the counts that the parts sent."""
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        lead = [r for r in rows if r["doc_ids"] is not None]
        if len(lead) != 1 or len(rows) != rows[0]["parts"]:
            raise RuntimeError("the texts changed while they were scored; write them first")
        r = lead[0]
        numbers, counts = unpack_numbers(r["numbers"]).astype(np.int64), unpack_numbers(r["words"]).astype(np.int64)
        distinct = int(numbers.max(initial=-1)) + 1
        cut = len(r["names"]) - 4 * distinct
        names, rank = unpack_rising(r["names"][:cut]), np.frombuffer(r["names"][cut:], np.uint32)
        by_rank = np.empty(distinct, np.uint64)
        by_rank[rank] = names
        logs, short = Block(by_rank, numbers, counts, order).logs(np.concatenate([_unpacked_counts(x["counted"]) for x in rows]))
        return pa.table({"doc_id": pa.array(r["doc_ids"], pa.int64()), "n_words": pa.array(counts), "logs": pa.array(logs), "short": pa.array(short)})

    return run


def score_corpus(docs: DataFrame, order: int = ORDER, parts: int | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, logprob, and score (logprob a word) of every row by the n-gram counts of all other rows."""
    spark = docs.sparkSession
    parts = parts or parts_for(docs, PART_BYTES)
    sent = docs.select("doc_id", "text").mapInArrow(thrifty(_explode(parts, order, block_words)), ROW).groupBy("part").applyInArrow(thrifty_group(_count), "part int, block bigint, doc_ids array<bigint>, names binary, numbers binary, words binary, parts int, counted binary")
    path = shared_folder(spark)
    sent.groupBy("block").applyInArrow(thrifty_group(_sum(order)), "doc_id bigint, n_words bigint, logs double, short bigint").write.parquet(path)
    held = spark.read.parquet(path)
    n = held.agg(F.sum("n_words")).first()[0] or 0
    logprob = F.col("logs") - F.col("short") * F.log(F.greatest(F.lit(n) - F.col("n_words"), F.lit(1)))
    return held.select("doc_id", "n_words", logprob.alias("logprob"), F.when(F.col("n_words") > 0, logprob / F.col("n_words")).alias("score"))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))


def _grams(docs: DataFrame, n: int, keep: list[str]) -> DataFrame:
    """keep, pos (of the last word) and gram (array of up to n words that end there)."""
    w = docs.select(*keep, _words(F.col("text")).alias("words"))
    at = w.select(*keep, "words", F.posexplode("words").alias("pos", "word"))
    return at.select(*keep, "pos", F.slice("words", F.greatest(F.lit(1), F.col("pos") + 2 - n), F.least(F.col("pos") + 1, F.lit(n))).alias("gram"))


def count_tables(corpus: DataFrame, order: int = 2) -> dict[int, DataFrame]:
    """For each n up to order: the n-grams within texts and their counts."""
    return {n: _grams(corpus, n, []).where(F.size("gram") == n).groupBy("gram").agg(F.count("*").alias("n")) for n in range(1, order + 1)}


def score(docs: DataFrame, tables: dict[int, DataFrame], backoff: float = BACKOFF) -> DataFrame:
    """doc_id, n_words and logprob of every row by count tables; a word that no table has counts as seen once.

    Each distinct text is scored once and rows get their text's score, so a doc_id may repeat or be null.
    """
    order = max(tables)
    total = tables[1].agg(F.sum("n")).first()[0] or 1
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key_of", F.md5(F.col("text").cast("binary")))
    x = _grams(rows.select("key_of", "text").dropDuplicates(["key_of"]), order, ["key_of"]).withColumn("s", F.lit(None).cast("double"))
    for n in range(order, 0, -1):
        gram = F.when(F.col("s").isNull() & (F.size("gram") >= n), F.slice("gram", -n, n))
        x = x.withColumn("key", gram).join(tables[n].select(F.col("gram").alias("key"), F.col("n").alias("top")), "key", "left")
        if n > 1:
            context = tables[n - 1].select(F.col("gram").alias("context"), F.col("n").alias("low"))
            x = x.withColumn("context", F.when(F.col("top").isNotNull(), F.slice("key", 1, n - 1))).join(context, "context", "left").drop("context")
            found = F.log(F.col("top") / F.col("low"))
        else:
            x = x.withColumn("low", F.lit(None))
            found = F.log(F.coalesce("top", F.lit(1)) / F.lit(float(total)))
        steps = F.least(F.lit(order), F.size("gram")) - n
        x = x.withColumn("s", F.coalesce("s", F.when(F.col("key").isNotNull() if n == 1 else F.col("top").isNotNull(), found + steps * F.lit(float(np.log(backoff)))))).drop("key", "top", "low")
    sums = x.groupBy("key_of").agg(F.count("*").alias("n_words"), F.sum("s").alias("logprob"))
    return rows.select("doc_id", "key_of").join(sums, "key_of", "left").select("doc_id", F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce("logprob", F.lit(0.0)).alias("logprob"))
