"""Source divergence audit: how far the term shares of a language's sources lie apart, and which terms set each apart.

Terms are maximal runs of A-Z, a-z and characters beyond ASCII, with A-Z lower-cased. A language keeps the terms of at
least `least_docs` of its documents. With count c of a kept term in a group (language and source), N all of the group's
kept occurrences and V the language's kept terms, its share is p = 1 + floor(10**9 * (c + 5) / (N + 5 * V)). Two groups
lie apart by the sum of |p - q|; a term sets a group apart if its share is above the language's own.

Occurrences are added up within pieces of text before anything is shuffled, and again by Spark's partial aggregation.
Kept terms are dealt by hash to blocks of a language, with few enough terms that a block's dense matrix of groups by
terms has CELLS cells (MIN_TERMS terms at least). A block broadcasts all pairs of its groups in slices of bounded size,
emits a row for each pair and the best `top` terms of each group; pairs are summed and the bests merged by rank.

Null text, language and source are the empty string. Every group that occurs is there, without terms too. Repeated rows
count again, doc_ids aren't read. Extra columns are ignored; no rows give none. Long division in three steps of 1,000 is
exact as long as a group has under 2**53 occurrences, which is checked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topograph.llm.storage import shared_folder, stored
from topograph.llm.words import words
from topograph.workers import thrifty, thrifty_pair

LEAST_DOCS, TOP, PRIOR = 30, 50, 5
CELLS, MIN_TERMS, MAX_TERMS = 1 << 20, 64, 1024
#: Bytes of text of which a task adds up terms at a time, unless a text is longer.
PIECE = 8 << 20
PARTING = np.zeros(256, dtype=bool)
PARTING[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def terms(text: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All terms of a text column, end to end, and each one's row."""
    text = text.cast(pa.large_string())
    bounds = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    w = words(data, bounds - bounds[0], PARTING)
    size = w.ends - w.starts
    at = np.concatenate([[0], np.cumsum(size)])
    kept = LOWER[data[~PARTING[data]]]
    found = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(kept)))
    return found.dictionary_encode(), w.rows()


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, occurrences and documents of each piece of a partition."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= PIECE:
            yield _tallied(pa.Table.from_batches(held).combine_chunks())
            held, size = [], 0
    if held:
        yield _tallied(pa.Table.from_batches(held).combine_chunks())


def _tallied(table: pa.Table) -> pa.RecordBatch:
    lang, source = (table.column(c).combine_chunks().cast(pa.large_string()).dictionary_encode() for c in ("lang", "source"))
    many = len(source.dictionary)
    group = lang.indices.to_numpy().astype(np.int64) * many + source.indices.to_numpy()
    found, row = terms(table.column("text").combine_chunks())
    vocabulary = max(1, len(found.dictionary))
    code = found.indices.to_numpy().astype(np.int64)
    one, times = np.unique(row * vocabulary + code, return_counts=True)  # a document's term
    key, at = np.unique(group[one // vocabulary] * vocabulary + one % vocabulary, return_inverse=True)
    n, docs = np.bincount(at, times, len(key)).astype(np.int64), np.bincount(at, minlength=len(key))
    own = key // vocabulary
    out = [lang.dictionary.take(pa.array(own // many)), source.dictionary.take(pa.array(own % many)), found.dictionary.take(pa.array(key % vocabulary))]
    return pa.RecordBatch.from_arrays([*(x.cast(pa.string()) for x in out), pa.array(n), pa.array(docs)], ["lang", "source", "term", "n", "docs"])


def shares(counts: np.ndarray, totals: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(10**9 * (count + PRIOR) / (total + PRIOR * kept)) for each group and term."""
    rest, below = counts + PRIOR, (totals + PRIOR * kept)[:, None]
    if len(totals) and int(totals.max()) + PRIOR * kept >= 1 << 53:
        raise OverflowError("a group has 2**53 occurrences or more")
    out = np.ones_like(rest)
    whole = np.zeros_like(rest)
    for _ in range(3):
        rest = rest * 1000
        step = rest // below
        rest -= step * below
        whole = whole * 1000 + step
    return out + whole


def _block(top: int) -> Callable:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """left: counts of the block's terms by source number; right: the language's groups, in one row."""
        known = right.to_pylist()[0]
        sources, kept = len(known["totals"]), known["kept"]
        term = left.column("term").combine_chunks().dictionary_encode() if left.num_rows else pa.array([], pa.string()).dictionary_encode()
        counts = np.zeros((sources, len(term.dictionary)), np.int64)
        counts[left.column("no").to_numpy(), term.indices.to_numpy()] = left.column("n").to_numpy()
        p = shares(counts, np.array(known["totals"], np.int64), kept)
        whole = counts.sum(0)[None, :]
        q = shares(whole, np.array([known["total"]], np.int64), kept)[0]
        i, j = np.triu_indices(sources, 1)
        apart = np.zeros(len(i), np.int64)
        step = max(1, CELLS // max(1, p.shape[1]))
        for lo in range(0, len(i), step):
            apart[lo : lo + step] = np.abs(p[i[lo : lo + step]] - p[j[lo : lo + step]]).sum(1)
        names = np.array([x.encode() for x in term.dictionary.to_pylist()], object)
        order = np.argsort(names, kind="stable")
        place = np.empty(len(names), np.int64)
        place[order] = np.arange(len(names))
        own, item, value = [], [], []
        for g in range(sources):
            at = np.flatnonzero((counts[g] > 0) & (p[g] > q))
            best = at[np.lexsort((place[at], q[at] - p[g, at]))[:top]]
            own += [g] * len(best)
            item += best.tolist()
            value += (p[g, best] - q[best]).tolist()
        n, m = len(i), len(own)
        return pa.table({
            "lang": pa.array([known["lang"]] * (n + m), pa.string()), "no": pa.array(np.concatenate([i, np.array(own, np.int64)]).astype(np.int32)), "other": pa.array([*j.tolist(), *[None] * m], pa.int32()),
            "term": pa.concat_arrays([pa.nulls(n, pa.string()), term.dictionary.take(pa.array(item, pa.int64()))]), "value": pa.array(np.concatenate([apart, np.array(value, np.int64)])),
        })

    return run


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank. Part `pair`: each other source of the language by distance; part `term`:
    the `top` terms whose share lies highest above the language's. Larger values first, ties by the item's bytes."""
    spark = docs.sparkSession
    read = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = read.mapInArrow(thrifty(_counted), "lang string, source string, term string, n long, docs long")
    counted = stored(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    frequent = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    kept = stored(counted.drop("docs").join(frequent, ["lang", "term"]))

    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = read.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    vocabulary = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("kept"))
    groups = groups.join(vocabulary, "lang", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    groups = stored(groups.withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1))
    langs = groups.groupBy("lang").agg(F.first("kept").alias("kept"), F.sum("total").alias("total"), F.transform(F.array_sort(F.collect_list(F.struct("no", "total"))), lambda x: x["total"]).alias("totals"))
    size = F.greatest(F.lit(MIN_TERMS), F.least(F.lit(MAX_TERMS), F.floor(CELLS / F.size("totals"))))
    langs = stored(langs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("kept") / size)).cast("int")))

    numbered = kept.join(groups.select("lang", "source", "no"), ["lang", "source"]).join(langs.select("lang", "blocks"), "lang")
    dealt = numbered.select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "no", "term", "n")
    asked = langs.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    path = shared_folder(spark)
    dealt.groupBy("lang", "block").cogroup(asked.groupBy("lang", "block")).applyInArrow(thrifty_pair(_block(top)), "lang string, no int, other int, term string, value long").write.parquet(path)
    found = spark.read.parquet(path)

    name = groups.select("lang", "no", "source")
    pairs = found.where("other is not null").groupBy("lang", "no", "other").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct("no", "other"), F.struct(F.col("other").alias("no"), F.col("no").alias("other")))).alias("w")
    pairs = pairs.select("lang", "value", ways).select("lang", "w.no", "w.other", "value")
    pairs = pairs.join(name.select("lang", F.col("no").alias("other"), F.col("source").alias("item")), ["lang", "other"]).select("lang", "no", F.lit("pair").alias("part"), "item", "value")
    best = found.where("other is null").select("lang", "no", F.lit("term").alias("part"), F.col("term").alias("item"), "value")

    def ranked(frame: DataFrame) -> DataFrame:
        return frame.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "no").orderBy(F.desc("value"), "item")))

    out = ranked(pairs).unionByName(ranked(best).where(F.col("rank") <= top))
    return out.join(name, ["lang", "no"]).select("lang", "source", "part", "item", "value", "rank")
