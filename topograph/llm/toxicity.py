"""Toxicity: a classifier chain of sparse linear models.

Features are the words of a text, the first bytes of each word and the last bytes of each blank-separated
string, hashed; those that tell a category's labels apart best are kept. The categories are predicted in
order, and each later logistic model also gets the log-odds of all earlier categories: out-of-fold ones when
it is trained, so that it doesn't trust them more than they deserve.

Training takes at most `max_labelled` labelled rows, those with the smallest hash of doc_id; every text is
scored whole. Of texts that share a doc_id the first in order of bytes stands for it, and equal labels of one
doc_id count once, so that bound holds whatever is repeated. Null or empty text has no feature and gets the
models' base rate. Labels that are null, or of doc_ids without a text, are unused. Without labels of both kinds a category's probability is its base rate (0
without any row). Extra columns are kept by reject() and ignored by predict(); repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topograph.llm.words import Words, split, words
from topograph.workers import thrifty, trim

CATEGORIES = ("low_quality", "toxic")
#: Bytes that part words: ASCII other than letters and digits.
PARTING = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
PREFIXES = (4, 6)
SUFFIX = 3
BITS = 22
#: Texts that a feature is in, at least.
LEAST_SEEN = 3


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every feature of some texts, in no order and with repeats."""
    buf = w.buf.copy()
    upper = (buf >= 65) & (buf <= 90)
    buf[upper] |= 0x20
    plain = words(buf, w.bounds, PARTING)
    rows = plain.rows()
    found = [(rows, plain.hashes())]
    for k in PREFIXES:
        longer = plain.ends - plain.starts > k
        found.append((rows[longer], plain.hashes(k)[longer] ^ np.uint64(k)))
    tail = Words(buf, w.bounds, np.maximum(w.ends - SUFFIX, w.starts), w.ends, w.offsets)
    found.append((w.rows(), tail.hashes() ^ np.uint64(1 << 63)))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


@dataclass
class Linear:
    keys: np.ndarray
    weights: np.ndarray
    bias: float
    earlier: np.ndarray

    def log_odds(self, rows: np.ndarray, keys: np.ndarray, n: int, before: np.ndarray) -> np.ndarray:
        """Of n rows, from their distinct (row, feature) pairs and the earlier categories' log-odds [n, k]."""
        out = np.full(n, self.bias) + before @ self.earlier
        if len(self.keys) and len(keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            out += np.bincount(rows[hit], self.weights[at[hit]], n)
        return out


def _fit(rows: np.ndarray, codes: np.ndarray, names: np.ndarray, y: np.ndarray, before: np.ndarray, max_features: int, ridge: float = 0.1) -> tuple[Linear, np.ndarray]:
    """The model of a category, and its weight of each feature; codes are places in `names`, the features' hashes."""
    n, none, weights = len(y), np.zeros(0, np.uint64), np.zeros(len(names))
    positive = int(y.sum())
    if not 0 < positive < n:
        return Linear(none, np.zeros(0), float(np.log((positive + 0.5) / (n - positive + 0.5))) if n else -30.0, np.zeros(before.shape[1])), weights
    seen = np.bincount(codes, minlength=len(names))
    hits = np.bincount(codes[y[rows] > 0], minlength=len(names))
    rate = seen / n
    z = (hits / positive - (seen - hits) / (n - positive)) / np.sqrt(rate * (1 - rate) * (1 / positive + 1 / (n - positive)) + 1e-12)
    good = np.flatnonzero((seen >= LEAST_SEEN) & (np.abs(z) >= 4))
    good = np.sort(good[np.argsort(-np.abs(z[good]), kind="stable")[:max_features]])
    place = np.full(len(names), -1, np.int32)
    place[good] = np.arange(len(good))
    x = np.zeros((n, len(good) + before.shape[1] + 1))
    use = np.flatnonzero(place[codes] >= 0)
    x[rows[use], place[codes[use]]] = 1
    x[:, len(good) : -1], x[:, -1] = before, 1
    w = np.zeros(x.shape[1])
    w[-1] = np.log(positive / (n - positive))
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    weights[good] = w[: len(good)]
    return Linear(names[good], w[: len(good)], float(w[-1]), w[len(good) : -1]), weights


def fit(rows: np.ndarray, codes: np.ndarray, names: np.ndarray, labels: np.ndarray, max_features: int = 400, folds: int = 5) -> list[Linear]:
    """The chain, from distinct (row, feature) pairs and labels [rows, categories]."""
    n = len(labels)
    fold = np.arange(n) % folds
    before, chain = np.zeros((n, 0)), []
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        out = np.zeros(n)
        for f in range(folds if k + 1 < labels.shape[1] else 0):
            own = fold == f
            number = np.cumsum(~own) - 1
            use = ~own[rows]
            model, weights = _fit(number[rows[use]], codes[use], names, y[~own], before[~own], max_features)
            odds = model.bias + before @ model.earlier + np.bincount(rows[~use], weights[codes[~use]], n)
            out[own] = odds[own]
        chain.append(_fit(rows, codes, names, y, before, max_features)[0])
        before = np.column_stack([before, np.clip(out, -8, 8)])
    return chain


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, max_labelled: int = 5000) -> list[Linear]:
    """The chain for the 0/1 columns `categories` of labels(doc_id, ...)."""
    held = labels.select("doc_id", *categories).dropna().distinct()
    chosen = held.orderBy(F.xxhash64("doc_id"), *held.columns).limit(max_labelled)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, w in split(b.column("text")):
                rows, keys = features(w)
                own = [np.unique(x).tobytes() for x in _by_row(rows, keys, hi - lo)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), *(b.column(c).slice(lo, hi - lo) for c in categories), pa.array(own, pa.binary())], ["doc_id", *categories, "keys"])

    near = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", *(F.col(c).cast("int").alias(c) for c in categories)).agg(F.min("text").alias("text"))
    kind = ", ".join(["doc_id bigint", *(f"{c} int" for c in categories), "keys binary"])
    got = near.mapInArrow(thrifty(run), kind).toArrow()
    got = got.sort_by([(c, "ascending") for c in ("doc_id", *categories, "keys")])  # one order, whatever the partitions
    table = np.stack([got[c].to_numpy() for c in categories], 1)
    held = got["keys"].combine_chunks()
    sizes = np.fromiter((len(x.as_buffer()) // 8 for x in held), np.int64, len(held))
    keys = np.concatenate([*(np.frombuffer(x.as_buffer(), np.uint64) for x in held), np.zeros(0, np.uint64)])
    del got, held
    rows = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    names, seen = np.unique(keys, return_counts=True)
    names = names[seen >= LEAST_SEEN]  # the others are never chosen
    codes = np.minimum(np.searchsorted(names, keys), max(len(names) - 1, 0)).astype(np.int32)
    known = names[codes] == keys if len(names) else np.zeros(len(keys), bool)
    rows, codes = rows[known], codes[known]
    del keys, known, seen
    trim()
    chain = fit(rows, codes, names, table)
    trim()
    return chain


def _by_row(rows: np.ndarray, keys: np.ndarray, n: int) -> list[np.ndarray]:
    order = np.argsort(rows, kind="stable")
    return np.split(keys[order], np.searchsorted(rows[order], np.arange(1, n)))


class Scorer:
    """Scores Arrow text columns by a chain; most features are dropped by one look into a bitmap."""

    def __init__(self, chain: list[Linear]):
        self.chain = chain
        self.keys = keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *(m.keys for m in chain)]))
        self.known = np.zeros(1 << BITS, bool)
        self.known[keys >> np.uint64(64 - BITS)] = True

    def __call__(self, text: pa.Array) -> np.ndarray:
        out = []
        for lo, hi, w in split(text):
            rows, keys = features(w)
            use = np.flatnonzero(self.known[keys >> np.uint64(64 - BITS)])
            at = np.minimum(np.searchsorted(self.keys, keys[use]), max(len(self.keys) - 1, 0))
            hit = self.keys[at] == keys[use]
            pairs = np.unique(rows[use][hit] * max(len(self.keys), 1) + at[hit])  # a feature counts once in a text
            row, at = np.divmod(pairs, max(len(self.keys), 1))
            before = np.zeros((hi - lo, 0))
            for m in self.chain:
                before = np.column_stack([before, np.clip(m.log_odds(row, self.keys[at], hi - lo, before), -8, 8)])
            out.append(1 / (1 + np.exp(-before)))
        return np.concatenate(out) if out else np.zeros((0, len(self.chain)))


def predict(docs: DataFrame, chain: list[Linear], categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """doc_id and p_<category> for every text."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            p = scorer(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(p[:, k]) for k in range(len(categories)))], ["doc_id", *(f"p_{c}" for c in categories)])

    return docs.select("doc_id", "text").mapInArrow(thrifty(run), ", ".join(["doc_id bigint", *(f"p_{c} double" for c in categories)]))


def reject(docs: DataFrame, chain: list[Linear], category: int = -1, at: float = 0.5) -> DataFrame:
    """The rows of docs, all columns kept, whose probability of one category is under `at`."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            yield b.filter(pa.array(scorer(b.column("text"))[:, category] < at))

    return docs.mapInArrow(thrifty(run), docs.schema)


def labelled(labels: DataFrame) -> DataFrame:
    """The labels table (quality, toxic) as the categories of the chain."""
    low: Column = (F.col("quality") == 0).cast("int")
    return labels.select("doc_id", low.alias("low_quality"), F.col("toxic").cast("int").alias("toxic"))
