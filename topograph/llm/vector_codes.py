"""Vector codes: product quantisation with codebooks that are fitted and applied in whole numbers.

A component x becomes floor(scale * x); vectors are cut into PARTS equal parts, each with a codebook of `entries` rows.
The nearest entry is screened by a float32 matrix product: each product gets an interval from the standard bound of its
rounding errors, and every entry whose interval reaches below the least upper end is evaluated again in 64-bit integers.
Ties go to the lower index. Integers too large for 64 bits are Python's, from the conversion to the sums.

A round is one pass over the input: tasks add up their vectors by entry before anything is shuffled, and the driver gets
one row for each component of the codebooks (entries * length of a vector), whatever the input's size.

Vectors that are null or hold a null or a component that isn't finite are left out. All others must have one length,
which PARTS divides; other input raises. Rows that share a vec_id are rows of their own, in the order of their vectors
where it matters; a null vec_id comes after all others. No rows give no rows. Extra columns are ignored. A sum of errors
that no long holds raises.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topograph.llm.graph import by_key
from topograph.llm.storage import stored
from topograph.workers import thrifty

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Rows of one matrix product.
BLOCK = 4096
#: Half a unit in the last place of 1, in float32.
UNIT = 2.0**-24
#: Squared distances of whole numbers under this fit 64 bits if there are under 2**12 of them.
NARROW = 1 << 24


def whole(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as int64, or as Python's integers where a component is too large for the sums."""
    x = x.astype(np.float64)
    if not len(x) or np.abs(x).max() < NARROW / scale:
        return np.floor(x * scale).astype(np.int64)
    return np.array([(lambda n, d: n * scale // d)(*v.as_integer_ratio()) for v in x.tolist()], object)


def usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows of a list column take part, their lengths, and their components end to end."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    ok = np.isfinite(flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    bad = column.is_null().to_numpy(zero_copy_only=False) | (np.bincount(rows[~ok], minlength=len(sizes)) > 0)
    return np.flatnonzero(~bad), sizes[~bad], flat.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)[~bad[rows]]


def nearest(v: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, the lower of equals, and its squared distance, exactly."""
    n, d = v.shape
    code, error = np.zeros(n, np.int64), np.zeros(n, object if v.dtype == object or book.dtype == object else np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        b32, b64 = book.astype(np.float64).astype(np.float32), book.astype(np.float64)
        square, length = (b64 * b64).sum(1), np.sqrt((b64 * b64).sum(1))
    # d products and their sums, and a rounding of each factor to float32 first
    gamma = (d + 3) * UNIT / (1 - (d + 3) * UNIT)
    for lo in range(0, n, BLOCK):
        x = v[lo : lo + BLOCK]
        with np.errstate(over="ignore", invalid="ignore"):
            x64 = x.astype(np.float64)
            product = (x64.astype(np.float32) @ b32.T).astype(np.float64)
            far = np.sqrt((x64 * x64).sum(1))[:, None] * length
            score = square - 2 * product  # the squared distance without the row's own square
            slack = 2 * gamma * far * (1 + 1e-9) + (d + 4) * 2.0**-52 * (square + 2 * far)
            slack[~np.isfinite(score) | ~np.isfinite(slack)] = np.inf
            score[~np.isfinite(score)] = 0
            row, entry = np.nonzero(score - slack <= (score + slack).min(1)[:, None])
        step = x[row] - book[entry]
        exact = (step * step).sum(1) if d else np.zeros(len(row), error.dtype)
        order = np.lexsort((entry, exact, row)) if exact.dtype != object else np.array(sorted(range(len(row)), key=lambda i: (row[i], exact[i], entry[i])), np.int64)
        best = order[np.unique(row[order], return_index=True)[1]]
        code[lo : lo + len(x)], error[lo : lo + len(x)] = entry[best], exact[best]
    return code, error


class Codebooks:
    """One array of entries for each part."""

    def __init__(self, books: list[np.ndarray]) -> None:
        self.books = books
        self.length = sum(b.shape[1] for b in books)

    def parts(self, v: np.ndarray) -> list[np.ndarray]:
        return [*v.reshape(len(v), len(self.books), self.length // len(self.books)).transpose(1, 0, 2)]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for b in self.books for row in b.tolist() for x in row).encode()).hexdigest()

    def moved(self, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> Codebooks:
        """Each entry as the floor of its vectors' mean; those without vectors stay."""
        books = [b.astype(object) for b in self.books]
        for (p, e), (n, total) in sums.items():
            books[p][e] = [x // n for x in total]
        return Codebooks([_narrow(b) for b in books])


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64) if not x.size or max(map(abs, x.ravel().tolist())) < NARROW else x


def _vectors(batch: pa.RecordBatch, length: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    rows, sizes, flat = usable(batch.column("embedding"))
    if (sizes != length).any():
        raise ValueError(f"vectors of {length} components expected, found {sorted({*sizes.tolist()} - {length})[:5]}")
    return rows, whole(flat, scale).reshape(len(rows), length)


def _totals(books: Codebooks, scale: int) -> Callable:
    """Number and sum of the task's vectors by part and entry."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            _, v = _vectors(batch, books.length, scale)
            for p, (x, book) in enumerate(zip(books.parts(v), books.books, strict=True)):
                code, _ = nearest(x, book)
                order = np.argsort(code, kind="stable")
                used, begin = np.unique(code[order], return_index=True)
                total = np.add.reduceat(x[order], begin, axis=0) if len(used) else x
                for e, n, t in zip(used.tolist(), np.diff([*begin, len(x)]).tolist(), total.astype(object), strict=True):
                    if (own := held.get((p, e))) is None:
                        held[p, e] = [n, t]
                    else:
                        own[0], own[1] = own[0] + n, own[1] + t
        if held:
            yield pa.RecordBatch.from_arrays([
                pa.array([p for p, _ in held], pa.int32()), pa.array([e for _, e in held], pa.int32()), pa.array([n for n, _ in held.values()], pa.int64()),
                pa.array([[Decimal(x) for x in t] for _, t in held.values()], pa.list_(pa.decimal128(38, 0))),
            ], ["p", "e", "n", "total"])

    return run


def _encoded(books: Codebooks, scale: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, v = _vectors(batch, books.length, scale)
            found = [nearest(x, book) for x, book in zip(books.parts(v), books.books, strict=True)]
            codes = np.stack([c for c, _ in found], 1).astype(np.uint8)
            error = sum(e.astype(object) for _, e in found)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows)) for c in ("vec_id", "label")), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error.tolist(), pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def train(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks that start as the `entries` (256 at most) smallest vec_ids' parts and move `rounds` times; None without vectors."""
    if not 0 < entries <= 256:
        raise ValueError("an entry's index has to fit a byte")
    x = F.col("embedding")
    good = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    first = vectors.where(good).orderBy(F.asc_nulls_last("vec_id"), "embedding").select("embedding").limit(entries).toArrow()
    if not first.num_rows:
        return None
    _, sizes, flat = usable(first.column(0))
    length = int(sizes[0])
    if (sizes != length).any() or length % parts:
        raise ValueError(f"vectors need one length that {parts} divides, found {sorted({*sizes.tolist()})[:5]}")
    start = whole(flat, scale).reshape(len(sizes), parts, length // parts)
    books = Codebooks([_narrow(start[:, p].astype(object)) for p in range(parts)])
    for _ in range(rounds):
        total = vectors.select("embedding").mapInArrow(thrifty(_totals(books, scale)), "p int, e int, n long, total array<decimal(38,0)>")
        total = total.select("p", "e", "n", F.posexplode("total").alias("i", "x")).groupBy("p", "e", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        sums: dict[tuple[int, int], tuple[int, list[int]]] = {}
        for r in total.orderBy("p", "e", "i").collect():
            sums.setdefault((r.p, r.e), (r.n, []))[1].append(int(r.x))
        books = books.moved(sums)
    return books


def encode(vectors: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code (two hexadecimal digits for each part) and error (the squared distances added up)."""
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return vectors.select("vec_id", "label", "embedding").mapInArrow(thrifty(_encoded(books, scale)), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compress(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error (the error of all rows with the same label) and codebooks_sha256 of every row."""
    books = train(vectors, scale, parts, entries, rounds)
    if books is None:
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, code string, error long, label_error long, codebooks_sha256 string")
    name = F.encode(F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")), "utf-8")  # null labels are one group
    coded = stored(encode(vectors, books, scale).withColumn("group", name))
    known = coded.groupBy("group").agg(F.count("*").alias("rows"), F.sum("error").alias("label_error"))
    return by_key(coded, known, "group", "rows").select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
