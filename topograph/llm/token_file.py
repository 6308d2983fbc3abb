"""Token-id files: a concatenated id array with Elias-Fano encoded document boundaries.

A file holds consecutive documents in order of doc_id: a header, the ids (16 bits each if all are under 65536, else
32), and two Elias-Fano sequences, of the documents' ends in the id array and of their doc_ids. A sequence of n
values up to u takes about 2 + log2(u / n) bits a value: the low bits packed, the high bits in unary, and the place
of every 256th one, so select(i) reads one short stretch of bits and needs no table of 64-bit offsets.

Files are binary rows of a Parquet table, written by Spark's own commit protocol to the shared folder, so lost
executors and second attempts leave no halves behind; a row is a complete file and can be saved as one.

Null text is empty text. Null doc_ids come first and are told by a count in the header; repeated doc_ids keep a
place each, in order of their ids' bytes. Extra columns are ignored; an empty table gives no file and no rows.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from topograph.llm.bpe import encode_words
from topograph.llm.storage import parts_for, shared_folder
from topograph.workers import thrifty

TOKENIZER = "word_bpe_49k.json"
MAGIC = b"EFIDS\0\0\1"
SAMPLE = 256
END_ID = 1
FILE_IDS = 1 << 21
FILES = "place int, number int, n_docs bigint, n_ids bigint, file binary"
#: Files whose places in the whole (one short row each) are broadcast; more are joined.
FEW_FILES = 500_000
#: Bytes of text for each part that words, and then documents, are dealt to.
PART_BYTES = 64 << 20


class EliasFano:
    """A rising sequence of whole numbers from 0 on."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        values = values.astype(np.uint64)
        low_bits = max(0, int(values[-1] // n).bit_length() - 1) if n else 0
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, low_bits, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"), np.packbits(high, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        return struct.pack("<QBQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview) -> tuple[EliasFano, int]:
        """The sequence and the number of bytes it took."""
        n, low_bits, a, b, c = struct.unpack_from("<QBQQQ", data)
        at = struct.calcsize("<QBQQQ")
        ends = np.cumsum([at, a, b, 4 * c])
        low, high, samples = (np.frombuffer(data[x:y], kind) for x, y, kind in zip(ends[:-1], ends[1:], (np.uint8, np.uint8, np.uint32), strict=True))
        return cls(n, low_bits, low, high, samples), int(ends[-1])

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i[:, None] * self.low_bits + np.arange(self.low_bits)
        bits = (self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        return (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """The i-th value, from the bits after the nearest sample."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, need = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at >> 3
        while True:
            ones = np.flatnonzero(np.unpackbits(self.high[byte : byte + 2 * SAMPLE], bitorder="little")) + 8 * byte
            ones = ones[ones >= at]
            if len(ones) > need:
                high = int(ones[need]) - i
                return high << self.low_bits | int(self._low(np.array([i]))[0])
            need -= len(ones)
            byte += 2 * SAMPLE
            at = 8 * byte

    def span(self, lo: int, hi: int) -> np.ndarray:
        """select() of lo to hi - 1, from the bits between the samples around them."""
        if not 0 <= lo <= hi <= self.n:
            raise IndexError((lo, hi))
        if lo == hi:
            return np.zeros(0, np.uint64)
        first, after = lo // SAMPLE, -(-hi // SAMPLE)
        at = int(self.samples[first])
        end = int(self.samples[after]) if after < len(self.samples) else 8 * len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[at >> 3 : (end + 7) >> 3], bitorder="little")) + (at >> 3 << 3)
        i = np.arange(lo, hi)
        high = ones[np.searchsorted(ones, at) + lo - first * SAMPLE :][: hi - lo] - i
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def all(self) -> np.ndarray:
        return self.span(0, self.n)


class TokenFile:
    """A file's documents; what is read is only what is asked for."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        magic, width, nulls, first, n_ids = struct.unpack_from("<8sBQqQ", view)
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        at = struct.calcsize("<8sBQqQ")
        self.ids = np.frombuffer(view[at : at + width * n_ids], {2: np.uint16, 4: np.uint32}[width])
        self.ends, used = EliasFano.from_bytes(view[at + width * n_ids :])
        self._names, _ = EliasFano.from_bytes(view[at + width * n_ids + used :])
        self.nulls, self.first = nulls, first

    def __len__(self) -> int:
        return self.ends.n

    def span(self, i: int) -> tuple[int, int]:
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        a, b = self.span(i)
        return self.ids[a:b]

    def doc_ids(self, lo: int = 0, hi: int | None = None) -> list[int | None]:
        """Of documents lo to hi - 1, or all."""
        hi = len(self) if hi is None else hi
        known = self._names.span(max(0, lo - self.nulls), max(0, hi - self.nulls))
        return [None] * (min(hi, self.nulls) - min(lo, self.nulls)) + [int(x) + self.first for x in known]

    def spans(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Where documents lo to hi - 1 begin and end in the id array."""
        ends = self.ends.span(lo, hi).astype(np.int64)
        return np.concatenate([[self.ends.select(lo - 1) if lo else 0], ends[:-1]]).astype(np.int64), ends

    @staticmethod
    def build(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
        """doc_ids rising, nulls first; sizes: ids of each document."""
        nulls = sum(x is None for x in doc_ids)
        known = np.array([x for x in doc_ids if x is not None], dtype=object)
        first = int(known[0]) if len(known) else 0
        width = 2 if len(ids) == 0 or ids.max() < 1 << 16 else 4
        return (
            struct.pack("<8sBQqQ", MAGIC, width, nulls, first, len(ids))
            + ids.astype({2: np.uint16, 4: np.uint32}[width]).tobytes()
            + EliasFano.encode(np.cumsum(sizes, dtype=np.int64)).to_bytes()
            + EliasFano.encode((known - first).astype(np.uint64)).to_bytes()
        )


@lru_cache(1)
def _tokenizer(definition: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are parallel already
    return Tokenizer.from_str(definition)


def id_kind(t: Tokenizer) -> type:
    return np.uint16 if max(t.get_vocab(True).values()) < 1 << 16 else np.uint32


def pack(ids: np.ndarray) -> bytes:
    """Ids as compressed byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(ids.view(np.uint8).reshape(-1, ids.itemsize).T).tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def encode(docs: DataFrame, path: str | None = None, parts: int | None = None) -> DataFrame:
    """doc_id and ids (packed; 16-bit, or 32-bit for a large vocabulary) of every whole text.

    This kind of tokenizer never looks across an ASCII blank: its normalizer and its pre-tokenizer work within the
    strings between them. So these strings are the words of bpe.encode_words(), which encodes each distinct one once.
    """
    with open(path or public_tokenizers.path(TOKENIZER), encoding="utf-8") as f:
        definition = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    kind = id_kind(Tokenizer.from_str(definition))

    def encoder(words: list[str]) -> list[list[int]]:
        t, out = _tokenizer(shared.value), []
        for lo in range(0, len(words), 4096):
            out += [x.ids for x in t.encode_batch_fast(words[lo : lo + 4096], add_special_tokens=False)]
        return out

    def cut(text: pa.Array) -> pa.Array:
        return pc.ascii_split_whitespace(text.fill_null("").cast(pa.large_string()))

    return encode_words(docs.select("doc_id", "text"), encoder, cut, kind, pack, parts=parts or parts_for(docs, PART_BYTES))


def cuts(docs: DataFrame, parts: int) -> np.ndarray:
    """The least doc_ids of all ranges but the first; dealing out the ids alone is cheap, dealing out encoded texts by
    range would encode them once more, for a sample. One number a range comes to the driver."""
    least = docs.select("doc_id").where("doc_id is not null").repartitionByRange(parts, "doc_id").groupBy(F.spark_partition_id().alias("at")).agg(F.min("doc_id").alias("least"))
    return np.sort(np.array([r["least"] for r in least.select("least").collect()], np.int64))[1:]


def write(encoded: DataFrame, path: str, cuts: np.ndarray, kind: type = np.uint16, end_id: int = END_ID, file_ids: int = FILE_IDS) -> None:
    """Writes (doc_id, ids) as files of about file_ids ids in order of doc_id, each document with end_id at its end.
    Rows are dealt by the ranges between cuts; a file's place is its range, its number the order within."""
    end = np.array([end_id], kind)
    bounds = encoded.sparkSession.sparkContext.broadcast(cuts)

    def placed(doc_id: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds.value, doc_id.fill_null(-(1 << 63)).to_numpy(), side="right").astype(np.int32))

    place = F.arrow_udf(placed, "int")(F.col("doc_id")) if len(cuts) else F.lit(0)
    ordered = encoded.select("doc_id", "ids", place.alias("place")).repartitionById(len(cuts) + 1, "place").sortWithinPartitions("doc_id", "ids").select("doc_id", "ids")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, texts, number, n = TaskContext.get().partitionId(), [], [], 0, 0

        def flush() -> pa.RecordBatch:
            sizes = np.array([len(x) + 1 for x in texts])
            data = TokenFile.build(held, sizes, np.concatenate([y for x in texts for y in (x, end)]))
            return pa.RecordBatch.from_pydict({"place": pa.array([place], pa.int32()), "number": pa.array([number], pa.int32()), "n_docs": [len(sizes)], "n_ids": [int(sizes.sum())], "file": pa.array([data], pa.binary())})

        for b in batches:
            for lo in range(0, b.num_rows, 256):
                piece = b.slice(lo, 256)
                if held and n >= file_ids:
                    yield flush()
                    held, texts, number, n = [], [], number + 1, 0
                held += piece.column("doc_id").to_pylist()
                new = [unpack(x.as_py(), kind) for x in piece.column("ids")]
                texts += new
                n += sum(map(len, new)) + len(new)
        if held:
            yield flush()

    ordered.mapInArrow(thrifty(run), "place int, number int, n_docs bigint, n_ids bigint, file binary").write.option("compression", "zstd").parquet(path)


def bases(files: DataFrame) -> DataFrame:
    """place, number and base (ids in all files before) of each file. Sums by place, a running sum over the places (one
    short row each), and running sums within each place."""
    sizes = files.select("place", "number", "n_ids")
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    places = sizes.groupBy("place").agg(F.sum("n_ids").alias("own")).select("place", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("first"))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("place").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumn("inside", inside).join(places, "place").select("place", "number", (F.col("first") + F.col("inside")).alias("base"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of every document in the files, by their
    select structures."""
    files = spark.read.schema(FILES).parquet(path)
    base = bases(files)
    few = files.select("place").limit(FEW_FILES + 1).count() <= FEW_FILES
    joined = files.select("place", "number", "file").join(F.broadcast(base) if few else base, ["place", "number"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, file in zip(b.column("base"), b.column("file"), strict=True):
                f = TokenFile(file.as_py())
                for lo in range(0, len(f), 4096):
                    hi = min(lo + 4096, len(f))
                    starts, ends = f.spans(lo, hi)
                    ids = f.ids[starts[0] : ends[-1]].astype(np.uint32)
                    crc = [zlib.crc32(ids[a:z]) for a, z in zip(starts - starts[0], ends - starts[0], strict=True)]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(f.doc_ids(lo, hi), pa.int64()), "start": pa.array(starts + base.as_py()), "n_tokens": pa.array(ends - starts), "ids_crc32": pa.array(crc, pa.int64())})

    return joined.select("base", "file").mapInArrow(thrifty(run), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, path: str | None = None, parts: int | None = None) -> DataFrame:
    """Encodes every text, writes the files, and reads them back."""
    spark = docs.sparkSession
    parts = parts or parts_for(docs, PART_BYTES)
    path = path or shared_folder(spark)
    kind = id_kind(Tokenizer.from_file(public_tokenizers.path(TOKENIZER)))
    write(encode(docs, parts=parts), path, cuts(docs, parts), kind)
    return read(spark, path)
