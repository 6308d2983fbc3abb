"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

Each text is cut into pre-tokens (words) by the tokenizer's pattern. A block of consecutive texts
numbers its distinct words and keeps, for each text, the words' numbers in order of position. The distinct words of
all blocks are dealt by hash, so that each distinct word is encoded once; its ids go back to the blocks that hold
it, and each block puts its texts together by position. Decoding joins the exploded ids with the token-byte table, an
Arrow column as large as the vocabulary file and therefore broadcast, and puts each text's bytes together by position.

Parts grow in number with the bytes of the texts, so that a part holds about as many words at every size.

Both the words and the texts' numbers come from one deterministic map over the input, which Spark runs for each of
them. A block is named by a hash of its words, so if the input gave other rows the second time, the ids would be
missed and the job would fail; it can't mix blocks up. Reading files gives the same rows again; a frame that doesn't
should be written first.

Null text is empty text; an empty text has no ids. Repeated rows are encoded each; extra columns are ignored; an empty
table gives no rows. Ids are bytes: little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from topograph.llm.packing import pack_numbers, spans, unpack_numbers
from topograph.llm.storage import parts_for
from topograph.llm.words import string_hashes
from topograph.workers import thrifty, thrifty_group, thrifty_pair

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PATTERN = public_tokenizers.PATTERN
#: Bytes of text for each part that words are dealt to.
PART_BYTES = 64 << 20
TOKENS_AT_ONCE = 1 << 19
#: Pre-tokens in a block, but for a longer text; larger blocks send fewer words and take more memory.
BLOCK_WORDS = 1 << 20


def read_ranks(path: str | None = None) -> dict[bytes, int]:
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pack_strings(strings: pa.Array) -> bytes:
    strings = strings.cast(pa.large_string())
    ends = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    sizes = pack_numbers(np.diff(ends))
    body = memoryview(strings.buffers()[2] or b"")[ends[0] : ends[-1]] if len(strings) else b""
    return len(sizes).to_bytes(4, "little") + sizes + zstandard.ZstdCompressor(level=1).compress(body)


def unpack_strings(data: bytes) -> pa.Array:
    n = int.from_bytes(data[:4], "little")
    sizes = unpack_numbers(data[4 : 4 + n])
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(zstandard.ZstdDecompressor().decompress(data[4 + n :])))


class Block:
    """A batch's distinct words from the most frequent on, the part each is dealt to, and its texts' numbers."""

    def __init__(self, words: pa.Array, parts: int):
        flat = words.flatten().dictionary_encode()
        numbers, names = flat.indices.to_numpy(), flat.dictionary.cast(pa.large_string())
        order = np.argsort(-np.bincount(numbers, minlength=len(names)), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.names = names.take(pa.array(order))
        self.numbers = place[numbers]
        self.counts = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        hashes = string_hashes(self.names)
        self.part = (hashes % np.uint64(parts)).astype(np.int32)
        self.key = np.int64(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())))

    def dealt(self, parts: int) -> Iterator[tuple[int, pa.Array]]:
        order = np.argsort(self.part, kind="stable")
        at = np.searchsorted(self.part[order], np.arange(parts + 1))
        for p in np.unique(self.part).tolist():
            yield p, self.names.take(pa.array(order[at[p] : at[p + 1]]))


def blocks(batches: Iterable[tuple[pa.Array, pa.Array]]) -> Iterator[tuple[list[int | None], pa.Array]]:
    """doc_ids and words (a list for each text) of consecutive texts with at most about BLOCK_WORDS words."""
    held, size = [], 0
    for ids, words in batches:
        held.append((ids.to_pylist(), words))
        size += len(words.flatten())
        if size >= BLOCK_WORDS:
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list) -> tuple[list[int | None], pa.Array]:
    return [x for ids, _ in held for x in ids], pa.concat_arrays([words for _, words in held])


class TokenBytes:
    """The token-byte table: what each id stands for."""

    def __init__(self, ranks: dict[bytes, int]):
        held: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
        for b, i in ranks.items():
            held[i] = b
        self.column = pa.array(held, pa.large_binary())

    def texts(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The bytes of texts whose ids are laid end to end, text k up to ends[k]: a join of the ids, then the parts of
        each text joined by position. An id outside the table is an error."""
        if len(ids) and (int(ids.max()) >= len(self.column) or self.column.take(pa.array(np.unique(ids))).null_count):
            raise ValueError("an id that the token-byte table doesn't have")
        parts = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int64)), self.column.take(pa.array(ids.astype(np.int64))))
        return pc.binary_join(parts, pa.scalar(b"", pa.large_binary())).cast(pa.binary())


@lru_cache(2)
def _encoder(ranks: frozenset, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=dict(ranks), special_tokens={})


def encode(docs: DataFrame, ranks: dict[bytes, int] | None = None, pattern: str = PATTERN, decoded: bool = False, parts: int | None = None) -> DataFrame:
    """doc_id and ids (bytes) of every whole text; with `decoded` also `bytes`, what the ids stand for."""
    ranks = read_ranks() if ranks is None else ranks
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(ranks.items()))
    table = docs.sparkSession.sparkContext.broadcast(TokenBytes(ranks) if decoded else None)
    parts = parts or parts_for(docs, PART_BYTES)
    cut = docs.select("doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("(?U)" + pattern), F.lit(0)).alias("words"))

    def encoder(words: list[str]) -> list[list[int]]:
        return list(map(_encoder(shared.value, pattern).encode_ordinary, words))

    def decoder(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        return table.value.texts(ids, ends)

    return encode_words(cut, encoder, decoder=decoder if decoded else None, parts=parts)


def encode_words(docs: DataFrame, encoder: Callable[[list[str]], list[list[int]]], cut: Callable[[pa.Array], pa.Array] | None = None, kind: type = np.uint32, pack: Callable[[np.ndarray], bytes] = np.ndarray.tobytes, decoder: Callable[[np.ndarray, np.ndarray], pa.Array] | None = None, parts: int = 1) -> DataFrame:
    """doc_id and the ids of its words, end to end, as numbers of one kind; docs has doc_id and one more column, the
    words, or what `cut` makes words of. encoder: the ids of each of some distinct words. pack: a text's ids as bytes.
    decoder: adds `bytes`, what it makes of the ids of some texts and their ends. parts: how many the words are dealt to."""
    names = ["ids", "bytes"] if decoder else ["ids"]

    def blocks_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[int | None], Block]]:
        for ids, words in blocks((b.column(0), cut(b.column(1)) if cut else b.column(1)) for b in batches):
            yield ids, Block(words, parts)

    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in blocks_of(batches):
            for p, names in block.dealt(parts):
                yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "block": pa.array([block.key], pa.int64()), "words": pa.array([pack_strings(names)], pa.binary())})

    def texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, block in blocks_of(batches):
            held = {"block": pa.array([block.key], pa.int64()), "doc_ids": pa.array([ids], pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_pydict(held | {k: pa.array([pack_numbers(v)], pa.binary()) for k, v in (("counts", block.counts), ("numbers", block.numbers), ("parts", block.part))})

    def once(table: pa.Table) -> pa.Table:
        held = [unpack_strings(x.as_py()) for x in table.column("words")]
        flat = pa.concat_arrays(held).dictionary_encode()
        own = encoder(flat.dictionary.to_pylist())
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        ids = np.fromiter(chain.from_iterable(own), np.uint32, int(sizes.sum()))
        starts, numbers = np.cumsum(sizes) - sizes, flat.indices.to_numpy()
        out, lo = [], 0
        for h in held:
            mine = numbers[lo : lo + len(h)]
            lo += len(h)
            got = pack_numbers(sizes[mine])
            out.append(len(got).to_bytes(4, "little") + got + pack_numbers(ids[spans(starts[mine], sizes[mine])]))
        return pa.table({"block": table.column("block"), "part": table.column("part"), "ids": pa.array(out, pa.binary())})

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64())} | {k: pa.array([], pa.binary()) for k in names})
        by_part = {p.as_py(): x.as_py() for p, x in zip(right.column("part"), right.column("ids"), strict=True)}
        part = unpack_numbers(left.column("parts")[0].as_py())
        order = np.argsort(part, kind="stable")
        sizes, flat = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
        for p in np.unique(part).tolist():
            if p not in by_part:
                raise RuntimeError("the texts changed while they were encoded; write them first")
            n = int.from_bytes(by_part[p][:4], "little")
            sizes.append(unpack_numbers(by_part[p][4 : 4 + n]))
            flat.append(unpack_numbers(by_part[p][4 + n :]))
        size, start = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
        size[order] = np.concatenate(sizes)
        start[order] = np.cumsum(size[order]) - size[order]
        ids, doc_ids, out, texts_of = np.concatenate(flat).astype(kind), [], [], []
        for row in left.select(["doc_ids", "counts", "numbers"]).to_pylist():
            doc_ids += row["doc_ids"]
            numbers, ends = unpack_numbers(row["numbers"]), np.cumsum(unpack_numbers(row["counts"]), dtype=np.int64)
            at = lo = 0
            while at < len(ends):
                to = max(at + 1, int(np.searchsorted(ends, lo + TOKENS_AT_ONCE, side="right")))
                mine = numbers[lo : ends[to - 1]]
                got = ids[spans(start[mine], size[mine])]
                cuts = np.concatenate([[0], np.cumsum(size[mine])])[np.concatenate([[lo], ends[at:to]]) - lo]
                out += [pack(got[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                if decoder:
                    texts_of.append(decoder(got, cuts[1:]))
                at, lo = to, ends[to - 1]
        held = {"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.array(out, pa.binary())}
        return pa.table(held | ({"bytes": pa.chunked_array(texts_of, pa.binary())} if decoder else {}))

    encoded = docs.mapInArrow(thrifty(words), "part int, block bigint, words binary").groupBy("part").applyInArrow(thrifty_group(once), "block bigint, part int, ids binary")
    held = docs.mapInArrow(thrifty(texts), "block bigint, doc_ids array<bigint>, counts binary, numbers binary, parts binary")
    return held.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(thrifty_pair(join), ", ".join(["doc_id bigint", *(f"{k} binary" for k in names)]))


def decode(encoded: DataFrame, ranks: dict[bytes, int] | None = None) -> DataFrame:
    """The frame with the column `bytes`, joined from the token-byte table; an id outside it is an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(TokenBytes(read_ranks() if ranks is None else ranks))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                ids = [x.as_py() for x in part.column("ids")]
                texts = table.texts(np.frombuffer(b"".join(x or b"" for x in ids), np.uint32), np.cumsum([len(x or b"") // 4 for x in ids]))
                out = pc.if_else(part.column("ids").is_null(), pa.scalar(None, pa.binary()), texts)
                yield pa.RecordBatch.from_arrays([*part.columns, out], [*part.schema.names, "bytes"])

    return encoded.mapInArrow(thrifty(run), StructType([*encoded.schema.fields, StructField("bytes", BinaryType())]))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids and of the decoded bytes of every text."""
    x = encode(docs, decoded=True)
    return x.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
