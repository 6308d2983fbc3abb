"""Substring dedup: suffix automata of reference shards, through which texts' passages are streamed.

A window is WINDOW consecutive words of one text. A word is removed if a window that covers it also starts earlier: in a
text with a smaller doc_id, or earlier in the same text. Windows are judged on the input.

A suffix automaton of everything would have to be as large as the input, and every text would have to meet every shard
of it. So windows are first told apart by an anchor: the leftmost of the ANCHOR-word strings in the window whose hash
is least. Equal windows have equal anchors in equal places.
1. The distinct anchors of each block of texts are dealt by hash; those seen once can't be in a repeated window. The
   others are kept in a filter, which is broadcast if it is under a checked size (MOST_FILTER). A larger one stays where
   it is: each block is told which of its anchors are repeated, and meets the answers in a join by block.
2. Consecutive windows with one anchor are a passage of up to 2 * WINDOW - ANCHOR words. Passages whose anchor passes
   the filter are dealt by its hash, equal ones of a block once with all the places where they are.
3. The passages of an anchor are a reference shard. In order of their first places, each is streamed through the
   shard's suffix automaton for its matching statistics: a match of WINDOW words or more ends a window that starts
   earlier. Then it is added to the automaton. Later places of the same passage repeat all its windows. A shard
   of more than MOST_PASSAGES different passages (of one frequent phrase with ever other words around it) isn't walked
   one after the other: its windows' hashes are grouped at once, and all but the first place of each are repeated.
4. The repeated windows go back to their texts, whose words outside of them are kept.

Null text has no words. Rows that repeat doc_id and text are one document; rows that repeat a doc_id with other texts
are documents in order of a hash of the text; a null doc_id is before all others. Extra columns are kept by clean().
An empty table gives no rows. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from topograph.llm.columns import back, fresh, held
from topograph.llm.packing import pack_numbers, pack_rising, spans, unpack_numbers, unpack_rising
from topograph.llm.storage import parts_for, shared_folder
from topograph.llm.words import STEP, Words, _windows, mix, ngrams, split
from topograph.workers import thrifty, thrifty_group, thrifty_pair

WINDOW, ANCHOR = 20, 10
#: Bytes of text for each part, and parts for each shuffle partition at least: a part is held in memory as a whole.
PART_BYTES, FINER = 16 << 20, 5
MOST_PASSAGES = 64
BLOCK_WORDS = 1 << 19
#: Bits of the filter: FILTER_BITS for each repeated anchor, LEAST_FILTER at least; over MOST_FILTER (64 MB) there is none.
FILTER_BITS, LEAST_FILTER, MOST_FILTER = 12, 1 << 16, 1 << 29
#: Texts with repeated windows, and bytes of their places, that are broadcast; more are joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 300_000, 32 << 20
NULL_ID = -(1 << 63)


def doc_key() -> list[Column]:
    return [F.coalesce("doc_id", F.lit(NULL_ID)).alias("_doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text")]


class Passages:
    """The passages of some texts: row, first window, windows, place of the anchor, and the anchor's hash."""

    def __init__(self, hashes: np.ndarray, offsets: np.ndarray):
        grams, _, gram_offsets = ngrams(hashes, offsets, ANCHOR)
        counts = np.maximum(np.diff(offsets) - WINDOW + 1, 0)
        row = np.repeat(np.arange(len(counts)), counts)
        ends = np.cumsum(counts)
        inside = np.arange(len(row)) - np.repeat(ends - counts, counts)
        at = gram_offsets[row] + inside
        best, place = grams[at], np.zeros(len(at), np.int64)
        for k in range(1, WINDOW - ANCHOR + 1):
            other = grams[at + k]
            less = other < best
            best[less], place[less] = other[less], k
        anchor = inside + place
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])])[: len(row)]
        first = np.flatnonzero(new)
        self.row, self.start, self.anchor, self.key = row[first], inside[first], anchor[first], best[first]
        self.windows = np.diff(np.append(first, len(row)))


def _parts_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _bits(keys: np.ndarray, parts: int, width: int) -> Iterator[np.ndarray]:
    """Places of each key's bits, all within the slice of its part."""
    base = _parts_of(keys, parts) * width
    for h in (keys & np.uint64(0xFFFFFFFF), mix(keys.copy()) >> np.uint64(20)):
        yield base + (h % np.uint64(width)).astype(np.int64)


class Filter:
    def __init__(self, bits: np.ndarray, parts: int, width: int):
        self.bits, self.parts, self.width = bits, parts, width

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in _bits(keys, self.parts, self.width):
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        return out


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """doc, text hash, word hashes and offsets of consecutive texts of about BLOCK_WORDS words."""
    held, size = [], 0
    for b in batches:
        doc, text = b.column("_doc").to_numpy(), b.column("_text").to_numpy()
        for lo, hi, w in split(b.column("text")):
            held.append((doc[lo:hi], text[lo:hi], w.hashes(), np.diff(w.offsets)))
            size += len(held[-1][2])
            if size >= BLOCK_WORDS:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    doc, text, hashes, counts = (np.concatenate(x) for x in zip(*held, strict=True))
    return doc, text, hashes, np.concatenate([[0], np.cumsum(counts)])


def _name(hashes: np.ndarray, offsets: np.ndarray, number: int) -> int:
    """A block's name, by its content and where it comes from."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes() + offsets.tobytes(), seed=(TaskContext.get().partitionId() << 32) + number) - (1 << 63)


ANCHORS = "part int, block bigint, keys binary, twice binary"


def _anchors(parts: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (_, _, hashes, offsets) in enumerate(_blocks(batches)):
            keys, seen = np.unique(Passages(hashes, offsets).key, return_counts=True)
            block = _name(hashes, offsets, number)
            cuts = np.searchsorted(_parts_of(keys, parts), np.arange(parts + 1))
            used = np.flatnonzero(np.diff(cuts)).tolist()
            own = [slice(cuts[p], cuts[p + 1]) for p in used]
            yield pa.RecordBatch.from_pydict({"part": pa.array(used, pa.int32()), "block": pa.array([block] * len(used), pa.int64()), "keys": pa.array([pack_rising(keys[s]) for s in own], pa.binary()), "twice": pa.array([np.packbits(seen[s] > 1).tobytes() for s in own], pa.binary())})

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """The anchors of a part that are there more than once."""
    keys, twice = [], []
    for r in table.select(["keys", "twice"]).to_pylist():
        keys.append(unpack_rising(r["keys"]))
        twice.append(keys[-1][np.unpackbits(np.frombuffer(r["twice"], np.uint8), count=len(keys[-1])).astype(bool)])
    flat = np.sort(np.concatenate(keys))
    found = np.unique(np.concatenate([flat[1:][flat[1:] == flat[:-1]], *twice]))
    return pa.table({"part": table.column("part").slice(0, 1), "n": [len(found)], "keys": pa.array([pack_rising(found)], pa.binary())})


def _told(table: pa.Table) -> pa.Table:
    """For each block of a part's rows, which of its anchors there are more than once anywhere."""
    found = unpack_rising(_repeated(table).column("keys")[0].as_py())
    masks = [np.packbits(np.isin(unpack_rising(x.as_py()), found, assume_unique=True)).tobytes() for x in table.column("keys")]
    sizes = [len(unpack_rising(x.as_py())) for x in table.column("keys")]
    return pa.table({"part": table.column("part"), "block": table.column("block"), "n": pa.array(sizes, pa.int64()), "mask": pa.array(masks, pa.binary())})


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks as rows: their documents, words as numbers of sorted distinct hashes, and words a text."""
    for number, (doc, text, hashes, offsets) in enumerate(_blocks(batches)):
        names, numbers = np.unique(hashes, return_inverse=True)
        held = {"names": pack_rising(names), "numbers": pack_numbers(numbers), "counts": pack_numbers(np.diff(offsets)), "docs": doc.tobytes(), "texts": text.tobytes()}
        yield pa.RecordBatch.from_pydict({"block": pa.array([_name(hashes, offsets, number)], pa.int64())} | {k: pa.array([v], pa.binary()) for k, v in held.items()})


def _met(parts: int):
    """What a block sends, once it knows its repeated anchors."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            raise RuntimeError("the texts changed while their anchors were counted; write them first")
        r = left.to_pylist()[0]
        doc, text = np.frombuffer(r["docs"], np.int64), np.frombuffer(r["texts"], np.int64)
        hashes = unpack_rising(r["names"])[unpack_numbers(r["numbers"])]
        offsets = np.concatenate([[0], np.cumsum(unpack_numbers(r["counts"]), dtype=np.int64)])
        p = Passages(hashes, offsets)
        masks = [np.unpackbits(np.frombuffer(x["mask"], np.uint8), count=x["n"]) for x in sorted(right.to_pylist(), key=lambda x: x["part"])]
        keys, known = np.unique(p.key), np.concatenate([np.zeros(0, np.uint8), *masks]).astype(bool)
        if len(keys) != len(known):
            raise RuntimeError("the texts changed while their anchors were counted; write them first")
        passes = known[np.searchsorted(keys, p.key)] if len(keys) else np.zeros(0, bool)
        return pa.Table.from_batches([_block_sent(parts, p, passes, doc, text, hashes, offsets)])

    return run


def _sent_by_join(named: DataFrame, parts: int) -> DataFrame:
    """_sent() without a filter: the anchors' counts come back to the blocks that hold them."""
    told = named.mapInArrow(thrifty(_anchors(parts)), ANCHORS).groupBy("part").applyInArrow(thrifty_group(_told), "part int, block bigint, n bigint, mask binary")
    texts = named.mapInArrow(thrifty(_texts), "block bigint, names binary, numbers binary, counts binary, docs binary, texts binary")
    return texts.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(thrifty_pair(_met(parts)), SENT)


def repeated_anchors(named: DataFrame, parts: int, most: int = MOST_FILTER) -> Filter | None:
    """A filter that passes every anchor that is there more than once, and few others; None if it would be too large."""
    spark = named.sparkSession
    path = shared_folder(spark)
    named.mapInArrow(thrifty(_anchors(parts)), ANCHORS).groupBy("part").applyInArrow(thrifty_group(_repeated), "part int, n bigint, keys binary").write.parquet(path)
    held = spark.read.parquet(path)
    n = held.agg(F.sum("n")).first()[0] or 0
    bits = max(LEAST_FILTER, n * FILTER_BITS)
    if bits > most:
        return None
    width = -(-bits // parts // 8) * 8

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for part, keys in zip(b.column("part").to_pylist(), b.column("keys"), strict=True):
                mine = np.zeros(width, np.uint8)
                for at in _bits(unpack_rising(keys.as_py()), parts, width):
                    mine[at - part * width] = 1
                out.append(np.packbits(mine, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("part"), pa.array(out, pa.binary())], ["part", "bits"])

    whole = np.zeros(parts * width // 8, np.uint8)
    for r in held.select("part", "keys").mapInArrow(thrifty(run), "part int, bits binary").toLocalIterator():
        whole[r.part * width // 8 : (r.part + 1) * width // 8] = np.frombuffer(r.bits, np.uint8)
    return Filter(whole, parts, width)


SENT = "part int, keys binary, left binary, right binary, words binary, counts binary, docs binary, starts binary, doc_ids binary, doc_texts binary"


def _sent(parts: int, shared) -> object:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = shared.value
        for doc, text, hashes, offsets in _blocks(batches):
            p = Passages(hashes, offsets)
            yield _block_sent(parts, p, passes(p.key), doc, text, hashes, offsets)

    return run


def _block_sent(parts: int, p: Passages, passes: np.ndarray, doc: np.ndarray, text: np.ndarray, hashes: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    """A block's passages whose anchors pass, dealt to parts."""
    rows, use = [], np.flatnonzero(passes)
    if len(use):
        row, start, windows, key = p.row[use], p.start[use], p.windows[use], p.key[use]
        left = p.anchor[use] - start
        begin = offsets[row] + start
        end = begin + windows + WINDOW - 1
        content = mix(_windows(hashes, STEP, begin, end) + (windows * 64 + left).astype(np.uint64))
        _, rank = np.unique(np.stack([doc, text], 1), axis=0, return_inverse=True)
        order = np.lexsort((start, rank.ravel()[row], content, key))
        row, start, key, content = row[order], start[order], key[order], content[order]
        lead = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (content[1:] != content[:-1])]))
        counts = np.diff(np.append(lead, len(row)))
        first = order[lead]
        begin, end, left = begin[first], end[first], left[first]
        right = end - begin - left - ANCHOR
        key = key[lead]
        cuts, at = np.searchsorted(_parts_of(key, parts), np.arange(parts + 1)), np.concatenate([lead, [len(row)]])
        for q in np.flatnonzero(np.diff(cuts)).tolist():
            s = slice(cuts[q], cuts[q + 1])
            places = slice(at[cuts[q]], at[cuts[q + 1]])
            near = np.unique(row[places])
            sides = np.stack([begin[s], begin[s] + left[s] + ANCHOR], 1).ravel()
            words = hashes[spans(sides, np.stack([left[s], right[s]], 1).ravel())]
            numbers = (left[s], right[s], counts[s], np.searchsorted(near, row[places]), start[places])
            packed = dict(zip(("left", "right", "counts", "docs", "starts"), map(pack_numbers, numbers), strict=True))
            rows.append(packed | {"part": q, "keys": pack_rising(key[s]), "words": words.tobytes(), "doc_ids": doc[near].tobytes(), "doc_texts": text[near].tobytes()})
    kinds = [x.split() for x in SENT.split(", ")]
    return pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], pa.int32() if kind == "int" else pa.binary()) for k, kind in kinds})


class Automaton:
    """The suffix automaton of some sequences."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, sequence: list[int]) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in sequence:
            if c in nxt[last]:  # another sequence has been here
                q = nxt[last][c]
                last = q if length[q] == length[last] + 1 else self._split(last, q, c)
                continue
            new = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, q, c)
            last = new

    def _split(self, p: int, q: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def matches(self, sequence: list[int]) -> list[int]:
        """Matching statistics: the length of the longest string that ends at each place and is in the automaton."""
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        out = []
        for c in sequence:
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            if c in nxt[state]:
                state, size = nxt[state][c], size + 1
            out.append(size)
        return out


def _windows_seen(words: np.ndarray, keys: np.ndarray, begin: np.ndarray, left: np.ndarray, size: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, start and number (1) of the windows of some passages that are in another one of the same anchor at an
    earlier place. Passages come without their anchor, in whose stead some numbers stand: it is the same for all."""
    full = size + ANCHOR
    ends = np.cumsum(full)
    inside = np.arange(ends[-1]) - np.repeat(ends - full, full)
    before = np.repeat(left, full)
    anchor = (inside >= before) & (inside < before + ANCHOR)
    flat = np.empty(len(inside), np.uint64)
    flat[anchor] = (inside - before)[anchor] + 1
    flat[~anchor] = words[(np.repeat(begin, full) + inside - np.where(inside < before, 0, ANCHOR))[~anchor]]
    counts = full - WINDOW + 1
    passage = np.repeat(np.arange(len(full)), counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    first = (ends - full)[passage] + offset
    found = mix(_windows(flat, STEP, first, first + WINDOW) ^ keys[passage])
    where = start[passage] + offset
    order = np.lexsort((where, doc[passage], found))
    again = order[1:][found[order[1:]] == found[order[:-1]]]
    return doc[passage[again]], where[again], np.ones(len(again), np.int64)


def _flag(table: pa.Table) -> pa.Table:
    """One part's shards: the words of each text that repeated windows cover, as starts and ends."""
    rows = table.to_pylist()
    keys = np.concatenate([unpack_rising(r["keys"]) for r in rows])
    left, right, counts = (np.concatenate([unpack_numbers(r[k]) for r in rows]).astype(np.int64) for k in ("left", "right", "counts"))
    words = np.concatenate([np.frombuffer(r["words"], np.uint64) for r in rows])
    doc, text = (np.concatenate([np.frombuffer(r[k], np.int64) for r in rows]) for k in ("doc_ids", "doc_texts"))
    base = np.cumsum([0] + [len(r["doc_ids"]) // 8 for r in rows])
    names, rank = np.unique(np.stack([doc, text], 1), axis=0, return_inverse=True)
    place_doc = rank.ravel()[np.concatenate([unpack_numbers(r["docs"]).astype(np.int64) + b for r, b in zip(rows, base[:-1], strict=True)])]
    place_start = np.concatenate([unpack_numbers(r["starts"]) for r in rows]).astype(np.int64)
    del rows
    size = left + right
    begin = np.cumsum(size) - size
    content = mix(_windows(words, STEP, begin, begin + size) + (size * 64 + left).astype(np.uint64))
    windows = size + ANCHOR - WINDOW + 1
    passage = np.repeat(np.arange(len(keys)), counts)
    order = np.lexsort((place_start, place_doc, content[passage], keys[passage]))
    passage, place_doc, place_start = passage[order], place_doc[order], place_start[order]
    k, c = keys[passage], content[passage]
    new_key = np.concatenate([[True], k[1:] != k[:-1]])
    new = new_key | np.concatenate([[True], c[1:] != c[:-1]])
    same = ~new & np.concatenate([[False], (place_doc[1:] == place_doc[:-1]) & (place_start[1:] == place_start[:-1])])
    # all later places of a passage repeat its windows; the place of a repeated row is the same place
    lead = np.flatnonzero(new)
    first_of = np.repeat(lead, np.diff(np.append(lead, len(new))))
    at_first = (place_doc == place_doc[first_of]) & (place_start == place_start[first_of])
    later = np.flatnonzero(~at_first & ~same)
    out = [(place_doc[later], place_start[later], windows[passage[later]])]
    shard = np.cumsum(new_key)[lead]
    passages = np.bincount(shard)[shard]
    large = lead[passages > MOST_PASSAGES]
    if len(large):
        out.append(_windows_seen(words, keys[passage[large]], begin[passage[large]], left[passage[large]], size[passage[large]], place_doc[large], place_start[large]))
    more = np.flatnonzero((passages > 1) & (passages <= MOST_PASSAGES))  # passages whose shard has others
    lead, shard = lead[more], shard[more]
    turn = np.lexsort((place_start[lead], place_doc[lead], shard))
    lead, shard = lead[turn], shard[turn]
    anchor = list(range(-ANCHOR, 0))
    automaton, own, found = Automaton(), -1, []
    last = np.concatenate([shard[1:] != shard[:-1], [True]])[: len(shard)]
    for i, s, final in zip(lead.tolist(), shard.tolist(), last.tolist(), strict=True):
        if s != own:
            automaton, own = Automaton(), s
        p = passage[i]
        a, n = begin[p], left[p]
        sequence = words[a : a + n].tolist() + anchor + words[a + n : a + size[p]].tolist()
        if automaton.next[0]:
            hit = np.flatnonzero(np.array(automaton.matches(sequence)[WINDOW - 1 :]) >= WINDOW)
            for run in np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1) if len(hit) else []:
                found.append((place_doc[i], place_start[i] + run[0], len(run)))
        if not final:
            automaton.add(sequence)
    if found:
        out.append(tuple(np.array(x) for x in zip(*found, strict=True)))
    d, s, n = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((s, d))
    d, s, n = d[order], s[order], n[order]
    cuts = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])) if len(d) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(d))[: len(cuts)]
    places = np.stack([s, s + n + WINDOW - 1], 1).astype(np.uint32)
    return pa.table({"_doc": pa.array(names[d[cuts], 0]), "_text": pa.array(names[d[cuts], 1]), "places": pa.array([places[a:z].tobytes() for a, z in zip(cuts, ends, strict=True)], pa.binary())})


def _covered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges each text's windows to spans of words."""
    for b in batches:
        out = []
        for places in b.column("places").to_pylist():
            start, end = np.frombuffer(b"".join(places), np.uint32).reshape(-1, 2).T
            order = np.argsort(start, kind="stable")
            start, end = start[order], np.maximum.accumulate(end[order])
            new = np.concatenate([[True], start[1:] > end[:-1]])
            last = np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)
            out.append(np.stack([start[new], end[last]], 1).tobytes())
        yield pa.RecordBatch.from_arrays([b.column("_doc"), b.column("_text"), pa.array(out, pa.binary())], ["_doc", "_text", "places"])


def repeated_windows(docs: DataFrame, parts: int | None = None, most_filter: int = MOST_FILTER) -> DataFrame:
    """_doc, _text and places (32-bit starts and ends of the words that repeated windows cover) of the texts that have
    any."""
    spark = docs.sparkSession
    parts = parts or parts_for(docs, PART_BYTES, finer=FINER)
    named = docs.select(*doc_key(), "text")
    passes = repeated_anchors(named, parts, most_filter)
    sent = _sent_by_join(named, parts) if passes is None else named.mapInArrow(thrifty(_sent(parts, spark.sparkContext.broadcast(passes))), SENT)
    flagged = sent.groupBy("part").applyInArrow(thrifty_group(_flag), "_doc bigint, _text bigint, places binary")
    path = shared_folder(spark)
    found = flagged.groupBy("_doc", "_text").agg(F.collect_list("places").alias("places"))
    found.mapInArrow(thrifty(_covered), "_doc bigint, _text bigint, places binary").write.parquet(path)
    return spark.read.parquet(path)


def _kept(w: Words, row: int, places: bytes | None) -> tuple[int, int, bytes]:
    words = w.texts(row)
    if not places:
        return len(words), 0, b" ".join(words)
    kept, at = [], 0
    for start, end in np.frombuffer(places, np.uint32).reshape(-1, 2).tolist():
        kept += words[at:start]
        at = end
    kept += words[at:]
    return len(words), len(words) - len(kept), b" ".join(kept)


def _removed(docs: DataFrame, keep: list[str], digest: bool) -> DataFrame:
    """The rows of docs (as columns.held() names them): the columns `keep`, n_words, n_removed and kept."""
    places = repeated_windows(docs)
    size = places.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("places")), F.lit(0)).alias("bytes")).first()
    if size["n"] <= BROADCAST_ROWS and size["bytes"] <= BROADCAST_BYTES:
        places = F.broadcast(places)
    rows = docs.select(*keep, "text", *doc_key()).join(places, ["_doc", "_text"], "left")
    fields = [docs.schema[c] for c in keep]
    schema = StructType([*fields, StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, w in split(b.column("text")):
                got = [_kept(w, i, b.column("places")[lo + i].as_py()) for i in range(hi - lo)]
                text = [hashlib.sha256(x).hexdigest() if digest else x.decode() for _, _, x in got]
                new = [pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64()), pa.array(text, pa.string())]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, hi - lo) for c in keep), *new], schema.names)

    return rows.select(*keep, "text", "places").mapInArrow(thrifty(run), schema)


def remove(docs: DataFrame, digest: bool = False) -> DataFrame:
    """The rows of docs with n_words, n_removed and kept: the words that are left, joined by one space; if docs has such
    a column, the new one gets an underscore. With digest: doc_id, n_words, n_removed and kept_sha256 only."""
    rows, names = held(docs, "doc_id", "text")
    if digest:
        return _removed(rows.select("doc_id", "text"), ["doc_id"], True).withColumnRenamed("kept", "kept_sha256")
    own = ("n_words", "n_removed", "kept")
    return _removed(rows, names, False).select(*back(docs, names), *(F.col(c).alias(n) for c, n in zip(own, fresh(docs, *own), strict=True)))


def clean(docs: DataFrame) -> DataFrame:
    """docs without repeated windows: text (and n_chars, if there) as kept; rows that lose all their words go."""
    rows, names = held(docs, "doc_id", "text")
    x = _removed(rows, names, False).where("n_removed = 0 or n_removed < n_words")
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("kept")).otherwise(F.col(names[docs.columns.index("text")]))}
    if "n_chars" in docs.columns:
        own = names[docs.columns.index("n_chars")]
        new["n_chars"] = F.when(changed, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(own))
    return x.select(back(docs, names, **new))
