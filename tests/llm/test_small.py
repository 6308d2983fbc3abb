"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, no rows, and extra columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F
from public_tokenizers import PATTERN, path
from tokenizers import Tokenizer

from topograph.llm import audio, bpe, graph, jaccard, langid, mixing, packing, scoring, substrings, token_file, topk, toxicity
from topograph.llm.words import ngrams, split

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = np.random.default_rng(7)
POOL = [f"w{i}" for i in range(400)]


def say(n, pool=POOL):
    return " ".join(RNG.choice(pool, n).tolist())


BASE, PASSAGE = say(120), say(60)
NEAR = " ".join(["changed" if i == 60 else w for i, w in enumerate(BASE.split())])
TEXTS = [
    (1, BASE), (2, BASE), (3, NEAR), (4, None), (5, ""), (6, " \t\n "), (7, "one two"), (8, "one two"), (9, "only"), (10, say(30) + " " + PASSAGE), (11, PASSAGE + " " + say(15)),
    (12, "same " * 70), (13, say(3000)), (14, "Ünïcode don't 's     x y 12 ½ 漢字 👍🏽 <|endoftext|> é ΑΣ"), (15, "x" * 5000), (16, say(20) + "\x0b" + say(5)), (2, BASE), (None, say(8)), (-3, "a b c d e f"), (17, "a b c d e f"), (18, say(70_000)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", None, "de"][k % 3], ["s1", None, "s2"][k % 3], 0, "_part") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, part string").repartition(3).persist()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def words(t):
    return WORD.findall(t or "")


def rows_by_id(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_words():
    import pyarrow as pa

    for limit in (1, 40, 1 << 18):
        got = [w.texts(i) for _, _, w in split(pa.array([t for _, t in TEXTS]), limit) for i in range(len(w.offsets) - 1)]
        assert got == [[x.encode() for x in words(t)] for _, t in TEXTS]
    w = next(split(pa.array(["a b c a b c d"])))[2]
    h, first, offsets = ngrams(w.hashes(), w.offsets, 3)
    assert h[0] == h[3] and len(set(h.tolist())) == 4 and first.tolist() == [0, 1, 2, 3, 4] and offsets.tolist() == [0, 5]


def signs(n, swap=False):
    """n letters a and b in an order whose complement has the same value in any polynomial modulo 2**64 with an odd base."""
    return "".join("ab"[bin(i).count("1") % 2 ^ swap] for i in range(n))


def test_words_of_one_pattern_differ(spark):
    """Words that polynomial hashes can't tell apart: nothing is removed, linked or counted together."""
    import pyarrow as pa

    a, b = signs(1024), signs(1024, True)
    w = next(split(pa.array([f"{a} {b} {a}x {a[:70]} {a[:69]}c"])))[2]
    assert len(set(w.hashes().tolist())) == 5 and w.hashes(3)[0] == w.hashes(3)[2] != w.hashes(3)[1]
    tail = [f"t{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, " ".join([x, *tail[:19]])) for i, x in enumerate((a, b))], "doc_id long, text string")
    assert [r.n_removed for r in substrings.remove(docs, digest=True).collect()] == [0, 0]
    pair = spark.createDataFrame([(0, " ".join([a] * 8)), (1, " ".join([b] * 8))], "doc_id long, text string")
    assert [r.n_links for r in jaccard.near_duplicates(pair).collect()] == [0, 0]
    got = {r.doc_id: r.logprob for r in scoring.score_corpus(pair.unionByName(spark.createDataFrame([(2, f"{a} x {a}")], "doc_id long, text string"))).collect()}
    assert got[0] > got[1]  # only a was seen elsewhere


def test_jaccard_of_rows_without_doc_id(spark):
    """Many rows of two near texts without doc_id are two nodes."""
    base = say(200)
    other = " ".join(["new", *base.split()[1:]])
    docs = spark.createDataFrame([(None, base), (None, other)] * 2500 + [(7, base), (7, base)], "doc_id long, text string").repartition(4)
    got = Counter(tuple(r) for r in jaccard.near_duplicates(docs).collect())
    assert got == {(None, 7, 5001): 5000, (7, 7, 5001): 2}


def test_chains_end(spark):
    """A chain of 200 nodes, each linked with the next only, is one component after about as many rounds as 200 has bits."""
    edges = spark.createDataFrame([(f"{i:03d}".encode(), f"{i + 1:03d}".encode()) for i in range(200)], "a binary, b binary")
    assert {r.component for r in graph.components(edges).collect()} == {b"000"}


def test_packing():
    for x in ([], [0], [127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28 - 1]):
        assert packing.unpack_numbers(packing.pack_numbers(np.array(x, np.int64))).tolist() == x
    for x in ([2**28], [-1]):
        with pytest.raises(OverflowError):
            packing.pack_numbers(np.array(x, np.int64))
    keys = np.sort(RNG.integers(0, 2**64, 500, dtype=np.uint64))
    assert (packing.unpack_rising(packing.pack_rising(keys)) == keys).all()


def test_bpe(docs, none):
    ranks = bpe.read_ranks()
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows_by_id(bpe.digests(docs))
    assert sum(map(len, got.values())) == len(TEXTS)
    for i, t in TEXTS:
        ids = np.array(enc.encode_ordinary(t or ""), np.uint32)
        for r in got[i]:
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert all(bytes(r.bytes).decode() == (dict(TEXTS)[r.doc_id] or "") for r in bpe.decode(bpe.encode(docs)).collect())
    assert bpe.digests(none).count() == 0


def test_language(docs, none, spark):
    rows = [(i, say(40, ["the", "and", "house"] if i % 2 else ["der", "und", "haus"]), ["de", "en"][i % 2]) for i in range(60)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame([*rows, (100, "123 !!", None), (101, None, "en"), (102, "", "xx"), (103, "der und", None)], "doc_id long, text string, lang string")).collect()}
    assert all(got[i].lang_pred == x and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, x in rows)
    assert [got[i].lang_pred for i in (100, 101, 102, 103)] == ["und", "und", "und", "de"] and got[100].score == 0
    assert langid.identify(docs).count() == len(TEXTS)
    assert langid.identify(none).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.train(none)).collect()} == {"und"}
    with pytest.raises(ValueError):
        langid.train(docs, max_languages=1)


def test_audio(docs, none):
    got = rows_by_id(audio.digests(docs))
    for i, t in TEXTS:
        raw = (t or "").encode()
        full = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        for r in got[i]:
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:])) and r.media_bytes == 44 + len(full)
    assert got[7][0].feature == got[8][0].feature and got[4][0].feature == got[5][0].feature
    assert audio.digests(none).count() == 0
    r = audio.media(docs.where("doc_id = 13")).first()
    start, end, tensors = audio.read_tensors(bytes(r.tensors))
    assert tensors.shape[1:] == (audio.TENSOR_FRAMES, audio.MELS) and (start[1:] == end[:-1]).all()
    assert audio.read_wav(bytes(r.media))[1][: len(TEXTS[12][1])] == TEXTS[12][1].encode()
    tone = np.sin(np.arange(8000) * 2 * np.pi * 440 / 8000).astype(np.float32)
    spectrum = np.abs(np.fft.rfft(audio.resample(tone)))
    assert len(audio.resample(tone)) == 6000 and abs(int(spectrum.argmax()) - 440) <= 1  # one second, so bins are Hz
    assert audio.segments(np.array([0, 4, 1, -1, -4, 4, 0.0])) == [(1, 4), (5, 7)] and audio.segments(np.zeros(3)) == []


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def test_jaccard(docs, none):
    near = lambda a, b: bool(a and b) and len(a & b) * 9 >= 4 * (len(a) + len(b))
    sets = [shingles(t) for _, t in TEXTS]
    order = list(range(len(TEXTS)))
    group = order[:]
    for i in order:
        for j in order[:i]:
            if near(sets[i], sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    least = {g: min((TEXTS[i][0] for i in order if group[i] == g and TEXTS[i][0] is not None), default=None) for g in group}
    want = Counter((TEXTS[i][0], least[group[i]], sum(near(sets[i], sets[j]) for j in order if j != i)) for i in order)
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard.near_duplicates(docs).collect()) == want
    assert jaccard.near_duplicates(none).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14, 15, 16, 18, None, -3]))


def test_jaccard_family(spark):
    """A family of near copies larger than a bucket's small case, and one that shares half of its words."""
    base = say(200).split()
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i, k in enumerate(RNG.integers(0, 200, 90).tolist())]
    rows += [(1000 + i, " ".join(base[:70]) + " " + say(100)) for i in range(40)]
    sets = {i: shingles(t) for i, t in rows}
    want = {i: sum(j != i and len(a & b) * 9 >= 4 * (len(a) + len(b)) for j, b in sets.items()) for i, a in sets.items()}
    got = {r.doc_id: r for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.n_links for i, r in got.items()} == want
    assert jaccard.least_matches(0.8, 1e-6) == sorted(jaccard.least_matches(0.8, 1e-6))


def test_jaccard_recall(spark):
    """Pairs of texts a little over the threshold: all are found (a pair is missed with probability 1.1e-5)."""
    rows, want = [], 0
    for i in range(1500):
        a = [f"{x}" for x in RNG.integers(0, 10**6, 204)]
        b = list(a)
        for k in RNG.choice(200, 4 + i % 3, replace=False):
            b[k] = "z"
        x, y = shingles(" ".join(a)), shingles(" ".join(b))
        want += len(x & y) * 9 >= 4 * (len(x) + len(y))
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert want > 500 and got.where("n_links = 1").count() == 2 * want


def test_jaccard_trees():
    line = np.arange(1, 5000)
    edges = graph.tree(0, line)
    assert len(edges) == 4999 and max(Counter(x for e in edges for x in e).values()) <= graph.FAN + 1
    parent = {j: i for i, j in edges}
    assert all(parent[j] < j for j in line.tolist())


def test_jaccard_null_ids(spark):
    """Near copies without a doc_id link to each other and to those with one."""
    base, other = say(150).split(), say(150).split()
    near = lambda words, k: " ".join(words[:k] + [f"y{k}"] + words[k + 1 :])
    rows = [(None, near(base, 10)), (None, near(base, 70)), (5, near(base, 140)), (None, near(other, 20)), (None, near(other, 120)), (None, near(other, 20))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard.near_duplicates(d).collect())
    assert got == Counter({(None, 5, 2): 2, (5, 5, 2): 1, (None, None, 2): 3})
    kept = [tuple(r) for r in jaccard.keep_one(d).collect()]
    assert len(kept) == 2 and rows[2] in kept and (rows[3] in kept or rows[4] in kept)


def test_mixing(docs, none, spark):
    rows = [(i, say(10), f"s{min(i % 10, 3)}") for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    n, tokens = Counter(), Counter()
    for r in mixing.mix(d, max_repeats=1.5).collect():
        n[r.doc_id] += 1
        tokens[r.source] += len(words(r.text))
    assert set(n) == set(range(400)) and max(n.values()) <= 2
    assert tokens["s3"] == 280 * 10 and all(580 <= tokens[s] <= 600 for s in ("s0", "s1", "s2"))
    got = Counter()
    for r in mixing.mix(d, min_entropy=math.log(4), budget=4000).collect():
        got[r.source] += 10
    assert all(abs(got[s] - 1000) <= 10 for s in ("s0", "s1", "s2", "s3"))
    order = mixing.mix(d).orderBy("_pass", "_at_block", "_at_slot").where("_pass = 1").collect()
    assert [r.doc_id for r in order] != sorted(r.doc_id for r in order)
    x = mixing.mix(docs)
    assert x.columns[: len(docs.columns)] == docs.columns and {r.doc_id for r in x.collect()} == {i for i, _ in TEXTS}
    assert mixing.mix(none).count() == 0


def without_repeats(texts):
    """n_words, n_removed and the digest of what is kept, by (doc_id, text), window by window."""
    listed = sorted({(i if i is not None else -(1 << 63), t or "") for i, t in texts})
    seen, want = set(), {}
    for i, t in listed:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return want


def test_substrings_of_a_phrase(spark):
    """A phrase of ten to thirty words in many texts, among ever other words; some of what is around it is repeated, too."""
    phrase = say(30, [f"p{i}" for i in range(1000)]).split()
    rows = []
    for i in range(600):
        n = 10 + i % 21
        around = say(12, [f"z{i % 9 if i % 3 else i}"]) if i % 2 else say(12)
        rows.append((i, " ".join([around, *phrase[:n], say(15, POOL[:3] if i % 5 == 0 else POOL)])))
    want = without_repeats(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    found = [{(r["_doc"], bytes(r["places"])) for r in substrings.repeated_windows(d, parts, most).collect()} for parts, most in ((None, 1 << 29), (3, 1 << 29), (3, 0), (50, 0))]
    assert {i for i, _ in found[0]} == {i for i, x in want.items() if x[1]} and all(x == found[0] for x in found)  # 0: no filter, but the join
    got = substrings.remove(d, digest=True).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want and sum(x[1] > 0 for x in want.values()) > 100


def test_substrings(docs, none, spark):
    want = without_repeats(TEXTS)
    got = substrings.remove(docs, digest=True).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id if r.doc_id is not None else -(1 << 63)]
    assert want[2][1] == 120 and want[11][1] == 60 and want[12][1] == 70 - 1
    assert substrings.remove(none, digest=True).count() == 0
    cleaned = {r.doc_id: r for r in substrings.clean(docs).collect()}
    assert 2 not in cleaned and cleaned[4].text is None and cleaned[12].text == "same" and cleaned[12].n_chars == 4 and cleaned[13].text == dict(TEXTS)[13]


#: Names that operators use inside or add.
OWN = "_c0 _c1 _node _other _doc _text _source _block _slot _pass _at_block _at_slot _salt _passes _cut_block _cut_slot _turn_block _turn_slot n_removed n_words kept places node doc term component stays repeats rep lead band place ids bytes words keys p_toxic score shard logprob".split()


def test_clashing_columns(docs, none, spark):
    """Input columns with the operators' own names come back as they were."""
    more = docs.select(*docs.columns, *(F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in OWN))
    plain = Counter(map(tuple, jaccard.keep_one(docs).collect()))
    chain = toxicity.train(docs, docs.selectExpr("doc_id", "0 as low_quality", "0 as toxic"))
    for run, want in ((jaccard.keep_one, plain), (substrings.clean, None), (lambda d: mixing.mix(d).select(*d.columns), None), (lambda d: toxicity.reject(d, chain), None), (substrings.remove, None)):
        for frame in (more, more.limit(0)):
            got = run(frame)
            assert got.columns[: len(more.columns)] == more.columns
            rows = [r.asDict() for r in got.select(*more.columns).collect()]
            assert all(r[c] == (None if r["doc_id"] is None else f"{c}:{r['doc_id']}") for r in rows for c in OWN)
            if want and frame is more:
                assert Counter(tuple(r[c] for c in docs.columns) for r in rows) == want
    for run in (jaccard.near_duplicates, bpe.digests, langid.identify, audio.digests, token_file.round_trip, scoring.score_corpus):
        assert Counter(map(tuple, run(more).collect())) == Counter(map(tuple, run(docs).collect()))
    x = mixing.mix(more)
    assert x.columns[-3:] == ["__pass", "__at_block", "__at_slot"]


def test_automaton():
    for _ in range(50):
        seqs = [RNG.integers(0, 3, RNG.integers(1, 12)).tolist() for _ in range(3)]
        a = substrings.Automaton()
        for s in seqs:
            a.add(s)
        query = RNG.integers(0, 3, 15).tolist()
        there = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i, len(s) + 1)}
        want = [max(n for n in range(k + 2) if tuple(query[k + 1 - n : k + 1]) in there) for k in range(len(query))]
        assert a.matches(query) == want


def test_token_files(docs, none, spark, tmp_path):
    t = Tokenizer.from_file(path("word_bpe_49k.json"))
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], np.uint32) for i, x in TEXTS}
    want, at = [], 0
    for i in sorted((i for i, _ in TEXTS), key=lambda i: (i is not None, i)):
        want.append((i, at, len(ids[i]), zlib.crc32(ids[i].tobytes())))
        at += len(ids[i])
    assert sorted(map(tuple, token_file.round_trip(docs, parts=4).collect()), key=lambda r: r[1]) == want
    assert token_file.round_trip(none).count() == 0
    token_file.write(token_file.encode(docs), str(tmp_path / "one"), np.zeros(0, np.int64))
    f = token_file.TokenFile(bytes(spark.read.parquet(str(tmp_path / "one")).first().file))
    assert f.doc_ids() == [w[0] for w in want] and all(f.document(k).tolist() == ids[w[0]].tolist() for k, w in enumerate(want))


def test_token_files_of_large_ids(spark):
    """doc_ids that a double can't tell apart, without any, and more ranges than documents."""
    rows = [(i, "a b c"[: k % 6]) for k, i in enumerate([2**62, 2**62 + 1, 2**62 + 2, -(2**62), None, None, 5, 4])]
    got = token_file.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), parts=20).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, -(2**62), 4, 5, 2**62, 2**62 + 1, 2**62 + 2]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))


def test_elias_fano():
    for values in ([], [0], [0, 0, 5, 5, 1000], np.cumsum(RNG.integers(0, 300, 3000)).tolist(), [2**40]):
        data = token_file.EliasFano.encode(np.array(values, np.uint64)).to_bytes()
        e, used = token_file.EliasFano.from_bytes(memoryview(data))
        assert used == len(data) and e.all().tolist() == values and [e.select(i) for i in range(0, len(values), 7)] == values[::7]
        assert all(e.span(lo, hi).tolist() == values[lo:hi] for lo in range(0, len(values), 211) for hi in (lo, min(lo + 1, len(values)), min(lo + 300, len(values)), len(values)))
    assert len(data) < 200
    with pytest.raises(IndexError):
        e.select(1)


def test_toxicity(docs, none, spark):
    rows = [(i, say(30) + (" " + " ".join(["nasty", "vileword"][: 1 + i % 2] * 2) if i % 4 == 0 else ""), int(i % 3 > 0), int(i % 4 == 0)) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    labels = toxicity.labelled(d.where("doc_id < 300").unionByName(d.limit(1).selectExpr("doc_id", "text", "null as quality", "toxic")))
    chain = toxicity.train(d, labels)
    p = {r.doc_id: r.p_toxic for r in toxicity.predict(d, chain).collect()}
    assert all((p[i] >= 0.5) == (i % 4 == 0) for i in range(300, 400))
    assert len(chain[1].earlier) == 1
    assert toxicity.predict(docs, chain).count() == len(TEXTS) and toxicity.predict(none, chain).count() == 0
    kept = toxicity.reject(d.withColumnRenamed("quality", "p_toxic"), chain)
    assert kept.columns == ["doc_id", "text", "p_toxic", "toxic"] and kept.count() == 300
    assert toxicity.reject(docs, toxicity.train(docs, labels.limit(0))).count() == len(TEXTS)


def test_toxicity_endings():
    """A word has the feature of its ending also without punctuation after it."""
    import pyarrow as pa

    w = next(split(pa.array(["madly", "sadly", "said madly there", ""])))[2]
    rows, keys = toxicity.features(w)
    own = [set(keys[rows == i].tolist()) for i in range(4)]
    assert len(own[0] & own[1]) == 1 and own[0] & own[1] <= own[2] and not own[3]


def backed_off(texts, order):
    """Each text's words and log probability by the counts of the other texts, n-gram by n-gram."""
    grams = lambda w: Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    own = [grams(words(t)) for t in texts]
    f, total = sum(own, Counter()), sum(len(words(t)) for t in texts)
    out = []
    for t, mine in zip(texts, own):
        w, rest, sum_ = words(t), max(1, total - len(words(t))), 0.0
        for i in range(len(w)):
            for n in range(min(order, i + 1), 0, -1):
                g = tuple(w[i + 1 - n : i + 1])
                if n == 1:
                    sum_ += math.log(max(1, f[g] - mine[g]) / rest)
                elif f[g] > mine[g]:
                    sum_ += math.log((f[g] - mine[g]) / (f[g[:-1]] - mine[g[:-1]]))
                    break
                else:
                    sum_ += math.log(0.4)
        out.append((len(w), sum_))
    return out


@pytest.mark.parametrize(("order", "block", "parts"), [(1, 1 << 20, None), (2, 1 << 20, None), (2, 50, 7), (3, 300, 3)])
def test_scoring(docs, none, order, block, parts):
    for frame in (docs, docs.limit(0).unionByName(docs.where("doc_id = 10"))):
        held = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
        want = Counter((i, n, round(x, 3), round(x / n, 6) if n else None) for (i, _), (n, x) in zip(held, backed_off([t for _, t in held], order)))
        got = Counter((r.doc_id, r.n_words, round(r.logprob, 3), None if r.score is None else round(r.score, 6)) for r in scoring.score_corpus(frame, order, parts, block).collect())
        assert got == want
    assert scoring.score_corpus(none).count() == 0


def test_packed_counts():
    x = np.array([0, 1, 2**28 - 1, 2**28, 2**40])
    assert scoring._unpacked_counts(scoring._packed_counts(x)).tolist() == x.tolist()


def test_scoring_of_other_texts(spark):
    corpus = spark.createDataFrame([("a b c a b",), ("b c d",)], "text string")
    x = {r.doc_id: r for r in scoring.score(spark.createDataFrame([(1, "a b c"), (2, "a d z"), (3, None)], "doc_id long, text string"), scoring.count_tables(corpus, 3)).collect()}
    assert x[1].logprob == pytest.approx(math.log(2 / 8) + math.log(2 / 2) + math.log(1 / 2))
    assert x[2].logprob == pytest.approx(math.log(2 / 8) + math.log(0.4 * 1 / 8) + 2 * math.log(0.4) + math.log(1 / 8)) and x[3].n_words == 0


def test_scoring_by_row(spark):
    """Rows that share a doc_id, or have none, are scored each."""
    tables = scoring.count_tables(spark.createDataFrame([("a b c a b",), ("b c d",)], "text string"), 2)
    rows = [(1, "a b"), (1, "d"), (1, "d"), (None, "a b"), (None, None)]
    got = Counter((r.doc_id, r.n_words, round(r.logprob, 9)) for r in scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), tables).collect())
    ab, d = round(math.log(2 / 8), 9), round(math.log(1 / 8), 9)
    assert got == Counter({(1, 2, ab): 1, (1, 1, d): 2, (None, 2, ab): 1, (None, 0, 0.0): 1})


def test_top_k(spark):
    v = [(i, [float(x) for x in RNG.normal(0, 0.2, 8)]) for i in range(300)] + [(300 + i, [0.5] * 8) for i in range(30)] + [(400, None), (420, [float("nan")] * 8), (440, [None] * 8), (460, [0.0] * 8), (480, [0.25] * 3), (500, [])]
    d = spark.createDataFrame([(i, x, 0) for i, x in v], "vec_id long, embedding array<float>, label int")
    q = {i: [math.floor(64 * float(np.float32(c))) for c in x] for i, x in v if x is not None and all(c is not None and math.isfinite(c) for c in x)}
    want = {}
    for i, a in q.items():
        if i % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), j) for j, b in q.items() if j != i)[:20]
            want |= {(i, k + 1): (j, -s) for k, (s, j) in enumerate(scored)}
    for rows, tile in ((1 << 14, 512), (50, 4)):
        x = d.select(topk.F.col("vec_id").alias("id"), topk.usable(topk.F.col("embedding")).alias("v")).where("v is not null")
        got = topk.top_k(x, x.where("id % 20 = 0"), 20, shard_rows=rows, tile_rows=tile)
        assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got.collect()} == want
    assert topk.search_embeddings(d.limit(0)).count() == 0
    assert topk.search_embeddings(d.where("vec_id = 0 or vec_id = 7")).count() == 1


def ranked(rows, k=20):
    """Top k by Python's integers: each id's smallest vector asks, every row of another id is a candidate."""
    whole = lambda v: [int(c) * 64 if abs(c) >= 2**60 else math.floor(c * 64) for c in v]
    rows = [(i, v) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    first, out = {}, []
    for i, v in rows:
        first[i] = min(first.get(i, v), v)
    for i, v in first.items():
        if i % 20 == 0:
            got = sorted((-sum(a * b for a, b in zip(whole(v), whole(w))), j) for j, w in rows if j != i)[:k]
            out += [(i, n + 1, j, max(-(2**63), min(2**63 - 1, -s))) for n, (s, j) in enumerate(got)]
    return Counter(out)


def test_top_k_of_long_vectors(spark):
    """Components and sums of any size, repeated ids, and columns named as the operator's own."""
    kind = "vec_id long, embedding array<double>, id long, v array<double>, shard int, tile int, beyond string, score long"
    more = (7, [0.0], 3, 4, "x", 5)
    full = [(2**24 - 1) / 64] * 128
    sets = [
        [(0, [300000.0, 1.0]), (1, [1.0, 2.0]), (2, [-300000.0, 3.0]), (20, [5.0])],
        [(0, [-1e30, 1.0]), (1, [1.0, 2.0]), (2, [1e30, -2.0]), (3, [1e30, -1.0]), (20, [-1e300, 1e300]), (21, [1e300, 1e300]), (40, [1.5, -0.1])],
        [(20 * i, [x + i / 64 for x in full]) for i in range(3)] + [(7, full), (9, [-x for x in full]), (11, full[:60])],
        [(0, [0.5, 0.5]), (0, [0.25, 0.5]), (0, [0.5, 0.5]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (20, [2.0, -1.0]), (3, None), (4, [None, 1.0]), (5, [float("inf"), 0.0]), (None, [1.0, 1.0])],
        [(i, [float(x) for x in RNG.normal(0, 2.0 ** (i % 50), 6)]) for i in range(200)],
        [(i, [float(2**20 + i % 3 - 1), float(RNG.integers(-3, 3)), 0.5]) for i in range(120)],
    ]
    for rows in sets:
        d = spark.createDataFrame([(*r, *more) for r in rows], kind)
        got = Counter(map(tuple, topk.search_embeddings(d).collect()))
        assert got == ranked([r for r in rows if r[0] is not None])


def test_top_k_stops_on_proof():
    """Small postings aren't visited where the large ones decide."""
    v = np.clip(np.round(RNG.standard_t(2, (2000, 16)) * 8), -3000, 3000).astype(np.int64)
    shard, walked = topk.Shard.from_bytes(topk.Shard(np.arange(2000), topk._narrow(v)).to_bytes()), []
    got = {i: (s.tolist(), j.tolist()) for i, s, j in topk.search(shard, np.arange(100), v[:100], 10, walked)}
    for i in range(100):
        want = sorted((-int(v[i] @ v[j]), j) for j in range(2000) if j != i)[:10]
        assert got[i] == ([-x for x, _ in want], [j for _, j in want])
    assert sum(walked) < 0.9 * 100 * np.count_nonzero(v)


def test_components_of_edges_that_come_in_another_order_each_time(spark):
    """Tasks may find another spanning forest when they run again; the components have to be the same."""
    import pyarrow as pa

    def forest(batches):
        for b in batches:
            ids = b.column("id").to_pylist()
            np.random.default_rng().shuffle(ids)
            yield pa.RecordBatch.from_pydict({"a": pa.array([str(i).encode() for i in ids[:-1]], pa.binary()), "b": pa.array([str(i).encode() for i in ids[1:]], pa.binary())})

    got = graph.components(spark.range(0, 300, 1, 1).mapInArrow(forest, "a binary, b binary")).collect()
    assert len(got) == 300 and len({bytes(r.component) for r in got}) == 1
