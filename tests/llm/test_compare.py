"""SimHash links, source divergence and vector codes against plain versions, with odd rows among the input."""

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from topograph.llm import divergence, graph, simhash, vector_codes

RNG = np.random.default_rng(11)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def say(n, pool=300):
    return " ".join(f"w{i}" for i in RNG.integers(0, pool, n))


def plain_print(text):
    words = WORD.findall((text or "").translate(LOWER))
    found = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in found]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    """Least doc_id that each (doc_id, fingerprint) reaches over links of two bits."""
    prints = sorted({p for _, p in rows})
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            root[p] = p = root[root[p]]
        return p

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 2:
            root[find(a)] = find(b)
    least = {}
    for i, p in rows:
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    return Counter((i, f"{p:016x}", least.get(find(p))) for i, p in rows)


@pytest.fixture(scope="module")
def texts():
    base = [say(n) for n in (40, 90, 200, 600)]
    rows = [None, "", " \t\n", "one", "ONE", "one two", "One  Two", "É é", "a b c d", "x" * 5000, "ab" * 40 + " cd ef gh", say(70_000)]
    for b in base:
        rows += [b, b.upper(), b.replace(" ", " \n")]
        w = b.split()
        rows += [" ".join([*w[:k], f"new{k}", *w[k + 1 :]]) for k in range(0, len(w), max(1, len(w) // 25))]
    ids = [3 * i % 97 for i in range(len(rows))]  # some repeat
    return [(None if i % 19 == 5 else d, t, "n") for i, (d, t) in enumerate(zip(ids, rows, strict=True))]


def test_simhash_rows(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string, node string").repartition(3)
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    want = plain_components([(d, plain_print(t)) for d, t, _ in texts])
    assert got == want
    assert len({c for _, _, c in want}) < len({p for _, p, _ in want}) - 20  # there are links
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def clustered(n, centres, spread):
    """Fingerprints around few centres, so that keys have many nodes."""
    out = set()
    while len(out) < n:
        x = int(centres[RNG.integers(len(centres))])
        for b in RNG.choice(64, RNG.integers(0, spread + 1), replace=False):
            x ^= 1 << int(b)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("bits,segments", [(2, 8), (1, 4), (3, 8), (2, 16), (3, 4)])
def test_simhash_links(spark, bits, segments):
    prints = clustered(1500, RNG.integers(0, 1 << 63, 4, dtype=np.uint64), 5)
    nodes = spark.createDataFrame([(p.to_bytes(8, "big"),) for p in prints], "node binary")
    got = {r.node: r.component for r in graph.components(simhash.links(nodes, bits, segments)).collect()}
    a = np.array(prints, np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= bits
    label = np.arange(len(a))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(a))])
        new = new[new]
        if (new == label).all():
            break
        label = new
    ids = [p.to_bytes(8, "big") for p in prints]
    assert [got.get(x, x) for x in ids] == [ids[i] for i in label]


def test_simhash_large_buckets():
    """Row by row and by looking neighbours up, a bucket has the same components."""
    ring = simhash.Ring()
    open_bits = ring.open[1]
    x = np.unique(np.bitwise_or.reduce(np.left_shift(np.uint64(1), open_bits)[None, :] * RNG.integers(0, 2, (3000, 24)).astype(np.uint64), axis=1))
    label = {}
    for name, medium in (("rows", 1 << 20), ("looked up", 10)):
        simhash.MEDIUM, before = medium, simhash.MEDIUM
        a, b = simhash.linked(x, 1, ring)
        simhash.MEDIUM = before
        root = list(range(len(x)))

        def find(i):
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            assert (x[i] ^ x[j]).item().bit_count() <= 2
            root[find(i)] = find(j)
        by = defaultdict(list)
        for i in range(len(x)):
            by[find(i)].append(i)
        label[name] = sorted(by.values())
    assert label["rows"] == label["looked up"] and len(label["rows"]) < len(x)


def test_pigeonring_misses_nothing():
    """Any two bits apart, a pair shares a key and is viable there."""
    ring = simhash.Ring()
    for i, j in itertools.combinations_with_replacement(range(64), 2):
        d = np.array([(1 << i) | (1 << j)], np.uint64)
        assert any(not (ring.turned(d, s) & ring.mask(h))[0] and len(ring.viable(ring.turned(d, s))) for s in range(8) for h in range(2)), (i, j)


def test_hot_keys_are_told(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(b"hot")).otherwise(F.encode(F.col("id").cast("string"), "utf-8")).alias("k"), "id")
    known = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    got = graph.by_key(rows, known, "k", "n").collect()
    assert sorted((r.id, r.n, r.least) for r in got) == [(i, 1000, 0) if i % 3 == 0 else (i, 1, i) for i in range(3000)]


def plain_audit(rows, least, top):
    docs, counts = Counter(), Counter()
    for lang, source, text in rows:
        found = [x.translate(LOWER) for x in TERM.findall(text or "")]
        docs.update({(lang or "", x) for x in found})
        counts.update((lang or "", source or "", x) for x in found)
    out = set()
    groups = sorted({(a or "", b or "") for a, b, _ in rows})
    for lang in {a for a, _ in groups}:
        kept = sorted(x for (a, x), n in docs.items() if a == lang and n >= least)
        sources = [b for a, b in groups if a == lang]
        total = {s: sum(counts[lang, s, x] for x in kept) for s in sources}
        p = {s: {x: 1 + 10**9 * (counts[lang, s, x] + 5) // (total[s] + 5 * len(kept)) for x in kept} for s in sources}
        q = {x: 1 + 10**9 * (sum(counts[lang, s, x] for s in sources) + 5) // (sum(total.values()) + 5 * len(kept)) for x in kept}
        for s in sources:
            pairs = [(t, sum(abs(p[s][x] - p[t][x]) for x in kept)) for t in sources if t != s]
            apart = [(x, p[s][x] - q[x]) for x in kept if counts[lang, s, x] and p[s][x] > q[x]]
            for part, found, most in (("pair", pairs, None), ("term", apart, top)):
                for k, (item, value) in enumerate(sorted(found, key=lambda v: (-v[1], v[0].encode()))[:most]):
                    out.add((lang, s, part, item, value, k + 1))
    return out


@pytest.mark.parametrize("cells", [divergence.CELLS, 1])
def test_divergence(spark, monkeypatch, cells):
    """Once with one block for each language, once with as many as there can be."""
    monkeypatch.setattr(divergence, "CELLS", cells)
    odd = ["ΑΣ Ünïcode é1é x_y-Z don't 漢字", "", None, "12 34 !", "AB ab Ab aB", "x" * 100_000, "\x00a\x7fb c"]
    rows = []
    for i in range(600):
        pool = "abcdefghij"[: 3 + i % 7]
        text = odd[i % 7] if i % 4 == 0 else " ".join("".join(RNG.choice(list(pool), 2)) for _ in range(i % 60))
        rows.append((["en", "de", None, "rare"][i % 37 % 3 if i else 3], ["s1", "s2", None, "s3", "S3", "é"][i % 11 % 6], text))
    docs = spark.createDataFrame([(k, *r, "t") for k, r in enumerate(rows)], "doc_id long, lang string, source string, text string, term string").repartition(5)
    got = divergence.audit(docs, 12, 7).collect()
    want = plain_audit(rows, 12, 7)
    assert {(r.lang, r.source, r.part, r.item, r.value, r.rank) for r in got} == want and len(got) == len(want)
    assert {x[0] for x in want} == {"en", "de", "", "rare"} - ({"rare"} if not any(x[0] == "rare" for x in want) else set())
    assert divergence.audit(docs.limit(0)).collect() == []


def test_shares_are_exact():
    counts = np.array([[0, 1, 10**15], [7, 0, 0]], np.int64)
    totals = counts.sum(1)
    got = divergence.shares(counts, totals, 3)
    assert got.tolist() == [[1 + 10**9 * (c + 5) // (int(n) + 15) for c in row] for row, n in zip(counts.tolist(), totals, strict=True)]
    with pytest.raises(OverflowError):
        divergence.shares(counts, np.array([1 << 53, 1]), 3)


def plain_codes(rows, entries, rounds):
    kept = [(i, [math.floor(1024 * x) if abs(x) < 2**40 else int(x) * 1024 for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    d = len(kept[0][1]) // 4
    order = sorted(kept, key=lambda r: (r[0] is None, r[0], [x / 1024 for x in r[1]]))
    books = [[r[1][p * d : p * d + d] for r in order[:entries]] for p in range(4)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(4):
            by = defaultdict(list)
            for _, v, _ in kept:
                by[near(v[p * d : p * d + d], books[p])[1]].append(v[p * d : p * d + d])
            for e, x in by.items():
                books[p][e] = [sum(c) // len(x) for c in zip(*x, strict=True)]
    out = []
    for i, v, label in kept:
        found = [near(v[p * d : p * d + d], books[p]) for p in range(4)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(x for x, _ in found), label))
    errors = Counter()
    for _, _, e, label in out:
        errors[label] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return Counter((i, c, e, errors[label], sha) for i, c, e, label in out)


def coded(frame, *more):
    return Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.compress(frame, *more).collect())


@pytest.mark.parametrize("size,kind", [(1, "float"), (0.002, "double"), (3000, "float")])
def test_vector_codes(spark, size, kind):
    """Ties are frequent with small components; 3,000 is beyond what float32 tells apart."""
    rows = [(i, [float(np.float32(x)) for x in RNG.normal(0, size, 12)], [None, 1, 2][i * 7 % 3]) for i in range(300)]
    rows += [(None, rows[4][1], 1), (7, rows[9][1], 2), (8, None, 1), (9, [None] + [0.0] * 11, 1), (10, [float("nan")] * 12, None), (11, [float("inf")] + [1.0] * 11, 3), *rows[20:30]]
    frame = spark.createDataFrame([(*r, "c", 1) for r in rows], f"vec_id long, embedding array<{kind}>, label int, code string, error int").repartition(4)
    assert coded(frame, 1024, 4, 32, 3) == plain_codes(rows, 32, 3)
    assert coded(frame) == plain_codes(rows, 256, 4)
    assert coded(frame.limit(0)) == Counter()


def test_vector_codes_of_few_and_of_large_components(spark):
    rows = [(i, [float(x) for x in v], None) for i, v in enumerate([[1e30, -1e30, 0, 5], [1e30, -1e30, 0, 5], [2.0**60, 1, 2, 3], [-0.5, 0.25, 7, 1e-40]])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    wanted = plain_codes([(i, [float(np.float32(x)) for x in v], n) for i, v, n in rows], 256, 4)
    assert coded(frame) == wanted
    with pytest.raises(ValueError, match="one length"):
        vector_codes.compress(spark.createDataFrame([(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], "vec_id long, embedding array<float>, label int"))


def test_nearest_at_the_edges_of_float32():
    """Many entries within float32's rounding of each other."""
    book = (1 << 22) + RNG.integers(-3, 4, (256, 16))
    v = (1 << 22) + RNG.integers(-3, 4, (500, 16))
    want = ((v[:, None, :] - book[None]) ** 2).sum(2)
    code, error = vector_codes.nearest(v, book)
    assert (code == want.argmin(1)).all() and (error == want.min(1)).all()
