"""Learned models and audio features against plain versions of them, and on rows they haven't seen."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from topograph.llm import audio, langid, toxicity

RNG = np.random.default_rng(5)
MASK = (1 << 64) - 1


def say(n, pool):
    return " ".join(RNG.choice(pool, n).tolist())


def bucket(gram):
    key = 0
    for c in gram:
        key = (key * 0x100000001B3 + ord(c) + 1) & MASK
    h = (key * 4 + len(gram)) & MASK
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & MASK
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & MASK
    return (h ^ (h >> 31)) >> 49


def grams(text):
    t = text.lower()
    return [bucket(t[i : i + n]) for n in (1, 2, 3) for i in range(len(t) - n + 1)]


def test_language_plain(spark):
    """Every prediction and score is that of naive Bayes over counts in dictionaries; rows held out are told right."""
    pools = {"en": ["the", "house", "and", "water", "thing"], "de": ["der", "haus", "und", "wasser", "ding"], "fr": ["le", "maison", "et", "l'eau", "chosé"]}
    rows = [(i, say(12, pools[x]) + (" 12" if i % 4 else "  É!"), x) for i, x in enumerate(RNG.choice(list(pools), 90).tolist())]
    rows += [(200, say(12, pools["de"] + pools["en"]), None), (201, "haus", "de"), (202, "?? 7", "en"), (203, None, "fr"), (204, "maison " * 50_000, "fr")]
    train = [(t, x) for i, t, x in rows if t is not None and x is not None and zlib.crc32(str(i).encode()) % 5]
    langs = sorted({x for _, x in train})
    counts = {x: np.full(1 << 15, 0.1) for x in langs}
    for t, x in train:
        np.add.at(counts[x], np.array(grams(t), int), 1)
    logs = {x: np.log(c / c.sum()) for x, c in counts.items()}
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    right = held = 0
    for i, t, x in rows:
        if t is None or not any(map(str.isalpha, t)):
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        sums = np.array([logs[k][grams(t)].sum() for k in langs])
        p = np.exp(sums - sums.max())
        assert got[i].lang_pred == langs[int(sums.argmax())] and got[i].score == pytest.approx(1 / p.sum(), rel=1e-3)
        if got[i].held_out and x:
            held, right = held + 1, right + (got[i].lang_pred == x)
    assert held >= 10 and right == held


def plain_features(text):
    out, spaces = set(), "\x20\t\n\x0b\x0c\r"
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode()
    word = b""
    for b in low + b" ":
        if b >= 128 or chr(b).isalnum():
            word += bytes([b])
        elif word:
            out |= {("word", word)} | {(k, word[:k]) for k in (4, 6) if len(word) > k}
            word = b""
    token = b""
    for b in low + b" ":
        if chr(b) in spaces:
            out |= {("end", token[-3:])} if token else set()
            token = b""
        else:
            token += bytes([b])
    return out


def plain_fit(sets, y, before):
    n, positive = len(y), y.sum()
    if not 0 < positive < n:
        return set(), {}, math.log((positive + 0.5) / (n - positive + 0.5)), np.zeros(before.shape[1])
    good = {}
    for f in set().union(*sets):
        has = np.array([f in s for s in sets])
        seen, hits = has.sum(), y[has].sum()
        rate = seen / n
        z = (hits / positive - (seen - hits) / (n - positive)) / math.sqrt(rate * (1 - rate) * (1 / positive + 1 / (n - positive)) + 1e-12)
        if seen >= 3 and abs(z) >= 4:
            good[f] = has
    names = list(good)
    x = np.column_stack([*(good[f].astype(float) for f in names), before, np.ones(n)])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], 0.1)
    penalty[-1] = 1e-6
    for _ in range(200):  # damped Newton steps to the same optimum
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
    return names, dict(zip(names, w)), w[-1], w[len(names) : -1]


def plain_odds(model, sets, before):
    _, weights, bias, earlier = model
    return np.array([sum(weights.get(f, 0.0) for f in s) for s in sets]) + bias + before @ earlier


def test_toxicity_plain(spark):
    """The chain's probabilities are those of logistic models over sets of features, trained with out-of-fold odds."""
    pool = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(240):
        low, toxic = i % 3 == 0, i % 3 == 0 and i % 2 == 0 or i % 7 == 0
        t = say(14, pool) + (" Buy-now!! spammy" if low and i % 5 else "") + (" vileword. nasty" if toxic and i % 11 else "")
        rows.append((i, t, int(not low), int(toxic)))
    d = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    train = [r for r in rows if r[0] < 180]
    sets = [plain_features(t) for _, t, *_ in train]
    before, chain = np.zeros((len(train), 0)), []
    for k in range(2):
        y = np.array([1 - r[2] if k == 0 else r[3] for r in train], float)
        chain.append(plain_fit(sets, y, before))
        if k == 0:
            out = np.zeros(len(y))
            for f in range(5):
                own = np.arange(len(y)) % 5 == f
                model = plain_fit([s for s, o in zip(sets, own) if not o], y[~own], before[~own])
                out[own] = plain_odds(model, [s for s, o in zip(sets, own) if o], before[own])
            before = np.clip(out, -8, 8)[:, None]
    want, odds = [plain_features(t) for _, t, *_ in rows], np.zeros((len(rows), 0))
    for model in chain:
        odds = np.column_stack([odds, np.clip(plain_odds(model, want, odds), -8, 8)])
    p = 1 / (1 + np.exp(-odds))
    got = {r.doc_id: r for r in toxicity.predict(d, toxicity.train(d, toxicity.labelled(d.where("doc_id < 180")))).collect()}
    for i in range(len(rows)):
        assert (got[i].p_low_quality, got[i].p_toxic) == pytest.approx(p[i], abs=1e-4)
    held = [(got[i].p_toxic >= 0.5) == bool(rows[i][3]) for i in range(180, 240) if not rows[i][3] or "vileword" in rows[i][1]]
    assert np.mean(held) > 0.95


def test_toxicity_repeated_ids(spark):
    """One text stands for the rows that share a doc_id, so neither the partitions nor the number of repeats change the chain."""
    rows = [(i // 2, say(10, ["a1", "b2", "c3"]) + (" vile" if i % 4 == 0 else ""), 1, int(i % 4 == 0)) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    labels = spark.createDataFrame([(i, i % 2, i % 3 // 2) for i in range(100)], "doc_id long, low_quality int, toxic int")
    many = d.unionByName(d.where("doc_id = 3").withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(3000)))).drop("_n"))
    first = toxicity.train(d.groupBy("doc_id").agg(F.min("text").alias("text")), labels)
    for other in (toxicity.train(d.repartition(7), labels), toxicity.train(many, labels.unionByName(labels))):
        assert all((x.keys == y.keys).all() and np.allclose(x.weights, y.weights) and x.bias == pytest.approx(y.bias) for x, y in zip(first, other))


def plain_log_mel(samples):
    """Zero-stuffing, one long filter, and a discrete Fourier transform by its definition."""
    x = (np.frombuffer(samples, np.uint8).astype(float) - 128) / 128
    x -= x.mean()
    taps = 48
    h = np.array([np.sinc((j - (taps - 1) / 2) / 4) * (0.5 - 0.5 * math.cos(2 * math.pi * (j + 1) / (taps + 1))) for j in range(taps)])
    h *= 3 / h.sum()
    stuffed = np.zeros(3 * len(x))
    stuffed[::3] = x
    full = np.convolve(stuffed, h)
    y = np.array([full[m] if m < len(full) else 0.0 for m in range(0, 4 * -(-len(x) * 3 // 4), 4)])
    n = max(1, -(-(len(y) - 256) // 128) + 1)
    y = np.concatenate([y, np.zeros((n - 1) * 128 + 256 - len(y))])
    t = np.arange(256)
    basis = np.exp(-2j * math.pi * np.outer(np.arange(129), t) / 256)
    window = 0.5 - 0.5 * np.cos(2 * math.pi * t / 255)
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    edges = [700 * (10 ** (mel(3000) * k / 25 / 2595) - 1) for k in range(26)]
    bank = np.array([[max(0.0, min((f - a) / (b - a), (c - f) / (c - b))) for a, b, c in zip(edges, edges[1:], edges[2:])] for f in (6000 * k / 256 for k in range(129))])
    return np.array([10 * np.log10(np.abs(basis @ (y[128 * k : 128 * k + 256] * window)) ** 2 @ bank + 1e-8) for k in range(n)])


@pytest.mark.parametrize("text", ["", "Hello there, é漢 " * 40, "a" * 3000 + " loud LOUD ~~~~ " * 60 + "b" * 900])
def test_audio_plain(text):
    raw = audio.payload(text)[1]
    want = plain_log_mel(raw)
    x = audio.analyse(audio.write_wav(raw))
    assert x["logs"].shape == want.shape and np.abs(x["logs"] - want).max() < 0.05
    level, open_, spans = want.mean(1) - np.median(want.mean(1)), None, []
    for k, v in enumerate([*level, -99.0]):
        if open_ is None and v >= 3 and k < len(level):
            open_ = k
        elif open_ is not None and v < -3:
            spans.append((open_ * 128 / 6000, k * 128 / 6000))
            open_ = None
    got = [(a, z) for a, z in x["segments"]]
    assert np.allclose(np.array(got).reshape(-1, 2), np.array(spans).reshape(-1, 2))
    feature = audio.describe(text)["feature"]
    shape, mean, loud, _ = feature.split(" ")
    assert shape == f"{len(want)}x24" and abs(float(mean.removeprefix("mean=")) - want.mean()) < 0.02 and loud.startswith(f"loud={len(spans)}/")
