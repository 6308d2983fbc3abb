"""Finding the terms of a vocabulary that is too large to broadcast."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from topograph.functions import beginnings
from topograph.operators import corpus, resolve


def _brute(queries, terms):
    return Counter((i, t) for i, q in queries if q is not None for t in terms if t and t in q)


@pytest.mark.parametrize("few", [beginnings.LENGTHS, 2])
def test_large_vocabulary(spark, monkeypatch, few):
    """Terms of many lengths, in and at the ends of words, with copies, and longer than a query: by all lengths and by few."""
    monkeypatch.setattr(resolve, "FEW_TERMS", 0)
    monkeypatch.setattr(beginnings, "LENGTHS", few)
    monkeypatch.setattr(beginnings, "FILTER_BITS", 16)
    terms = ["", "a", "ab", "abc", "abcabc", "é", "漢字", "of the", "the", "customer 000000001", "customer 000000002", "customer 0000000021", "x" * 90, *(f"n{i}" for i in range(40))]
    queries = [(0, "history of customer 000000002"), (1, "abcabcabc"), (2, None), (3, ""), (4, "café 漢字 x"), (5, "x" * 200), (6, "n1 n39"), (7, "customer 00000000"), (8, "of the abcab"), (9, "history of customer 000000002")]
    q = spark.createDataFrame(queries, "query_id int, q string")
    t = spark.createDataFrame([(x, i) for i, x in enumerate(terms)], "term string, place int")
    plain = resolve.contained(q, "q", t.select("term"), "term").select("query_id", "term").collect()
    assert Counter(map(tuple, plain)) == _brute(queries, terms)
    placed = resolve.contained(q, "q", t.unionByName(t), "term").select("query_id", "term", "place").collect()
    assert Counter((r.query_id, r.term) for r in placed) == Counter({k: 2 * n for k, n in _brute(queries, terms).items()})
    assert all(terms[r.place] == r.term for r in placed)
    assert not resolve.contained(q, "q", t.where("term = ''"), "term").collect()


def test_large_vocabulary_is_not_broadcast(spark, monkeypatch):
    """What is joined is neither every string of every query nor broadcast by a guess of its size."""
    monkeypatch.setattr(resolve, "FEW_TERMS", 0)
    q = spark.range(2000).select(F.col("id").alias("query_id"), F.format_string("history of customer %09d", "id").alias("q"))
    found = resolve.contained(q, "q", q.select(F.substring("q", 12, 18).alias("term")), "term")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    assert found.count() == 2000


def test_few_strings_reach_the_join(spark):
    """Of long queries only the strings that are terms, and no more of a larger vocabulary's."""
    q = spark.range(200).select(F.col("id").alias("query_id"), F.concat(F.repeat(F.lit("words of no file "), 20), F.col("id").cast("string")).alias("q"))
    for n in (2000, 8000):
        terms = spark.range(n).select(F.explode(F.array(F.col("id").cast("string"), F.format_string("%d txt", "id"))).alias("term"))
        lengths = beginnings.lengths_of(terms, "term")
        bits = beginnings.filter_of(terms.select(beginnings.key_of("term", lengths).alias("key")), "key")
        said = [len(r[0]) for r in q.select(beginnings.keys_in(q, "q", lengths, bits)).collect()]
        assert max(said) <= 9 and sum(said) > 200  # numbers of three digits have six strings


def test_filter_grows_with_the_vocabulary(spark):
    """Whatever the number of terms, hardly a string that is none gets through, and every term does."""
    q = spark.range(300).select(F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(300)), lambda i: F.substring(F.md5(F.concat_ws(":", "id", i)), 1, 6))).alias("q"))
    sizes = []
    for n in (20_000, 2_000_000):
        keys = spark.range(n).select(F.xxhash64("id").alias("key"))
        bits = beginnings.filter_of(keys, "key")
        sizes.append(bits.size)
        own = np.array([r.key for r in keys.limit(5000).collect()]).view(np.uint64)
        assert len(beginnings._there(bits, own)) == len(own)
        assert sum(len(r[0]) for r in q.select(beginnings.keys_in(q, "q", [6, 7], bits)).collect()) < 1000  # of 1.2 million strings
    assert sizes == [1 << 17, 1 << 23]


def test_whole_terms_meet_without_texts(spark, monkeypatch):
    """The texts of queries stay out of the join with whole terms; pieces of characters are nothing, not an error."""
    monkeypatch.setattr(resolve, "FEW_TERMS", 0)
    q = spark.createDataFrame([(0, "caf\u00e9 \u6f22\u5b57"), (1, None), (2, "caf\u00e9 caf\u00e9")], "query_id int, q string")
    terms = spark.createDataFrame([("\u00e9",), ("\u6f22",), ("caf",), ("f\u00e9 ",)], "term string")
    found = resolve.contained(q, "q", terms, "term")
    assert found.columns == ["query_id", "q", "term"]
    assert sorted((r.query_id, r.term) for r in found.collect()) == sorted([(0, "\u00e9"), (0, "\u6f22"), (0, "caf"), (0, "f\u00e9 "), (2, "\u00e9"), (2, "caf"), (2, "f\u00e9 ")])
    plan = found.select("query_id", "term")._jdf.queryExecution().executedPlan().toString()
    assert not any("q#" in x for x in plan.splitlines() if "Exchange" in x) and "q#" not in "".join(x for x in plan.splitlines() if "SortMergeJoin" in x)
    everything = beginnings.strings_in(q, "q", [1, 2, 3], np.full(1 << 13, 255, dtype=np.uint8))
    assert q.select(everything.alias("s")).where("array_contains(s, '\u6f22')").count() == 1


def test_parts_are_bounded(spark, monkeypatch):
    """Neither the documents of a file nor the hints of a file's queries are sorted in one task, and nothing is lost."""
    monkeypatch.setattr(corpus, "PART_ROWS", 100)
    monkeypatch.setattr(resolve, "PART_TERMS", 50)
    name = F.concat(F.lit("red "), (F.col("id") % 7).cast("string"))
    documents = spark.range(1000).coalesce(1).select(F.col("id").cast("string").alias("doc_id"), F.concat(name, F.lit(".txt")).alias("filename"), F.format_string("a/%04d", "id").alias("relative_path"), F.create_map(F.lit("kind"), name).alias("levels"), F.array(name).alias("aliases"))
    c = resolve.Catalog.of(documents, ["kind"])
    parts = lambda x: x.rdd.getNumPartitions()
    assert parts(corpus.spread(documents)) == 10 and parts(corpus.spread(documents.limit(100))) == 1
    found = resolve.named_terms(spark.range(500).coalesce(1).select(F.col("id").alias("query_id"), F.concat(name, F.lit(" ?")).alias("norm")), c)
    hints = resolve.hints(found, c)
    assert parts(hints) == 11 and parts(resolve.agreed(found, c)) == 11
    assert sorted((r.query_id, r.rank, r.relative_path) for r in hints.collect()) == [(i, k + 1, f"a/{i % 7 + 7 * k:04d}") for i in range(500) for k in range(4)]
    assert {(r.query_id, r.value) for r in resolve.agreed(found, c).collect()} == {(i, f"red {i % 7}") for i in range(500)}
