import hashlib
import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from topograph.functions import identity
from topograph.functions import text as T
from topograph.functions.confidence import Thresholds, forwarded, should_answer, tier
from topograph.plans import filters


def values(spark, column, rows, kind="string"):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in frame.orderBy("i").select(column).collect()]


@settings(max_examples=5, deadline=None)
@given(rows=st.lists(st.text(max_size=30), min_size=1, max_size=30))
def test_normalize_like_python(spark, rows):
    want = [" ".join(re.sub("[^a-z0-9]+", " ", r.lower()).split()) for r in rows]
    clean = [r for r in rows if r.lower().isascii()]
    assert values(spark, T.normalize(F.col("x")), clean) == [w for r, w in zip(rows, want) if r.lower().isascii()]


def test_text_functions(spark):
    assert values(spark, T.strip(F.col("x")), ["  \t q \n", "", " a b "]) == ["q", "", "a b"]
    assert values(spark, T.display_name(F.col("x")), ["my_file-a.b.txt", "plain"]) == ["my file a.b", "plain"]
    assert values(spark, T.titles(F.array("x")), ["operator_manual", "Dwr-Mkiii"]) == [["Operator_Manual"], ["Dwr-Mkiii"]]
    assert values(spark, T.aliases(F.col("x"), F.array(F.lit("Docs"), F.lit(None).cast("string")), F.array(F.lit("Log Files"))), ["a_B.tar.gz", ".env"]) == [["a b.tar", "docs", "log files"], [".env", "docs", "log files"]]
    assert values(spark, T.enrich(F.lit("how to log"), F.col("x")), [["docs", "LOG", None]], "array<string>") == ["docs how to log"]
    assert values(spark, T.signature(F.col("x")), [["a", None, "c"], []], "array<string>") == ["a::::c", ""]
    assert values(spark, T.resolved_count(F.col("x")), [["a", None, "", "c"]], "array<string>") == [2]
    assert values(spark, T.score_of_distance(F.col("x")), [0.25, 3.0], "double") == [0.75, 0.0]
    assert values(spark, T.first_parts(F.col("x")), [["a", "b", "c"]], "array<string>") == ["a b"]
    key = values(spark, T.cache_key(F.col("x"), F.lit("v"), F.lit("a::b")), [" Q "])[0]
    assert key == "retrieval-" + hashlib.sha256(b"q::v::a::b").hexdigest()
    assert values(spark, T.known(F.create_map(F.lit("a"), F.col("x"), F.lit("b"), F.lit("1"))), [None]) == [{"b": "1"}]
    assert T.level_list(" a, ,b ") == ["a", "b"]


def test_identity(spark):
    assert values(spark, identity.doc_id(F.col("x")), ["docs/é.txt"]) == [hashlib.sha1("docs/é.txt".encode()).hexdigest()[:16]]
    assert values(spark, identity.path_levels(F.col("x"), 2), ["a/b/c/f.txt", "a/f.txt", "f.txt"]) == [["a", "b"], ["a", None], [None, None]]
    assert values(spark, identity.extra_path(F.col("x"), 1), ["a/b/c/f.txt", "f.txt"]) == [["b", "c"], []]
    files = [("b/é.txt", "2", 5), ("a.txt", "1", 3)]
    want = hashlib.sha256(json.dumps([{"path": p, "checksum": c, "size": s} for p, c, s in sorted(files)], sort_keys=True).encode()).hexdigest()[:16]
    frame = spark.createDataFrame(files, "relative_path string, checksum string, size_bytes long")
    assert identity.corpus_version(frame) == want
    assert identity.corpus_version(frame.limit(0)) == hashlib.sha256(b"[]").hexdigest()[:16]


@pytest.mark.parametrize(("scores", "want"), [([], "none"), ([0.78], "high"), ([0.68, 0.55], "high"), ([0.68, 0.54], "medium"), ([0.68], "medium"), ([0.58], "medium"), ([0.57], "low")])
def test_tiers(spark, scores, want):
    col = F.col("x")
    assert values(spark, tier(F.get(col, F.lit(0)), F.get(col, F.lit(1)), F.size(col)), [scores], "array<double>") == [want]


def test_gate_and_thresholds(spark):
    assert values(spark, forwarded(F.col("x"), F.lit(3)), ["high", "medium", "low", "none"]) == [3, 3, 0, 0]
    assert values(spark, should_answer(F.lit(True), F.col("x"), F.lit(1)), ["high", "low"]) == [True, False]
    t = Thresholds(0.9, 0.8, 0.7, 0.6)
    assert Thresholds.from_json(t.to_json()) == t
    assert Thresholds.from_json({}) == Thresholds()


def test_filters():
    one, two = {"type": "eq", "key": "k", "value": "v"}, {"type": "and", "filters": [{"type": "eq", "key": "b", "value": "2"}, {"type": "eq", "key": "a", "value": "1"}]}
    assert filters.of_pairs([]) is None and filters.of_pairs([("k", "v")]) == one and filters.of_pairs([("b", "2"), ("a", "1")]) == two
    assert [filters.signature_of(x) for x in (None, one, two)] == ["*", "k=v", "a=1,b=2"]
    assert filters.to_operators(two) == {"$and": [{"b": {"$eq": "2"}}, {"a": {"$eq": "1"}}]}
    assert filters.to_operators({"type": "and", "filters": [one, {"type": "or"}]}) == {"k": {"$eq": "v"}}
    assert filters.to_operators({"type": "or"}) is None and filters.to_operators(None) is None
    assert filters.to_same(one) == one and filters.to_conditions(None) is None
