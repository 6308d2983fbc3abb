"""Clustered chunk tables, what a search reads of them, and stores that fail while they run."""

import random
import subprocess
import sys
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from topograph import lineage
from topograph.engine import Engine
from topograph.errors import StoreConfigurationError, StoreError
from topograph.operators import retrieve, search
from topograph.operators.store import Store

LEVELS = ["kind", "topic"]
KEYS = search.key_sets([LEVELS])


def scans(frame):
    """(files, bytes, pushed filters) of the scans of a frame that has run."""
    def leaves(p):
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            yield from leaves(p.executedPlan())
        elif "QueryStage" in name:
            yield from leaves(p.plan())
        elif p.children().size() == 0:
            yield p
        else:
            for i in range(p.children().size()):
                yield from leaves(p.children().apply(i))

    return [(p.metrics().apply("numFiles").value(), p.metrics().apply("filesSize").value(), p.metadata().apply("PushedFilters"), p.metadata().apply("PartitionFilters")) for p in leaves(frame._jdf.queryExecution().executedPlan()) if "parquet" in p.nodeName()]


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(8)
    rows = []
    for i in range(4000):
        kind = f"k{i % 8}" if i % 3 else "k0"  # a third of all below one branch
        rows.append((i, f"d{i}", "f", f"text {i} " * 20, kind, rng.choice(["x", "y,z", "=", None]), [rng.gauss(0, 1) for _ in range(16)]))
    return spark.createDataFrame(rows, "chunk_id long, doc_id string, filename string, text string, kind string, topic string, embedding array<float>").persist()


@pytest.fixture(scope="module")
def stored(chunks, tmp_path_factory):
    return Store.write(chunks, LEVELS, f"file://{tmp_path_factory.mktemp('store')}/t", 8)


def asked(spark, n=40, filters=None, size=16):
    rng = random.Random(9)
    filters = filters or [[("kind", "k3")], [("kind", "k0"), ("topic", "y,z")], [("topic", "=")], [], [("kind", "none")]]
    return spark.createDataFrame([(i, 1, filters[i % len(filters)], [rng.gauss(0, 1) for _ in range(size)]) for i in range(n)], "query_id int, attempt int, pairs array<struct<key:string,value:string>>, vector array<float>")


def plain(q, rows, k):
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    out = {}
    for r in q.collect():
        keep = [x for x in rows if all(x[p.key] == p.value for p in r.pairs)]
        out[r.query_id] = [i for _, i in sorted((-round(cos(x.embedding, r.vector), 9), x.chunk_id) for x in keep)[:k]]
    return out


@pytest.mark.parametrize("slices,tiles,few", [(1 << 15, 1 << 13, search.FEW_NODES), (300, 3, 0)])
def test_search_of_either_table(spark, chunks, stored, monkeypatch, slices, tiles, few):
    """Slices of chunks and tiles of queries, also of the filter that all share, find what one block finds, whether the
    nodes are broadcast or joined."""
    monkeypatch.setattr(search, "FEW_NODES", few)
    q, rows = asked(spark), chunks.collect()
    want = plain(q, rows, 5)
    for table in (chunks, stored):
        got = {i: [] for i in range(40)}
        for r in search.search(q, table, KEYS, 5, slices, tiles).orderBy("query_id", "rank").collect():
            got[r.query_id].append(r.chunk_id)
        assert got == want


def test_ranges_reach_the_scan(spark, chunks, stored):
    """A filter of one branch reads the files of its zones only, and the ranges are pushed to the row groups."""
    whole = stored.rows.select("chunk_id", "text")
    assert whole.count() == 4000
    whole.collect()
    ((_, every, _, _),) = scans(whole)
    for filters, most in (([[("kind", "k3")]], 0.3), ([[("kind", "k3"), ("topic", "x")]], 0.3), ([[("kind", "none")]], 0.0), ([[]], 1.0)):
        _, rows = search._searched(asked(spark, 4, filters), stored, KEYS, 5, 1 << 15, 1 << 13)
        rows = rows.select("chunk_id", "text")
        rows.collect()
        read = sum(x[1] for x in scans(rows))
        assert read <= most * every
        if 0 < most < 1:
            ((_, size, pushed, zones),) = scans(rows)
            assert 0 < size and "GreaterThanOrEqual(node" in pushed and "zone" in zones


def test_nodes_are_in_order(stored):
    rows = stored.nodes.orderBy("node").collect()
    assert [r.node for r in rows] == list(range(len(rows))) and sum(r.chunks for r in rows) == 4000
    assert [(r.kind, r.topic or "") for r in rows] == sorted((r.kind, r.topic or "") for r in rows)
    assert {r.zone for r in rows} == set(range(8))
    inside = stored.rows.groupBy("node").agg(F.min("kind").alias("lo"), F.max("kind").alias("hi")).collect()
    assert {r.node: (r.lo, r.hi) for r in inside} == {r.node: (r.kind, r.kind) for r in rows}


def test_engine_over_a_clustered_table(spark, chunks, stored):
    docs = chunks.limit(50).select("doc_id", "filename", F.concat_ws("/", "kind", "topic", "doc_id").alias("relative_path"), F.create_map(F.lit("kind"), F.col("kind"), F.lit("topic"), F.col("topic")).alias("levels"), F.array("doc_id").alias("aliases"))
    q = spark.createDataFrame([(1, "k3 please", [1.0] * 16), (2, "all", [1.0] + [0.0] * 15)], "query_id long, message string, vector array<float>")
    rows = [{r.query_id: (r.reason, [h.doc_id for h in r.results]) for r in Engine(docs, c, LEVELS).search(q).collect()} for c in (chunks, stored)]
    assert rows[0] == rows[1] and len(rows[0][1][1]) == 6
    with pytest.raises(StoreConfigurationError):
        Engine(docs, stored.rows.drop("text"), LEVELS)
    with pytest.raises(StoreConfigurationError):
        Store.write(chunks.withColumn("zone", F.lit(1)), LEVELS, "unused")


def test_an_unknown_set_of_keys_is_told(spark, chunks):
    with pytest.raises(PySparkException, match="no set of keys for a filter on kind"):
        search.search(asked(spark), chunks, [(), ("topic",)]).collect()


def test_empty_tables(spark, chunks, tmp_path):
    none = Store.write(chunks.limit(0), LEVELS, f"file://{tmp_path}/none")
    assert search.search(asked(spark), none, KEYS).collect() == [] == search.search(asked(spark).limit(0), chunks, KEYS).collect()


PLAN = "query_id long, planned int, attempt int, reason string, description string, allow_broaden boolean, pairs array<struct<key:string,value:string>>"


@pytest.fixture(scope="module")
def plan(spark):
    return spark.createDataFrame([(q, 2, a, f"r{a}", "", a == 1, []) for q in range(3) for a in (1, 2)], PLAN)


def found(attempts, raising):
    """One hit for each attempt; raising: what a worker raises at the attempts of query 1."""
    def run(batches):
        for b in batches:
            if raising is not None and (b["query_id"] == 1).any():
                raise raising
            yield b

    rows = attempts.select("query_id", "attempt").mapInPandas(run, "query_id long, attempt int")
    hit = F.struct(F.lit(0.9).alias("score"), F.lit("s").alias("snippet"), F.create_map(F.lit("a"), F.lit("b")).alias("metadata"), F.lit("d").alias("doc_id"), F.lit("f").alias("filename"))
    return rows.select("query_id", "attempt", F.lit(1).alias("rank"), hit.cast(search.HIT).alias("hit"))


@pytest.mark.parametrize("raising", [TimeoutError("late"), ConnectionResetError("gone"), StoreError("no index")])
def test_stores_that_fail_while_they_run(plan, raising):
    rows = retrieve.choose(retrieve.run(plan, lambda a: found(a, raising))).collect()
    assert {(r.confidence, r.error, r.attempts_made) for r in rows} == {("none", f"{type(raising).__name__}: {raising}", 2)} and len(rows) == 3


def test_errors_in_programs_are_raised(plan):
    with pytest.raises(PySparkException, match="no such name"):
        retrieve.run(plan, lambda a: found(a, KeyError("no such name")))
    with pytest.raises(PySparkException):
        retrieve.run(plan, lambda a: a.select("query_id", "no_column"))
    with pytest.raises(StoreConfigurationError):
        retrieve.run(plan, lambda a: (_ for _ in ()).throw(StoreConfigurationError("no table")))


def test_one_attempt_fails_alone(spark, chunks):
    q = asked(spark, 8).withColumn("vector", F.when(F.col("query_id") == 2, F.slice("vector", 1, 7)).otherwise(F.col("vector")))
    rows = search.find(q, Store.of(chunks, LEVELS), KEYS, 3).collect()
    assert [(r.query_id, r.rank, r.hit) for r in rows if r.error] == [(2, 1, None)]
    steps = q.withColumns({"planned": F.lit(1), "reason": F.lit("r"), "description": F.lit(""), "allow_broaden": F.lit(False)})
    got = {r.query_id: (r.store_error, r.result_count) for r in retrieve.summarise(steps, search.find(q, Store.of(chunks, LEVELS), KEYS, 3)).collect()}
    assert got[2] == ("StoreError: a vector of 7 components, chunks have 16", 0)
    assert Counter(n for i, (e, n) in got.items() if i != 2) == {3: 6, 0: 1} and all(e is None for i, (e, _) in got.items() if i != 2)


def test_numbered(spark):
    x = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    assert [r.n for r in lineage.numbered(x, ["v"], "n").orderBy("v").collect()] == list(range(1000))
    assert lineage.numbered(x.limit(0), ["v"], "n").collect() == []


LEFT = """
import sys
from pyspark.sql import SparkSession
from topograph.lineage import cut, scratch_folder, sweep
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
assert cut(cut(s.range(5))).count() == 5
own = scratch_folder(s)
s.range(1).write.parquet(own)
sweep(s, own)
s.stop()
"""


def test_nothing_is_left_behind(tmp_path):
    subprocess.run([sys.executable, "-c", LEFT, f"file://{tmp_path}"], check=True, cwd=lineage.__file__.rsplit("/", 2)[0], capture_output=True)
    assert [p for p in tmp_path.rglob("*") if p.is_file()] == []
