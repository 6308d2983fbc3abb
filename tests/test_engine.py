import asyncio
import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from topograph.engine import Engine
from topograph.errors import StoreConfigurationError
from topograph.functions.confidence import Thresholds
from topograph.operators import cache, corpus, report, resolve, retrieve, search
from topograph.sources import artifacts
from topograph.plans.template import Attempt, default_attempts, resolve_plan

LEVELS = ["kind", "topic"]
DOCS = [("docs/tutorial/classes.txt", "docs", "tutorial"), ("docs/howto/logging.txt", "docs", "howto"), ("docs/howto/async.txt", "docs", "howto"), ("docs/overview.txt", "docs", None), ("source/asyncio/taskgroup.py", "source", "asyncio"), ("source/json/decoder.py", "source", "json")]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(f"d{i}", p.split("/")[-1], p, {"kind": k, "topic": t}, sorted({p.split("/")[-1].rsplit(".", 1)[0], k, *([t] if t else [])}), str(i), i) for i, (p, k, t) in enumerate(DOCS)]
    return spark.createDataFrame(rows, "doc_id string, filename string, relative_path string, levels map<string,string>, aliases array<string>, checksum string, size_bytes long").persist()


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(i, f"d{i}", p, f"text {i}", k, t, [1.0, float(i), 0.5]) for i, (p, k, t) in enumerate(DOCS)] + [(9, "d9", "n", "no vector", "docs", "howto", None), (10, "d10", "z", "zero", "docs", "howto", [0.0, 0.0, 0.0])]
    return spark.createDataFrame(rows, "chunk_id long, doc_id string, filename string, text string, kind string, topic string, embedding array<float>").persist()


def ask(spark, *messages, **more):
    rows = [Row(query_id=i, message=m, vector=[1.0, 4.0, 0.5], **{k: v[i] for k, v in more.items()}) for i, m in enumerate(messages)]
    kinds = {"explicit": "explicit map<string,string>", "conversation": f"conversation {resolve.CONVERSATION}"}
    return spark.createDataFrame(rows, ", ".join(["query_id long, message string, vector array<float>", *(kinds[k] for k in more)]))


def resolved(spark, documents, *messages, **more):
    return {r.query_id: r for r in resolve.resolve(ask(spark, *messages, **more), resolve.Catalog.of(documents, LEVELS)).collect()}


def test_resolve(spark, documents):
    r = resolved(spark, documents, "What does asyncio.TaskGroup do in the source code?", "Logging", "kubernetes", "the decoder", "docs please")
    assert r[0].resolved == ["source", "asyncio"] and r[0].effective_query == r[0].user_query
    assert r[1].resolved == ["docs", "howto"] and r[1].effective_query == "howto docs Logging" and r[1].hint_names == ["logging.txt"]
    assert r[2].resolved == [None, None] and r[2].next_level == 0 and r[2].next_values == ["docs", "source"]
    assert r[3].resolved == ["source", "json"]
    assert r[4].resolved == ["docs", None] and r[4].next_values == ["howto", "tutorial"] and len(r[4].hint_names) == 4


def test_pins_and_replies(spark, documents):
    option = ("1", "Howto", "topic", "howto", {"kind": "docs", "topic": None})
    told = [("assistant", "clarification", "?", [option], "original words")]
    r = resolved(spark, documents, "x", "  HOWTO ", "7", "", explicit=[{"kind": "SOURCE", "topic": "new"}, {}, None, {"kind": ""}], conversation=[None, told, told, []])
    assert r[0].resolved == ["source", "new"]
    assert r[1].resolved == ["docs", "howto"] and r[1].reply_resolved and r[1].effective_query == "howto docs original words"
    assert r[2].resolved == [None, None] and not r[2].reply_resolved and r[2].clarification_count == 1
    assert r[3].effective_query == "" and r[3].resolved == [None, None]


def test_one_level_value_pins_everything(spark, documents):
    only = documents.where("levels['kind'] = 'docs'")
    x = resolve.resolve(ask(spark, "kubernetes"), resolve.Catalog.of(only, LEVELS)).first()
    assert x.resolved == ["docs", None] and x.next_values == ["howto", "tutorial"]
    flat = resolve.resolve(ask(spark, "anything"), resolve.Catalog.of(documents, [])).first()
    assert flat.resolved == [] and flat.next_level is None


def test_plans(spark):
    c = spark.createDataFrame([(0, ["a", "b", "c"]), (1, ["a", None, "c"]), (2, [None, None, None]), (3, ["a", None, None])], "query_id int, resolved array<string>")
    names = ["x", "y", "z"]
    got = {}
    for r in resolve_plan(c, names).orderBy("query_id", "attempt").collect():
        got.setdefault(r.query_id, []).append((r.attempt, r.reason, [tuple(p) for p in r.pairs]))
    assert got[0] == [(1, "resolved_context", [("x", "a"), ("y", "b"), ("z", "c")]), (2, "drop_z", [("x", "a"), ("y", "b")]), (3, "x_only", [("x", "a")]), (4, "global_fallback", [])]
    assert got[1] == [(1, "resolved_context", [("x", "a"), ("z", "c")]), (2, "drop_z", [("x", "a")]), (3, "global_fallback", [])]
    assert got[2] == [(1, "global_fallback", [])] and got[3] == [(1, "resolved_context", [("x", "a")]), (2, "global_fallback", [])]
    edited = [Attempt(1, "mine", "", ("z",), False)]
    assert [(r.reason, r.allow_broaden) for r in resolve_plan(c.where("query_id = 2"), names, edited).collect()] == [("global_fallback", False)]
    assert [a.reason for a in default_attempts([])] == ["global_fallback"]


def test_choice_like_a_loop(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for q in range(300):
        n = rng.randint(1, 4)
        plan = [(i + 1, i + 1 < n and rng.random() < 0.9, rng.choice(["high", "medium", "low", "none"])) for i in range(n)]
        rows += [(q, n, i, f"r{i}", broaden, tier, 0 if tier == "none" else 2, 0.5) for i, broaden, tier in plan]
        weak = plan[0][1] and plan[0][2] in ("low", "none")
        seen = plan if weak else plan[:1]
        best = [i for i, b, t in seen if t != "none" and (t in ("high", "medium") or not b)]
        some = [i for i, _, t in seen if t != "none"]
        want[q] = (best[0] if best else some[-1] if some else 1, n if weak else 1)
    frame = spark.createDataFrame(rows, "query_id int, planned int, attempt int, reason string, allow_broaden boolean, confidence string, result_count int, top_score double").withColumn("results", F.array().cast(f"array<{search.HIT}>"))
    assert {r.query_id: (r.attempt, r.attempts_made) for r in retrieve.choose(frame).collect()} == want


def test_search(spark, documents, chunks):
    e = Engine(documents, chunks, LEVELS, k=2, thresholds=Thresholds(0.99, 0.99, 0.99, 0.9))
    rows = {r.query_id: r for r in e.search(ask(spark, "taskgroup asyncio source", "kubernetes", "docs please")).collect()}
    assert [h.doc_id for h in rows[0].results] == ["d4"] and rows[0].confidence == "high" and rows[0].attempts_made == 1 and rows[0].should_answer
    assert rows[0].results[0].metadata["topic"] == "asyncio" and not rows[0].needs_clarification
    assert [h.doc_id for h in rows[1].results] == ["d4", "d5"] and rows[1].reason == "global_fallback"
    assert rows[1].clarification.prompt == "Which kind is this about?\n\n1. Source\n\nReply with the option number." or [o.value for o in rows[1].clarification.options] == ["source"]
    assert rows[2].clarification is None  # the results point at one topic
    c = Engine(documents, chunks, LEVELS, k=4).search(ask(spark, "docs please")).first().clarification
    assert c.prompt.startswith("Which Docs topic is this about?") and {o.value for o in c.options} == {"howto", "tutorial"} and c.options[0].resolved == {"kind": "docs", "topic": None}
    same = asyncio.run(e.asearch(ask(spark, "kubernetes")))
    assert same[0].results == rows[1].results
    with pytest.raises(StoreConfigurationError):
        Engine(documents, chunks.drop("topic"), LEVELS)


@pytest.mark.parametrize("slice_rows", [1 << 15, 7])
def test_search_equals_brute_force(spark, slice_rows):
    rng = random.Random(5)
    rows = [(i, f"d{i}", "f", "t", rng.choice("ab"), rng.choice(["x", "y", None]), [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    c = spark.createDataFrame(rows, "chunk_id long, doc_id string, filename string, text string, kind string, topic string, embedding array<double>")
    q = spark.createDataFrame([(i, 1, [[("kind", "a")], [("kind", "b"), ("topic", "x")], []][i % 3], [rng.gauss(0, 1) for _ in range(4)]) for i in range(9)], "query_id int, attempt int, pairs array<struct<key:string,value:string>>, vector array<double>")
    got = {}
    for r in search.search(q, c, search.key_sets([LEVELS]), 5, slice_rows).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, round(r.score, 9)))
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    for r in q.collect():
        keep = [x for x in rows if all(dict(zip(LEVELS, x[4:6]))[p.key] == p.value for p in r.pairs)]
        want = sorted(((x[0], round(cos(x[6], r.vector), 9)) for x in keep), key=lambda x: (-x[1], x[0]))[:5]
        assert got.get(r.query_id, []) == want


def test_fixture_store(spark):
    f = spark.createDataFrame([("logging", 0, "*", i, s, "s", {"kind": "docs"}, f"d{i}") for i, s in enumerate([0.5, 0.9, 0.99], 1)] + [("logging help", 1, "*", 1, 0.1, "s", {}, "d7")], "bucket string, position int, signature string, row_no int, score double, snippet string, metadata map<string,string>, doc_id string")
    a = spark.createDataFrame([(0, "Tell me about LOGGING", 1, []), (1, "logging help", 1, []), (2, "nothing", 1, [])], "query_id int, message string, attempt int, pairs array<struct<key:string,value:string>>")
    got = [(r.query_id, r.doc_id) for r in search.fixture_search(a, f, 2).orderBy("query_id", "rank").collect()]
    assert got == [(0, "d2"), (0, "d1"), (1, "d7")]


def test_cache(spark, documents, chunks, tmp_path):
    e = Engine(documents, chunks, LEVELS, version="v1", cache_root=str(tmp_path), k=2)
    first = e.search(ask(spark, "docs please")).first()
    again = e.search(ask(spark, "docs please")).first()
    assert not first.cache_hit and again.cache_hit and again.results == first.results and again.clarification == first.clarification
    assert e.cache.prune("v2") == 1 and not e.search(ask(spark, "docs please")).first().cache_hit
    e.cache.clear()
    assert e.cache.entries() is None
    small = Engine(documents, chunks, LEVELS, version="v1", cache_root=str(tmp_path), cache_limit=2, k=2)
    for words in ("docs please", "logging", "decoder", "docs please"):
        small.search(ask(spark, words, "taskgroup asyncio")).count()
        assert small.cache.entries("v1").count() == 2
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("a", 3, "y"), ("c", 4, "x")], "key string, seq long, v string")
    assert {(r.key, r.v) for r in cache.evicted(rows, 2).collect()} == {("b", "x"), ("c", "x")}


def test_corpus_frames(spark, documents):
    assert [tuple(r) for r in corpus.level_values(documents, LEVELS).orderBy("level", "pos").collect()][:2] == [(0, "docs", 0), (0, "source", 1)]
    assert {tuple(r.path): r.doc_count for r in corpus.tree_nodes(documents, LEVELS).collect()}[("docs",)] == 1
    assert {tuple(r.path): r.doc_count for r in corpus.subtree_counts(documents, LEVELS).collect()}[("docs",)] == 4
    m = corpus.manifest(documents, LEVELS)
    assert corpus.find(m, "doc_id", "d0").first().metadata == {"kind": "docs", "topic": "tutorial", "doc_id": "d0", "source_path": DOCS[0][0]}
    bad = m.unionByName(m.where("doc_id = 'd0'"))
    found = {(r.kind, r.detail) for r in corpus.issues(bad, ["kind", "topic", "more"], m.where("doc_id <> 'd1'"), complete=True).collect()}
    assert found == {("duplicate doc_id", None), ("duplicate relative_path", None), ("missing level", "more"), ("null level", "topic"), ("missing file", None)}
    stamped = corpus.stamp(spark.createDataFrame([("c", "d3", "words")], "chunk_id string, doc_id string, text string"), m, LEVELS).first()
    assert stamped.kind == "docs" and stamped.topic is None and "topic" not in stamped.metadata and stamped.metadata["text"] == "words"
    assert corpus.upload_due(None, "v", True) and not corpus.upload_due({"corpus_version": "v"}, "v", True) and corpus.upload_due({"corpus_version": "v"}, "v", False)


def test_report(spark):
    kind = "query_id int, attempts_made int, top_score double, confidence string, result_count int, chunks_forwarded int, snippet_chars int"
    flat = spark.createDataFrame([(0, 1, 0.5, "low", 6, 0, 0), (1, 1, 0.6, "medium", 6, 6, 100)], kind)
    engine = spark.createDataFrame([(0, 3, 0.9, "high", 3, 3, 50), (1, 1, 0.5, "none", 0, 0, 0)], kind)
    s = report.summary(report.compare(flat, engine)).first()
    assert (s.high, s.low_or_none, s.first_attempt, s.forwarded_change, s.chars_change) == (1, 1, 1, -50.0, -50.0)
    assert "2 queries" in report.text(report.compare(flat, engine)) and report.text(report.compare(flat, engine).limit(0)) == ""
    want = spark.createDataFrame([(0, ["high"], 2), (1, ["low", "none"], 1)], "query_id int, expected_confidence array<string>, max_attempts int")
    assert [r.query_id for r in report.unexpected(engine, want).collect()] == [0]


def test_engine_from_tables(spark, documents, tmp_path):
    """Tables hold what the JSON artifacts hold, and an engine made from either answers alike."""
    full = documents.withColumns({"extra_path": F.array().cast("array<string>"), "last_modified": F.lit(None).cast("timestamp"), "extension": F.lit(".txt"), "text_sample": F.lit("x")})
    built = artifacts.build(full, LEVELS, "2020-01-01T00:00:00+00:00", Thresholds(medium_min=0.5))
    artifacts.write_tables(built, str(tmp_path / "tables"))
    paths = artifacts.write_json(built, tmp_path / "json")
    made = json.loads(paths["corpus_map"].read_text())
    assert paths["corpus_map"].read_text() == json.dumps(made, indent=2, ensure_ascii=False)
    held = {r.doc_id: {k: r[k] for k in ("doc_id", "filename", "relative_path", "aliases")} for r in documents.collect()}
    at = lambda *ids: {"_documents": [held[i] for i in ids]}
    assert made["tree"] == {"docs": {"_documents": [held["d3"]], "_topic": {"howto": at("d2", "d1"), "tutorial": at("d0")}}, "source": {"_topic": {"asyncio": at("d4"), "json": at("d5")}}}
    assert (made["document_count"], made["version"], made["level_names"], made["level_values"]) == (6, built.version, LEVELS, {"kind": ["docs", "source"], "topic": ["asyncio", "howto", "json", "tutorial"]})
    assert [r["doc_id"] for r in made["flat_documents"]] == ["d2", "d1", "d3", "d0", "d4", "d5"]
    chunks = spark.createDataFrame([("c1", "d0", "classes.txt", "t", [1.0, 0.0], "docs", "tutorial"), ("c2", "d4", "taskgroup.py", "t", [0.6, 0.8], "source", "asyncio")], "chunk_id string, doc_id string, filename string, text string, embedding array<float>, kind string, topic string")
    queries = spark.createDataFrame([(1, "asyncio please", [1.0, 0.0]), (2, "nothing", [0.0, 1.0])], "query_id long, message string, vector array<float>")
    engines = [Engine.from_tables(spark, str(tmp_path / "tables"), chunks), Engine.from_artifacts(spark, tmp_path / "json", chunks)]
    assert engines[0].thresholds == engines[1].thresholds == Thresholds(medium_min=0.5) and engines[0].attempts == engines[1].attempts and engines[0].version == engines[1].version
    got = [sorted(map(tuple, e.search(queries).drop("results", "clarification").collect())) for e in engines]
    assert got[0] == got[1] and len(got[0]) == 2
    assert [r.query_id for r in asyncio.run(engines[0].aresolve(queries))] and engines[0].close() is None


def cache_rows(spark, ids, reason="r"):
    rows = spark.createDataFrame([(i, True, reason, "low", 0.1 * i, 1, None) for i in ids], "query_id long, executed boolean, reason string, confidence string, top_score double, attempts_made int, error string")
    return rows.withColumn("results", F.array().cast(f"array<{search.HIT}>")), rows.select("query_id", F.concat(F.lit("k"), "query_id").alias("key"))


def test_cache_of_damaged_files(spark, tmp_path):
    """A file that can't be read is a miss; the last keys by first insertion are kept; old generations go."""
    held = cache.Cache(spark, str(tmp_path))
    rows, keys = cache_rows(spark, range(6))
    assert held.get(keys, "v")[0] is None and held.entries() is None
    held.put(rows, keys, "v")
    held.put(rows.where("query_id = 0").withColumn("reason", F.lit("again")), keys, "v")
    whole = held._generations("v")[-1].removeprefix("file:")
    (tmp_path / "retrieval_cache/corpus_version=v" / whole.rpartition("/")[2] / "bucket=3").mkdir(exist_ok=True)
    (tmp_path / "retrieval_cache/corpus_version=v" / whole.rpartition("/")[2] / "bucket=3/part-damaged.parquet").write_bytes(b"no parquet")
    (tmp_path / "retrieval_cache/corpus_version=v/gen-999999999999-unfinished").mkdir()
    hit, miss = held.get(keys, "v")
    assert hit.count() == 6 and miss.count() == 0 and hit.where("reason = 'again'").first().query_id == 0
    held.keep_last("v", 4)
    assert {r.query_id for r in held.get(keys, "v")[0].collect()} == {2, 3, 4, 5} and len(held._generations("v")) == 2
    assert [r.key for r in asyncio.run(held.aget(keys.where("query_id = 3"), "v"))] == ["k3"]
    asyncio.run(held.aput(*cache_rows(spark, [9]), "w"))
    assert held.entries().count() == 5 and held.prune("v") == 1


def test_cache_reads_few_buckets(spark, tmp_path):
    """A lookup of ten keys opens their buckets only, and asks for the keys in them."""
    from tests.test_store import scans

    held = cache.Cache(spark, str(tmp_path), 5000)
    rows, keys = cache_rows(spark, range(4000))
    held.put(rows, keys, "v")
    hit, _ = held.get(keys.where("query_id % 400 = 7"), "v")
    assert {r.query_id for r in hit.collect()} == set(range(7, 4000, 400))
    own = next(x for x in scans(hit) if "bucket" in str(x[3]))
    assert 0 < own[0] <= 10 and "In(key" in own[2]


def test_digests_of_folders(spark):
    """Digests tell any change, and its folders and those above them only; they don't depend on parts."""
    rows = [(f"{'/'.join('abc'[(i >> 2 * j) % 3] for j in range(i % 4))}/f{i}".lstrip("/"), str(i), i) for i in range(200)]
    frame = spark.createDataFrame(rows, "relative_path string, checksum string, size_bytes long")
    old = corpus.digests(frame)
    assert {r.path: r.digest for r in old.collect()} == {r.path: r.digest for r in corpus.digests(frame.repartition(7)).collect()}
    assert old.where("path = ''").first().files == 200 and corpus.tree_version(frame) == old.where("path = ''").first().digest[:16]
    path = next(p for p, _, _ in rows if p.count("/") == 2)
    for change in (F.when(F.col("relative_path") == path, F.lit("x")).otherwise(F.col("checksum")),):
        found = {(r.path, r.change) for r in corpus.changed(old, corpus.digests(frame.withColumn("checksum", change))).collect()}
        assert found == {("", "changed"), (path.split("/")[0], "changed"), (path.rpartition("/")[0], "changed")}
    more = frame.unionByName(spark.createDataFrame([("new/deep/er/x", "1", 1)], frame.schema))
    assert {(r.path, r.change) for r in corpus.changed(old, corpus.digests(more)).collect()} == {("", "changed"), ("new", "added"), ("new/deep", "added"), ("new/deep/er", "added")}
    assert corpus.changed(corpus.digests(more), old).where("change = 'removed'").count() == 3
    assert corpus.digests(frame.limit(0)).count() == 0 and len(corpus.tree_version(frame.limit(0))) == 16


def test_public_names():
    import topograph

    assert all(getattr(topograph, n) for n in topograph.__all__)
