"""Registered queries over whole tables, against their SQL."""

import datetime
import math
from collections import Counter

import duckdb
import pytest

from topograph import more_queries, queries  # noqa: F401

NAMES = ["red box", "blue box", "green lamp", "old red box", "tin"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows = {
        "region": ([(i, f"REGION{i}") for i in range(2)], "r_regionkey int, r_name string"),
        "nation": ([(i, f"NATION{i}", i % 2) for i in range(4)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(i, f"Customer#{i:09d}", i % 4, ["AUTO", "HOME", "TOOL"][i % 3]) for i in range(1, 61)], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"),
        "orders": ([(i, i * 7 % 60 + 1, datetime.datetime(1995, 1, 1)) for i in range(1, 201)], "o_orderkey long, o_custkey long, o_orderdate timestamp"),
        "embeddings": ([(i, [math.sin(i * k * k + k) + (2 if k == i % 5 else 0) * (i % 3) for k in range(8)], i % 5) for i in range(120)], "vec_id long, embedding array<float>, label int"),
        "documents": ([(i, None if i == 7 else "" if i == 8 else f"Text {i}.\r\nMore, é. End {i}.", [None, "en", "fr"][i % 3], [None, "src1", "src2", ""][i % 4] or None) for i in range(80)], "doc_id long, text string, lang string, source string"),
        "pages": ([(0, "<p>a<br>b &amp; c</p><script>var x = '<p>';</script><!-- no <b>no</b> --><style>p</style> <b> d</b>"), (1, "plain"), (2, ""), (3, None), (4, "<ul><li>&lt;x&gt;<li>y</ul><template><p>no</p></template>é")], "page_id long, html string"),
        # T0 and T3 have one brand
        "part": ([(i, NAMES[i % 5], f"T{i % 4}", ["Brand#11", ["Brand#12", "Brand#31"][i // 4 % 2], ["Brand#13", "Brand#41", "Brand#51"][i // 4 % 3], "Brand#22"][i % 4]) for i in range(1, 61)], "p_partkey long, p_name string, p_type string, p_brand string"),
    }
    for name, (x, kind) in rows.items():
        spark.createDataFrame(x, kind).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return d


def wanted(d, name):
    """The rows of the query's SQL."""
    db = duckdb.connect()
    for t in ("region", "nation", "customer", "orders", "part", "embeddings", "documents", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet/*.parquet')")
    return Counter(db.execute(queries.SQL[name]).fetchall())


@pytest.mark.parametrize("name", ["doc_hints_top4", "infer_levels", "cascade", "candidate_next", "effective_query", "auto_pin", "filtered_topk", "baseline_topk", "confidence_tier", "fallback_select", "token_gate", "report_summary", "clarify_options", "crawl_documents", "crawl_with_text", "crawl_unknown", "crawl_depth", "explicit_pins", "clarification_replies", "alias_terms", "stored_values", "manifest_lookup", "configured_tier", "filter_dialects", "narrowed_chunks", "fixture_results", "edited_plan", "unplanned", "store_failure", "clustered_topk", "filter_values", "version_tree", "changed_folders", "cache_keyed", "clarify_prompt", "report_unexpected", "cache_round_trip", "pdf_trailer", "plain_text", "html_text", "maintained_catalog", "embedded_once"])
def test_whole_tables(spark, tables, name):
    got = queries.QUERIES[name](spark, tables)
    assert Counter(map(tuple, got.collect())) == wanted(tables, name)


def test_query_sets(spark, tables):
    """Rows are left out by no query; searches ask with the ids divisible by 20 and offer all others."""
    count = lambda name: queries.QUERIES[name](spark, tables).select("query_id").distinct().count()
    assert (count("cascade"), count("infer_levels"), count("doc_hints_top4"), count("baseline_topk")) == (200, 60, 60, 6)
    assert queries.QUERIES["baseline_topk"](spark, tables).where("chunk_id % 20 = 0").count()


def test_auto_pin_single_brands(spark, tables):
    assert {r.p_type: r.pinned for r in queries.QUERIES["auto_pin"](spark, tables).collect()} == {"T0": "Brand#11", "T1": None, "T2": None, "T3": "Brand#22"}


def test_round_trip_of_many(spark, tmp_path):
    """All outcomes come back, also of more queries than a cache holds by default."""
    rows = spark.range(20 * 1100).selectExpr("id as vec_id", "array(cast(sin(id) as float), cast(cos(id) as float)) as embedding", "cast(id % 5 as int) as label")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.QUERIES["cache_round_trip"](spark, str(tmp_path)).count() == 1100
