"""One query for each operator over the driver's tables, with its DuckDB SQL.

Levels: documents have [lang, source] with the path lang/source/<doc_id>.txt; geo is customers under [region, nation,
segment]; parts are [type, brand]; chunks are embeddings under [fam, lab].
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topograph.functions import identity
from topograph.functions import text as T
from topograph.functions.confidence import Thresholds
from topograph.operators import cache, clarify, corpus, report, resolve, retrieve, search
from topograph.operators.store import Store
from topograph.plans.template import resolve_plan
from topograph.sources import extract
from topograph.workers import reach

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DOC, GEO, CHUNK = ["lang", "source"], ["region", "nation", "segment"], ["fam", "lab"]
#: The synthetic vectors score lower than real ones.
LOW = Thresholds(high_single=0.42, high_combo=0.36, high_combo_second=0.33, medium_min=0.30)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return reach(spark).read.parquet(f"{d}/{name}.parquet")


def levels_of(names: list[str], *values: Column) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*values))


def documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents table as a crawl would give it."""
    path = F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    x = table(spark, d, "documents").withColumn("relative_path", path).withColumn("filename", F.element_at(F.split("relative_path", "/"), -1))
    levels = identity.path_levels(F.col("relative_path"), 2)
    return x.select(identity.doc_id(F.col("relative_path")).alias("doc_id"), "filename", "relative_path", F.map_from_arrays(F.array(*map(F.lit, DOC)), levels).alias("levels"), T.aliases(F.col("filename"), levels).alias("aliases"), identity.checksum(F.col("text").cast("binary")).alias("checksum"), F.octet_length("text").cast("long").alias("size_bytes"), F.substring("text", 1, 100).alias("text_sample"))


D_SQL = """d AS (SELECT lang, source, doc_id AS n, text, concat_ws('/', lang, source, concat(doc_id, '.txt')) AS relative_path, concat(doc_id, '.txt') AS filename FROM documents)"""


def geo(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = (table(spark, d, x) for x in ("customer", "nation", "region"))
    x = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    segment = F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment"))  # some customers are shallow
    path = F.concat_ws("/", "r_name", "n_name", segment, "c_name")
    return x.select(F.col("c_custkey").cast("string").alias("doc_id"), F.col("c_name").alias("filename"), path.alias("relative_path"), levels_of(GEO, F.col("r_name"), F.col("n_name"), segment).alias("levels"), F.array(F.lower("n_name"), F.lower("c_name")).alias("aliases"))


G_SQL = """g AS (SELECT CAST(c_custkey AS VARCHAR) AS doc_id, c_name AS filename, r_name AS l0, n_name AS l1, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS l2,
 concat_ws('/', r_name, n_name, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END, c_name) AS relative_path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def chunks(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "embeddings")
    lab = F.col("label").cast("string")
    return x.select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("d"), lab).alias("doc_id"), F.concat(F.lit("f"), lab, F.lit(".txt")).alias("filename"), F.concat(F.lit("chunk "), F.col("vec_id").cast("string")).alias("text"), "embedding", F.concat(F.lit("f"), (F.col("label") % 3).cast("string")).alias("fam"), F.concat(F.lit("l"), lab).alias("lab"))


def contexts(spark: SparkSession, d: str) -> DataFrame:
    """Vectors whose id is divisible by 20 are queries, against all others; half of them have both levels resolved, the others one or none."""
    x = table(spark, d, "embeddings").where("vec_id % 20 = 0").withColumn("query_id", F.col("vec_id"))
    kind = (F.col("vec_id") / 20).cast("long") % 4
    fam = F.when(kind != 3, F.concat(F.lit("f"), (F.col("label") % 3).cast("string")))
    lab = F.when(kind < 2, F.concat(F.lit("l"), F.col("label").cast("string")))
    return x.select("query_id", F.array(fam, lab).alias("resolved"), F.col("embedding").alias("vector"))


C_SQL = """c AS (SELECT vec_id AS chunk_id, CAST(embedding AS DOUBLE[]) AS e, 'f' || (label % 3) AS fam, 'l' || label AS lab, 'chunk ' || vec_id AS text FROM embeddings),
q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v, CASE WHEN (vec_id // 20) % 4 <> 3 THEN 'f' || (label % 3) END AS fam, CASE WHEN (vec_id // 20) % 4 < 2 THEN 'l' || label END AS lab FROM embeddings WHERE vec_id % 20 = 0),
t AS (SELECT * FROM (VALUES (1, 'resolved_context', true), (2, 'fam_only', true), (3, 'global_fallback', false)) t(pos, reason, allow_broaden)),
r AS (SELECT query_id, v, pos, reason, allow_broaden, CASE WHEN pos < 3 THEN fam END AS fam, CASE WHEN pos = 1 THEN lab END AS lab FROM q, t),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, coalesce(fam, ''), coalesce(lab, '') ORDER BY pos) AS again FROM r WHERE pos = 3 OR fam IS NOT NULL OR lab IS NOT NULL),
p AS (SELECT query_id, v, fam, lab, reason, allow_broaden, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos) AS INTEGER) AS attempt, count(*) OVER (PARTITION BY query_id) AS n FROM k WHERE again = 1)"""
S_SQL = f"""{C_SQL},
s AS (SELECT p.query_id, p.attempt, c.chunk_id, c.text, c.fam, c.lab, list_dot_product(p.v, c.e) / sqrt(list_dot_product(p.v, p.v)) / sqrt(list_dot_product(c.e, c.e)) AS score FROM p JOIN c ON c.chunk_id <> p.query_id AND (p.fam IS NULL OR p.fam = c.fam) AND (p.lab IS NULL OR p.lab = c.lab)),
h AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, attempt ORDER BY round(score, 12) DESC, chunk_id) AS INTEGER) AS rank FROM s) WHERE rank <= 6)"""
A_SQL = f"""{S_SQL},
a AS (SELECT p.query_id, p.attempt, p.reason, p.allow_broaden, p.n, count(h.score) AS result_count, coalesce(max(h.score), 0) AS top_score, coalesce(max(h.score) FILTER (h.rank = 2), 0) AS second, coalesce(sum(length(h.text)), 0) AS chars FROM p LEFT JOIN h ON p.query_id = h.query_id AND p.attempt = h.attempt GROUP BY ALL),
b AS (SELECT *, CASE WHEN result_count = 0 THEN 'none' WHEN top_score >= 0.42 OR (top_score >= 0.36 AND second >= 0.33) THEN 'high' WHEN top_score >= 0.30 THEN 'medium' ELSE 'low' END AS confidence FROM a),
w AS (SELECT query_id, allow_broaden AND confidence NOT IN ('high', 'medium') AS weak FROM b WHERE attempt = 1),
z AS (SELECT b.*, w.weak FROM b JOIN w ON b.query_id = w.query_id WHERE w.weak OR b.attempt = 1),
y AS (SELECT query_id, coalesce(min(attempt) FILTER (result_count > 0 AND (confidence IN ('high', 'medium') OR NOT allow_broaden)), max(attempt) FILTER (result_count > 0), 1) AS attempt FROM z GROUP BY query_id),
o AS (SELECT z.query_id, z.attempt, z.reason, z.confidence, z.top_score, CAST(CASE WHEN z.weak THEN z.n ELSE 1 END AS INTEGER) AS attempts_made, z.result_count, z.chars FROM z JOIN y ON z.query_id = y.query_id AND z.attempt = y.attempt)"""


@query(f"WITH {D_SQL} SELECT n, substr(sha1(relative_path), 1, 16) AS doc_id, sha256(text) AS checksum FROM d")
def doc_identity(spark, d):
    x = documents(spark, d)
    return x.select(F.regexp_extract("filename", r"^(\d+)", 1).cast("long").alias("n"), "doc_id", "checksum")


PAGE = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


@query(f"""WITH p AS (SELECT page_id, string_split({PAGE}, '/') AS s FROM pages)
SELECT page_id, CASE WHEN len(s) > 1 THEN s[1] END AS level_0, CASE WHEN len(s) > 2 THEN s[2] END AS level_1, array_to_string(s[3:len(s)-1], '/') AS extra_path FROM p""")
def hierarchy_levels(spark, d):
    x = table(spark, d, "pages").select("page_id", F.expr(PAGE).alias("path"))
    levels = identity.path_levels(F.col("path"), 2)
    return x.select("page_id", levels[0].alias("level_0"), levels[1].alias("level_1"), F.array_join(identity.extra_path(F.col("path"), 2), "/").alias("extra_path"))


@query("""WITH a AS (SELECT p_partkey, list_sort(list_distinct(list_filter([trim(lower(replace(replace(p_name, '_', ' '), '-', ' '))), lower(p_type), lower(p_brand)], lambda x: x <> ''))) AS l FROM part)
SELECT p_partkey, array_to_string(l, '|') AS aliases, len(l) AS n FROM a""")
def alias_build(spark, d):
    x = table(spark, d, "part").select("p_partkey", T.aliases(F.concat("p_name", F.lit(".txt")), F.array("p_type", "p_brand")).alias("l"))
    return x.select("p_partkey", F.array_join("l", "|").alias("aliases"), F.size("l").cast("long").alias("n"))


@query("SELECT p_partkey, trim(regexp_replace(replace(replace(p_name || '_x-y', '_', ' '), '-', ' '), '\\s+', ' ', 'g')) AS display_name FROM part")
def display_name(spark, d):
    return table(spark, d, "part").select("p_partkey", T.display_name(F.concat("p_name", F.lit("_x-y.pdf"))).alias("display_name"))


@query(f"""WITH {G_SQL}, v AS (SELECT DISTINCT level, value FROM (SELECT 0 AS level, l0 AS value FROM g UNION ALL SELECT 1, l1 FROM g UNION ALL SELECT 2, l2 FROM g) WHERE value <> '')
SELECT level, value, CAST(row_number() OVER (PARTITION BY level ORDER BY value) - 1 AS INTEGER) AS pos FROM v""")
def level_values(spark, d):
    return corpus.level_values(geo(spark, d), GEO)


@query(f"WITH {G_SQL} SELECT concat_ws('/', l0, l1, l2) AS path, count(*) AS doc_count, CAST(2 + CAST(l2 IS NOT NULL AS INTEGER) AS INTEGER) AS depth FROM g GROUP BY l0, l1, l2")
def tree_nodes(spark, d):
    return corpus.tree_nodes(geo(spark, d), GEO).withColumn("path", F.array_join("path", "/"))


@query(f"""WITH {G_SQL}, n AS (SELECT '' AS path, 0 AS depth FROM g UNION ALL SELECT l0, 1 FROM g UNION ALL SELECT concat_ws('/', l0, l1), 2 FROM g UNION ALL SELECT concat_ws('/', l0, l1, l2), 3 FROM g WHERE l2 IS NOT NULL)
SELECT path, depth, count(*) AS doc_count FROM n GROUP BY path, depth""")
def subtree_counts(spark, d):
    return corpus.subtree_counts(geo(spark, d), GEO).withColumn("path", F.array_join("path", "/"))


N_SQL = """n AS (SELECT 1 AS child_level, l1 AS child_value, 0 AS parent_level, l0 AS parent_value FROM g UNION SELECT 2, l2, 0, l0 FROM g WHERE l2 IS NOT NULL UNION SELECT 2, l2, 1, l1 FROM g WHERE l2 IS NOT NULL)"""


@query(f"WITH {G_SQL}, {N_SQL} SELECT * FROM n")
def ancestor_index(spark, d):
    return corpus.ancestors(geo(spark, d), GEO)


@query(f"WITH {G_SQL}, {N_SQL} SELECT child_level, child_value, parent_level, min(parent_value) AS parent_value FROM n GROUP BY ALL HAVING count(*) = 1")
def single_ancestors(spark, d):
    return corpus.single_ancestors(geo(spark, d), GEO)


@query("SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS norm_md5 FROM documents")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.normalize(F.col("text")).cast("binary")).alias("norm_md5"))


NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


def talk(spark: SparkSession, d: str) -> DataFrame:
    """User turns, with a level value worked into some of them."""
    x = table(spark, d, "conversations").where("role = 'user'")
    more = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit(" about src"), (F.col("conv_id") % 20).cast("string"))).when(F.col("conv_id") % 3 == 1, F.lit(" in Fr-land")).otherwise("")
    return x.select(F.concat_ws(":", "conv_id", "turn").alias("query_id"), F.concat("text", more).alias("message"))


T_SQL = f"""u AS (SELECT concat_ws(':', conv_id, turn) AS query_id, text || CASE conv_id % 3 WHEN 0 THEN ' about src' || (conv_id % 20) WHEN 1 THEN ' in Fr-land' ELSE '' END AS message FROM conversations WHERE role = 'user'),
m AS (SELECT query_id, {NORM.format('message')} AS norm FROM u),
lv AS (SELECT DISTINCT 0 AS level, lang AS value FROM documents WHERE lang <> '' UNION SELECT DISTINCT 1, source FROM documents WHERE source <> ''),
x AS (SELECT m.query_id, lv.level, lv.value FROM m JOIN lv ON contains(m.norm, {NORM.format('lv.value')}))"""


@query(f"WITH {T_SQL} SELECT query_id, level, array_to_string(list(value ORDER BY value), ',') AS matched FROM x GROUP BY query_id, level")
def lexical_match(spark, d):
    c = resolve.Catalog.of(documents(spark, d), DOC)
    q = talk(spark, d).withColumn("norm", T.normalize(F.col("message")))
    return resolve.lexical_matches(q, c).select("query_id", "level", F.array_join("values", ",").alias("matched"))


@query(f"WITH {T_SQL} SELECT query_id, level, min(value) AS pinned FROM x GROUP BY query_id, level HAVING count(*) = 1")
def unique_pin(spark, d):
    c = resolve.Catalog.of(documents(spark, d), DOC)
    q = talk(spark, d).withColumn("norm", T.normalize(F.col("message")))
    return resolve.lexical_matches(q, c).where(F.size("values") == 1).select("query_id", "level", F.get("values", F.lit(0)).alias("pinned"))


def parts(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "part")
    return x.select(F.col("p_partkey").cast("string").alias("doc_id"), F.concat("p_name", F.lit(".txt")).alias("filename"), F.concat_ws("/", "p_type", "p_brand", F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("relative_path"), levels_of(["type", "brand"], F.col("p_type"), F.col("p_brand")).alias("levels"), F.array(F.lower("p_name"), F.lower("p_brand")).alias("aliases"))


def asked_parts(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "part")
    return x.select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("Price of "), "p_name", F.lit("?")).alias("message"))


P_SQL = f"""dp AS (SELECT p_partkey, concat_ws('/', p_type, p_brand, lpad(CAST(p_partkey AS VARCHAR), 9, '0')) AS relative_path, p_name || '.txt' AS name, p_type, p_brand, unnest([{NORM.format('p_name')}, {NORM.format('p_brand')}, {NORM.format("p_name || '.txt'")}]) AS term FROM part),
uq AS (SELECT p_partkey AS query_id, {NORM.format("'Price of ' || p_name || '?'")} AS norm FROM part),
hp AS (SELECT query_id, relative_path, name, p_type, p_brand, max(length(term)) AS score FROM uq JOIN dp ON dp.term <> '' AND contains(uq.norm, dp.term) GROUP BY ALL),
hr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name, relative_path) AS INTEGER) AS rank FROM hp)"""


@query(f"WITH {P_SQL} SELECT query_id, relative_path, name, CAST(score AS INTEGER) AS score, rank FROM hr WHERE rank <= 4")
def doc_hints_top4(spark, d):
    c = resolve.Catalog.of(parts(spark, d), ["type", "brand"])
    q = asked_parts(spark, d).withColumn("norm", T.normalize(F.col("message")))
    return resolve.hints(resolve.named_terms(q, c), c)


@query(f"""WITH {G_SQL}, al AS (SELECT CAST(g.doc_id AS BIGINT) AS query_id, l0, l1, l2 FROM g)
SELECT query_id, 0 AS level, l0 AS value FROM al UNION ALL SELECT query_id, 1, l1 FROM al UNION ALL SELECT query_id, 2, l2 FROM al WHERE l2 IS NOT NULL""")
def infer_levels(spark, d):
    c = resolve.Catalog.of(geo(spark, d), GEO)
    x = table(spark, d, "customer")
    q = x.select(F.col("c_custkey").alias("query_id"), T.normalize(F.concat(F.lit("History of "), "c_name")).alias("norm"))
    return resolve.agreed(resolve.named_terms(q, c), c)


def geo_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Orders as contexts: the customer's nation, segment, both, region or nothing is resolved."""
    o, c, n, r = (table(spark, d, x) for x in ("orders", "customer", "nation", "region"))
    x = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    k = F.col("o_custkey") % 5
    return x.select(F.col("o_orderkey").alias("query_id"), F.array(F.when(k == 3, F.col("r_name")), F.when(k.isin(0, 2), F.col("n_name")), F.when(k.isin(1, 2), F.col("c_mktsegment"))).alias("resolved"))


X_SQL = f"""{G_SQL}, {N_SQL}, sa AS (SELECT child_level, child_value, parent_level, min(parent_value) AS parent_value FROM n GROUP BY ALL HAVING count(*) = 1),
e0 AS (SELECT o_orderkey AS query_id, CASE WHEN o_custkey % 5 = 3 THEN r_name END AS r0, CASE WHEN o_custkey % 5 IN (0, 2) THEN n_name END AS r1, CASE WHEN o_custkey % 5 IN (1, 2) THEN c_mktsegment END AS r2 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
e1 AS (SELECT query_id, coalesce(r0, a.parent_value, b.parent_value) AS r0, coalesce(r1, c.parent_value) AS r1, r2 FROM e0
 LEFT JOIN sa a ON a.child_level = 1 AND a.child_value = r1 AND a.parent_level = 0 LEFT JOIN sa b ON b.child_level = 2 AND b.child_value = r2 AND b.parent_level = 0 LEFT JOIN sa c ON c.child_level = 2 AND c.child_value = r2 AND c.parent_level = 1),
gt AS (SELECT DISTINCT l0, l1, l2 FROM g),
e2 AS (SELECT query_id, r0, r1, r2, CASE WHEN r2 IS NOT NULL THEN NULL WHEN r1 IS NOT NULL THEN 2 WHEN r0 IS NOT NULL THEN 1 ELSE 0 END AS next_level FROM e1),
e3 AS (SELECT query_id, r0, r1, r2, next_level, array_to_string(list(DISTINCT v ORDER BY v) FILTER (v IS NOT NULL), ',') AS next_values FROM (
 SELECT e2.*, CASE next_level WHEN 0 THEN l0 WHEN 1 THEN l1 WHEN 2 THEN l2 END AS v FROM e2 LEFT JOIN gt ON next_level = 0 OR (next_level = 1 AND l0 = r0) OR (next_level = 2 AND l1 = r1 AND (r0 IS NULL OR l0 = r0))) GROUP BY ALL)"""


def _flat(x: DataFrame) -> DataFrame:
    return x.select("query_id", *(F.get("resolved", F.lit(i)).alias(f"r{i}") for i in range(3)))


@query(f"WITH {X_SQL} SELECT query_id, r0, r1, r2 FROM e1")
def cascade(spark, d):
    return _flat(resolve.cascade(geo_contexts(spark, d), resolve.Catalog.of(geo(spark, d), GEO)))


@query(f"WITH {X_SQL} SELECT query_id, next_level, coalesce(next_values, '') AS next_values FROM e3")
def candidate_next(spark, d):
    c = resolve.Catalog.of(geo(spark, d), GEO)
    return resolve.candidates(resolve.cascade(geo_contexts(spark, d), c), c).select("query_id", "next_level", F.array_join("next_values", ",").alias("next_values"))


@query("""WITH p AS (SELECT DISTINCT p_type, p_brand FROM part), one AS (SELECT p_type, min(p_brand) AS b, count(*) AS n FROM p WHERE p_type IS NOT NULL GROUP BY p_type)
SELECT DISTINCT part.p_type, CASE WHEN n = 1 THEN b END AS pinned FROM part JOIN one ON part.p_type = one.p_type""")
def auto_pin(spark, d):
    docs = parts(spark, d)
    types = docs.select(F.col("levels.type").alias("p_type")).distinct().where("p_type is not null")
    x = types.select(F.col("p_type").alias("query_id"), F.array(F.col("p_type"), F.lit(None).cast("string")).alias("resolved"))
    return resolve.auto_pin(x, resolve.Catalog.of(docs, ["type", "brand"])).select(F.col("query_id").alias("p_type"), F.get("resolved", F.lit(1)).alias("pinned"))


@query(f"""WITH {X_SQL}, f AS (SELECT query_id, r0, r1, r2, 'orders in Asia' AS b FROM e1), f0 AS (SELECT *, CASE WHEN r0 IS NULL OR contains(lower(b), lower(r0)) THEN b ELSE r0 || ' ' || b END AS q0 FROM f),
f1 AS (SELECT *, CASE WHEN r1 IS NULL OR contains(lower(q0), lower(r1)) THEN q0 ELSE r1 || ' ' || q0 END AS q1 FROM f0), f2 AS (SELECT *, CASE WHEN r2 IS NULL OR contains(lower(q1), lower(r2)) THEN q1 ELSE r2 || ' ' || q1 END AS q2 FROM f1)
SELECT query_id, q2 AS effective_query, coalesce(r0, '') || '::' || coalesce(r1, '') || '::' || coalesce(r2, '') AS signature, CAST((r0 IS NOT NULL)::INT + (r1 IS NOT NULL)::INT + (r2 IS NOT NULL)::INT AS INTEGER) AS resolved_count,
'retrieval-' || sha256(lower(q2) || '::v1::' || coalesce(r0, '') || '::' || coalesce(r1, '') || '::' || coalesce(r2, '')) AS cache_key FROM f2""")
def effective_query(spark, d):
    x = resolve.cascade(geo_contexts(spark, d), resolve.Catalog.of(geo(spark, d), GEO))
    x = x.withColumn("q", T.enrich(F.lit("orders in Asia"), F.col("resolved")))
    sign = T.signature(F.col("resolved"))
    return x.select("query_id", F.col("q").alias("effective_query"), sign.alias("signature"), T.resolved_count(F.col("resolved")).alias("resolved_count"), T.cache_key(F.col("q"), F.lit("v1"), sign).alias("cache_key"))


@query(f"""WITH {T_SQL}, pn AS (SELECT query_id, level, min(value) AS v FROM x GROUP BY query_id, level HAVING count(*) = 1), al AS (SELECT DISTINCT lang, source, doc_id, {NORM.format("concat(doc_id, '.txt')")} AS f, {NORM.format('doc_id::VARCHAR')} AS s FROM documents),
hx AS (SELECT DISTINCT m.query_id, al.lang, al.source FROM m JOIN al ON contains(m.norm, al.f) OR contains(m.norm, al.s) OR contains(m.norm, {NORM.format('al.lang')}) OR contains(m.norm, {NORM.format('al.source')})),
ag AS (SELECT query_id, CASE WHEN count(DISTINCT lang) = 1 THEN min(lang) END AS l, CASE WHEN count(DISTINCT source) = 1 THEN min(source) END AS s FROM hx GROUP BY query_id),
rs AS (SELECT m.query_id, coalesce(a.v, ag.l) AS r0, coalesce(b.v, ag.s) AS r1 FROM m LEFT JOIN pn a ON m.query_id = a.query_id AND a.level = 0 LEFT JOIN pn b ON m.query_id = b.query_id AND b.level = 1 LEFT JOIN ag ON m.query_id = ag.query_id),
up AS (SELECT source, min(lang) AS lang FROM documents GROUP BY source HAVING count(DISTINCT lang) = 1), dn AS (SELECT lang, min(source) AS source FROM documents GROUP BY lang HAVING count(DISTINCT source) = 1)
SELECT rs.query_id, coalesce(rs.r0, up.lang) AS r0, coalesce(rs.r1, dn.source) AS r1 FROM rs LEFT JOIN up ON rs.r1 = up.source LEFT JOIN dn ON coalesce(rs.r0, up.lang) = dn.lang""")
def resolve_queries(spark, d):
    x = resolve.resolve(talk(spark, d), resolve.Catalog.of(documents(spark, d), DOC))
    return x.select("query_id", F.get("resolved", F.lit(0)).alias("r0"), F.get("resolved", F.lit(1)).alias("r1"))


@query(f"WITH {C_SQL} SELECT query_id, attempt, reason, allow_broaden, concat_ws(',', 'fam=' || fam, 'lab=' || lab) AS filters FROM p")
def plan_resolve(spark, d):
    return resolve_plan(contexts(spark, d), CHUNK).select("query_id", "attempt", "reason", "allow_broaden", F.array_join(F.transform("pairs", lambda p: F.concat(p["key"], F.lit("="), p["value"])), ",").alias("filters"))


SETS = [(), ("fam",), ("fam", "lab"), ("lab",)]


def _others(attempts: DataFrame, c: DataFrame | Store, sets: list[tuple[str, ...]], k: int = search.TOP_K) -> DataFrame:
    """The best k of all chunks but the query's own vector: a row more is searched, as the own one may be among them."""
    best = Window.partitionBy("query_id", "attempt").orderBy("rank")
    found = search.search(attempts, c, sets, k + 1).where("error is not null or chunk_id <> query_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _find(spark, d, k=search.TOP_K):
    store, vectors = Store.of(chunks(spark, d), CHUNK), contexts(spark, d).select("query_id", "vector")
    return lambda attempts: search.hits(_others(attempts.join(vectors, "query_id"), store, SETS, k), store.rows, CHUNK)


@query(f"WITH {S_SQL} SELECT query_id, attempt, rank, chunk_id, round(score, 6) AS score FROM h")
def filtered_topk(spark, d):
    x = resolve_plan(contexts(spark, d), CHUNK).join(contexts(spark, d).select("query_id", "vector"), "query_id")
    return _others(x, chunks(spark, d), SETS).select("query_id", "attempt", "rank", "chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {S_SQL} SELECT h.query_id, h.rank, h.chunk_id, round(h.score, 6) AS score FROM h JOIN p ON h.query_id = p.query_id AND h.attempt = p.attempt WHERE p.reason = 'global_fallback'")
def baseline_topk(spark, d):
    x = contexts(spark, d).select("query_id", "vector", F.lit(1).alias("attempt"), T.pair_array([], []).alias("pairs"))
    return _others(x, chunks(spark, d), [()]).select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def _summaries(spark, d):
    plan = resolve_plan(contexts(spark, d), CHUNK)
    return plan, retrieve.summarise(plan, _find(spark, d)(plan), LOW)


@query(f"WITH {A_SQL} SELECT query_id, attempt, result_count, round(top_score, 6) AS top_score, confidence FROM b")
def confidence_tier(spark, d):
    return _summaries(spark, d)[1].select("query_id", "attempt", F.col("result_count").cast("long").alias("result_count"), F.round("top_score", 6).alias("top_score"), "confidence")


def _outcomes(spark, d):
    plan = resolve_plan(contexts(spark, d), CHUNK)
    return retrieve.choose(retrieve.run(plan, _find(spark, d), LOW))


@query(f"WITH {A_SQL} SELECT query_id, attempt, reason, confidence, round(top_score, 6) AS top_score, attempts_made, confidence IN ('high', 'medium') AND result_count > 0 AS should_answer FROM o")
def fallback_select(spark, d):
    return _outcomes(spark, d).select("query_id", "attempt", "reason", "confidence", F.round("top_score", 6).alias("top_score"), "attempts_made", "should_answer")


@query(f"WITH {A_SQL} SELECT query_id, CASE WHEN confidence IN ('high', 'medium') THEN result_count ELSE 0 END AS chunks_forwarded, CASE WHEN confidence IN ('high', 'medium') THEN CAST(chars AS BIGINT) ELSE 0 END AS snippet_chars FROM o")
def token_gate(spark, d):
    return report.metrics(_outcomes(spark, d)).select("query_id", F.col("chunks_forwarded").cast("long").alias("chunks_forwarded"), F.col("snippet_chars").cast("long").alias("snippet_chars"))


@query(f"""WITH {A_SQL}, fl AS (SELECT b.* FROM b WHERE reason = 'global_fallback'), j AS (SELECT o.query_id, o.confidence, o.attempts_made, o.top_score, fl.top_score AS flat_top,
 CASE WHEN o.confidence IN ('high', 'medium') THEN o.result_count ELSE 0 END AS ef, CASE WHEN fl.confidence IN ('high', 'medium') THEN fl.result_count ELSE 0 END AS ff FROM o JOIN fl ON o.query_id = fl.query_id)
SELECT count(*) AS queries, CAST(count_if(confidence = 'high') AS BIGINT) AS high, CAST(count_if(confidence = 'medium') AS BIGINT) AS medium, CAST(count_if(confidence IN ('low', 'none')) AS BIGINT) AS low_or_none, round(avg(flat_top), 6) AS flat_top_score, round(avg(top_score), 6) AS engine_top_score, CAST(count_if(attempts_made = 1) AS BIGINT) AS first_attempt,
round(CASE WHEN avg(ff) = 0 THEN 0 ELSE (avg(ef) - avg(ff)) / avg(ff) * 100 END, 6) AS forwarded_change FROM j""")
def report_summary(spark, d):
    q = contexts(spark, d).select("query_id", F.lit(1).alias("attempt"), F.lit("baseline").alias("reason"), F.lit("").alias("description"), F.lit(False).alias("allow_broaden"), T.pair_array([], []).alias("pairs"), F.lit(1).alias("planned"))
    flat = retrieve.choose(retrieve.run(q, _find(spark, d), LOW))
    s = report.summary(report.compare(report.metrics(flat), report.metrics(_outcomes(spark, d))))
    return s.select("queries", "high", "medium", "low_or_none", *(F.round(c, 6).alias(c) for c in ("flat_top_score", "engine_top_score")), "first_attempt", F.round("forwarded_change", 6).alias("forwarded_change"))


@query(f"""WITH {A_SQL}, lb AS (SELECT fam, list(DISTINCT lab ORDER BY lab) AS labs FROM c GROUP BY fam), cx AS (SELECT q.query_id, q.fam FROM q WHERE q.fam IS NOT NULL AND q.lab IS NULL),
rv AS (SELECT h.query_id, h.lab, min(h.rank) AS pos FROM h JOIN o ON h.query_id = o.query_id AND h.attempt = o.attempt JOIN cx ON h.query_id = cx.query_id JOIN lb ON lb.fam = cx.fam WHERE list_contains(lb.labs, h.lab) GROUP BY h.query_id, h.lab),
rk AS (SELECT query_id, list(lab ORDER BY pos) AS labs FROM rv GROUP BY query_id)
SELECT cx.query_id, 'lab' AS level, array_to_string(list_transform((coalesce(rk.labs, lb.labs))[1:4], lambda l: upper(l[1]) || l[2:]), ',') AS labels FROM cx JOIN lb ON lb.fam = cx.fam LEFT JOIN rk ON rk.query_id = cx.query_id WHERE len(lb.labs) > 1 AND (rk.labs IS NULL OR len(rk.labs) <> 1)
UNION ALL SELECT q.query_id, 'fam', (SELECT array_to_string(list_transform(list(DISTINCT fam ORDER BY fam)[1:4], lambda l: upper(l[1]) || l[2:]), ',') FROM c) FROM q JOIN o ON q.query_id = o.query_id WHERE q.fam IS NULL AND o.confidence NOT IN ('high', 'medium')
UNION ALL SELECT query_id, 'fam', array_to_string(list_transform(list(fam ORDER BY pos)[1:4], lambda l: upper(l[1]) || l[2:]), ',') FROM (
 SELECT q.query_id, h.fam, min(h.rank) AS pos FROM q JOIN o ON q.query_id = o.query_id JOIN h ON h.query_id = o.query_id AND h.attempt = o.attempt WHERE q.fam IS NULL AND o.confidence IN ('high', 'medium') GROUP BY ALL) GROUP BY query_id""")
def clarify_options(spark, d):
    c = chunks(spark, d).select(F.col("chunk_id").cast("string").alias("relative_path"), levels_of(CHUNK, F.col("fam"), F.col("lab")).alias("levels"), F.array().cast("array<string>").alias("aliases"), "filename")
    held = resolve.Catalog.of(c, CHUNK)
    x = resolve.candidates(contexts(spark, d).drop("vector"), held).withColumns({"matched": F.array(F.array().cast("array<string>"), F.array().cast("array<string>")), "effective_query": F.lit("q"), "clarification_count": F.lit(0)})
    outcomes = _outcomes(spark, d)
    unsure = F.size("clarification.options") > 0
    found = clarify.clarify(x, outcomes, corpus.level_values(c, CHUNK).where("level = 0"), CHUNK)
    return found.where(unsure).select("query_id", F.get("clarification.options.level", F.lit(0)).alias("level"), F.array_join("clarification.options.label", ",").alias("labels"))


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Orders as cache entries: a key a customer, the version from the year."""
    o = table(spark, d, "orders")
    return o.select(F.concat(F.lit("k"), (F.col("o_custkey") % 500).cast("string")).alias("key"), F.col("o_orderkey").alias("seq"), F.year("o_orderdate").cast("string").alias("corpus_version"), F.col("o_orderpriority").alias("reason"))


E_SQL = "ce AS (SELECT 'k' || (o_custkey % 500) AS key, o_orderkey AS seq, CAST(year(o_orderdate) AS VARCHAR) AS corpus_version, o_orderpriority AS reason FROM orders)"


@query(f"WITH {E_SQL}, ks AS (SELECT 'k' || c_custkey AS key FROM customer) SELECT ks.key, e.seq, e.reason FROM ks LEFT JOIN (SELECT * FROM ce QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) e ON ks.key = e.key")
def cache_lookup(spark, d):
    keys = table(spark, d, "customer").select(F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("key"))
    hit, miss = cache.lookup(keys, entries(spark, d))
    return hit.select("key", "seq", "reason").unionByName(miss.select("key"), allowMissingColumns=True)


@query(f"WITH {E_SQL} SELECT * FROM ce WHERE corpus_version = '1995'")
def cache_prune(spark, d):
    return cache.pruned(entries(spark, d), "1995")


@query(f"WITH {E_SQL}, f AS (SELECT key, min(seq) AS first, max(seq) AS seq FROM ce GROUP BY key ORDER BY first DESC, key LIMIT 100) SELECT f.key, f.seq, ce.reason FROM f JOIN ce ON f.key = ce.key AND f.seq = ce.seq")
def cache_evict(spark, d):
    return cache.evicted(entries(spark, d), 100).select("key", "seq", "reason")


def forged(spark: SparkSession, d: str) -> DataFrame:
    """A manifest with repeated rows, missing levels and null levels worked in."""
    rows = corpus.manifest(documents(spark, d), DOC).withColumn("n", F.regexp_extract("filename", r"^(\d+)", 1).cast("long"))
    meta = F.when(F.col("n") % 11 == 0, F.map_filter("metadata", lambda k, _: k != "source")).when(F.col("n") % 13 == 0, F.transform_values("metadata", lambda k, v: F.when(k != "lang", v))).otherwise(F.col("metadata"))
    rows = rows.withColumn("metadata", meta)
    return rows.unionByName(rows.where("n % 17 = 0"))


@query(f"""WITH {D_SQL}, f AS (SELECT *, substr(sha1(relative_path), 1, 16) AS doc_id FROM d UNION ALL SELECT *, substr(sha1(relative_path), 1, 16) FROM d WHERE n % 17 = 0)
SELECT 'duplicate doc_id' AS kind, doc_id AS subject, CAST(NULL AS VARCHAR) AS detail FROM d2 UNION ALL SELECT 'duplicate relative_path', relative_path, NULL FROM d2
UNION ALL SELECT 'missing level', relative_path, 'source' FROM f WHERE n % 11 = 0 UNION ALL SELECT 'null level', relative_path, 'lang' FROM f WHERE n % 13 = 0 AND n % 11 <> 0 UNION ALL SELECT 'missing file', relative_path, NULL FROM f WHERE n % 19 = 0""".replace("WITH d AS", "WITH d2 AS (SELECT concat_ws('/', lang, source, concat(doc_id, '.txt')) AS relative_path, substr(sha1(concat_ws('/', lang, source, concat(doc_id, '.txt'))), 1, 16) AS doc_id FROM documents WHERE documents.doc_id % 17 = 0), d AS"))
def manifest_issues(spark, d):
    rows = forged(spark, d)
    return corpus.issues(rows, DOC, rows.where("n % 19 <> 0"), complete=True)


@query("""SELECT e.vec_id AS chunk_id, d.lang, d.source, concat(d.doc_id, '.txt') AS filename, CAST(2 + (d.lang IS NOT NULL)::INT + (d.source IS NOT NULL)::INT + 2 AS INTEGER) AS fields FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id""")
def chunk_stamp(spark, d):
    docs = documents(spark, d).withColumn("n", F.regexp_extract("filename", r"^(\d+)", 1).cast("long"))
    rows = corpus.manifest(docs, DOC)
    x = table(spark, d, "embeddings").join(docs.select("n", "doc_id"), F.col("vec_id") == F.col("n")).select(F.col("vec_id").alias("chunk_id"), "doc_id", F.concat(F.lit("chunk "), F.col("vec_id").cast("string")).alias("text"))
    return corpus.stamp(x, rows, DOC).select("chunk_id", "lang", "source", "filename", F.size("metadata").alias("fields"))


def _decoded(frame: DataFrame, column: str, extractor: extract.Extractor) -> DataFrame:
    """Adds `out`, a file's text from its bytes."""
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: None if x is None else extractor(x))

    return frame.withColumn("out", F.pandas_udf(run, "string")(F.col(column).cast("binary")))


@query()
def html_text(spark, d):
    return _decoded(table(spark, d, "pages"), "html", extract.html).select("page_id", F.col("out").alias("text"))


@query("SELECT event_id, CASE WHEN props IS NULL THEN NULL ELSE array_to_string(list_transform(json_keys(props), lambda k: k || ': ' || json_extract_string(props, '$.' || k)), chr(10)) END AS text FROM events")
def json_flatten(spark, d):
    return _decoded(table(spark, d, "events"), "props", extract.flat_json).select("event_id", F.col("out").alias("text"))


@query("""SELECT r_regionkey, 'row 1: n_nationkey: ' || list_extract(list(n_nationkey ORDER BY n_nationkey), 1) || ' | n_name: ' || list_extract(list(n_name ORDER BY n_nationkey), 1) AS first_row, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey""")
def csv_render(spark, d):
    n = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("rows"))
    text = F.concat(F.lit("n_nationkey,n_name\n"), F.array_join(F.transform("rows", lambda r: F.concat_ws(",", r["n_nationkey"].cast("string"), r["n_name"])), "\n"))
    x = _decoded(n.withColumn("file", text), "file", extract.rendered_csv)
    lines = F.split("out", "\n")
    return x.select("r_regionkey", F.get(lines, F.lit(0)).alias("first_row"), F.size(lines).cast("long").alias("n"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return fallback_select(spark, d)
