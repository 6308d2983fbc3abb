"""One query for each operator, over its whole table with production parameters, and its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topograph.llm import audio, bpe, divergence, jaccard, langid, mixing, scoring, simhash, substrings, token_file, topk, toxicity, vector_codes
from topograph.workers import reach


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reach(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search_embeddings(_table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op4_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.digests(_table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = mixing.mix(_table(spark, sf_dir, "documents"))
    return x.select("doc_id", "source", F.col("_pass").alias("pass"), F.col("_at_block").alias("block"), F.col("_at_slot").alias("slot"))


OP6_SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents
), k AS (
  SELECT doc_id, source, n, CAST('0x' || substr(h, 1, 3) AS BIGINT) AS block, CAST('0x' || substr(h, 4, 12) AS BIGINT) AS slot FROM d
), s AS (
  SELECT source, CAST(sum(n) AS BIGINT) AS tokens FROM k GROUP BY source
), a AS (
  SELECT max(tokens) AS most, CASE WHEN max(tokens) <= 1.5 * min(tokens) FILTER (tokens > 0) THEN 0.0 ELSE 1 - ln(1.5) / ln(max(tokens) / min(tokens) FILTER (tokens > 0)) END AS alpha FROM s
), b AS (
  SELECT source, tokens, CASE WHEN tokens > 0 THEN CAST(floor(tokens * pow(CAST(most AS DOUBLE) / tokens, 1 - alpha) + 1e-6) AS BIGINT) ELSE 0 END AS due FROM s, a
), p AS (
  SELECT source, tokens, CASE WHEN tokens > 0 THEN due // tokens ELSE 1 END AS passes, CASE WHEN tokens > 0 THEN due % tokens ELSE 0 END AS rest FROM b
), t AS (
  SELECT source, passes, rest, md5('17:pass' || CAST(passes + 1 AS VARCHAR)) AS h FROM p
), r AS (
  SELECT k.doc_id, k.source, k.block, k.slot, t.passes, t.rest,
         sum(k.n) OVER (PARTITION BY k.source ORDER BY xor(k.block, CAST('0x' || substr(t.h, 1, 3) AS BIGINT)), xor(k.slot, CAST('0x' || substr(t.h, 4, 12) AS BIGINT)) RANGE UNBOUNDED PRECEDING) AS running
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
), e AS (
  SELECT doc_id, source, block, slot, unnest(range(1, CAST(passes + CASE WHEN running <= rest THEN 1 ELSE 0 END AS BIGINT) + 1)) AS pass FROM r
)
SELECT doc_id, source, CAST(pass AS INTEGER) AS pass,
       xor(block, CAST('0x' || substr(md5('17:pass' || CAST(pass AS VARCHAR)), 1, 3) AS BIGINT)) AS block,
       xor(slot, CAST('0x' || substr(md5('17:pass' || CAST(pass AS VARCHAR)), 4, 12) AS BIGINT)) AS slot FROM e"""


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove(_table(spark, sf_dir, "documents"), digest=True)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.round_trip(_table(spark, sf_dir, "documents"))


def op9_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    chain = toxicity.train(docs, toxicity.labelled(_table(spark, sf_dir, "labels")))
    return toxicity.predict(docs, chain).withColumn("toxic", F.col("p_toxic") >= 0.5)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = scoring.score_corpus(_table(spark, sf_dir, "documents"))
    return x.select("doc_id", "n_words", F.round("logprob", 4).alias("logprob"), F.round("score", 6).alias("score"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws FROM documents
), t AS (SELECT id, lang, source, translate(unnest(ws), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT t.lang, t.source, t.term, count(*) AS c FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
m AS (SELECT g.lang, g.source, coalesce(sum(o.c), 0) AS n FROM g LEFT JOIN o ON g.lang = o.lang AND g.source = o.source GROUP BY ALL),
p AS (
  SELECT m.lang, m.source, k.term, coalesce(o.c, 0) AS c, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(o.c, 0) + 5)) // (m.n + 5 * v.v) AS p, 1 + (CAST(1000000000 AS HUGEINT) * (k.c + 5)) // (v.n + 5 * v.v) AS q
  FROM m JOIN k ON m.lang = k.lang JOIN v ON m.lang = v.lang LEFT JOIN o ON m.lang = o.lang AND m.source = o.source AND k.term = o.term
), f AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(sum(abs(a.p - b.p)), 0) AS BIGINT) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN p a ON a.lang = x.lang AND a.source = x.source LEFT JOIN p b ON b.lang = a.lang AND b.source = y.source AND b.term = a.term GROUP BY ALL
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE c > 0 AND p > q
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM f)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


def _op13_sql() -> str:
    """The rounds one after the other; distances are sums of products of whole numbers that doubles hold exactly."""
    near = """SELECT v.vec_id, v.label, v.p, v.x, min({{'d': CAST(list_dot_product(v.x, v.x) - 2 * list_dot_product(v.x, b.x) + list_dot_product(b.x, b.x) AS BIGINT), 'e': b.e}}) AS m
  FROM v JOIN b{0} b ON v.p = b.p GROUP BY ALL"""
    steps = [f"""a{r} AS ({near.format(r)}),
s{r} AS (SELECT p, m.e AS e, i, CAST(floor(sum(x[i]) / count(*)) AS DOUBLE) AS c FROM a{r}, unnest(range(1, len(x) + 1)) t(i) GROUP BY ALL),
n{r} AS (SELECT p, e, list(c ORDER BY i) AS x FROM s{r} GROUP BY ALL),
b{r + 1} AS (SELECT b.p, b.e, coalesce(n.x, b.x) AS x FROM b{r} b LEFT JOIN n{r} n ON b.p = n.p AND b.e = n.e)""" for r in range(4)]
    return f"""
WITH w AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS MATERIALIZED (SELECT vec_id, label, p, w[p * len(w) // 4 + 1:(p + 1) * len(w) // 4] AS x FROM w, unnest(range(0, 4)) t(p)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM v QUALIFY e < 256),
{", ".join(steps)},
a4 AS ({near.format(4)}),
c AS (SELECT vec_id, label, string_agg(lpad(lower(to_hex(m.e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a4 GROUP BY ALL),
h AS (SELECT sha256(string_agg(CAST(CAST(x[i] AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM b4, unnest(range(1, len(x) + 1)) t(i))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c, h"""


OP13_SQL = _op13_sql()

WORDS_SQL = r"w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)"
OP5_SQL = f"""
WITH RECURSIVE {WORDS_SQL}, s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 3, CAST(len(ws) > 0 AS BIGINT) + 1))) t(i)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE c * 9 >= 4 * (a.n + b.n)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT w.doc_id, least(w.doc_id, coalesce(r.first, w.doc_id)) AS class_id, coalesce(k.n, 0) AS n_links
FROM w LEFT JOIN (SELECT x, min(y) AS first FROM r GROUP BY x) r ON w.doc_id = r.x LEFT JOIN (SELECT x, count(*) AS n FROM l GROUP BY x) k ON w.doc_id = k.x"""
OP7_SQL = f"""
WITH {WORDS_SQL}, x AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS g FROM w, unnest(range(1, len(ws) - 18)) t(i)
), f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM x),
g AS (SELECT DISTINCT doc_id, i + k AS pos FROM f, unnest(range(0, 20)) t(k) WHERE n > 1),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w)
SELECT w.doc_id, len(w.ws) AS n_words, count(g.pos) AS n_removed, sha256(coalesce(string_agg(p.word, ' ' ORDER BY p.pos) FILTER (g.pos IS NULL), '')) AS kept_sha256
FROM w LEFT JOIN p ON w.doc_id = p.doc_id LEFT JOIN g ON p.doc_id = g.doc_id AND p.pos = g.pos GROUP BY w.doc_id, len(w.ws)"""
OP10_SQL = f"""
WITH {WORDS_SQL}, p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
q AS (SELECT doc_id, pos, word, lag(word) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM p),
ou AS (SELECT doc_id, word, count(*) AS n FROM p GROUP BY ALL), u AS (SELECT word, sum(n) AS n FROM ou GROUP BY word),
ob AS (SELECT doc_id, before, word, count(*) AS n FROM q WHERE before IS NOT NULL GROUP BY ALL), b AS (SELECT before, word, sum(n) AS n FROM ob GROUP BY ALL),
t AS (SELECT count(*) AS n FROM p), l AS (SELECT doc_id, len(ws) AS n FROM w),
g AS (SELECT q.doc_id, q.before IS NULL AS first, coalesce(b.n - ob.n, 0) AS pair, c.n - oc.n AS context, greatest(u.n - ou.n, 1) AS one, greatest(t.n - l.n, 1) AS total
  FROM q JOIN t ON true JOIN l ON q.doc_id = l.doc_id JOIN u ON q.word = u.word JOIN ou ON q.doc_id = ou.doc_id AND q.word = ou.word
  LEFT JOIN b ON q.before = b.before AND q.word = b.word LEFT JOIN ob ON q.doc_id = ob.doc_id AND q.before = ob.before AND q.word = ob.word
  LEFT JOIN u c ON q.before = c.word LEFT JOIN ou oc ON q.doc_id = oc.doc_id AND q.before = oc.word),
s AS (SELECT doc_id, count(*) AS n_words, sum(CASE WHEN first THEN ln(one / total) WHEN pair > 0 THEN ln(pair / context) ELSE ln(0.4) + ln(one / total) END) AS logprob FROM g GROUP BY doc_id)
SELECT w.doc_id, coalesce(s.n_words, 0) AS n_words, round(coalesce(s.logprob, 0), 4) AS logprob, round(s.logprob / s.n_words, 6) AS score FROM w LEFT JOIN s ON w.doc_id = s.doc_id"""


QUERIES = {f.__name__: f for f in (op1_exact_top_k, op2_byte_bpe, op3_language_id, op4_audio_features, op5_jaccard_join, op6_temperature_mix, op7_substring_dedup, op8_token_files, op9_toxicity_chain, op10_lm_scoring, op11_simhash, op12_source_divergence, op13_vector_codes)}
SQL: dict[str, str] = {"op1_exact_top_k": OP1_SQL, "op5_jaccard_join": OP5_SQL, "op6_temperature_mix": OP6_SQL, "op7_substring_dedup": OP7_SQL, "op10_lm_scoring": OP10_SQL, "op12_source_divergence": OP12_SQL, "op13_vector_codes": OP13_SQL}
