"""Comparing filtered retrieval with one unfiltered search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topograph.functions.confidence import forwarded

MEASURES = ("attempts_made", "top_score", "confidence", "result_count", "chunks_forwarded", "snippet_chars")


def metrics(outcomes: DataFrame) -> DataFrame:
    """One row a query: what was found, and what passes the gate."""
    chars = F.aggregate("results", F.lit(0), lambda n, r: n + F.length(r["snippet"]))
    return outcomes.select("query_id", "attempts_made", "top_score", "confidence", "result_count", forwarded(F.col("confidence"), F.col("result_count")).alias("chunks_forwarded"), forwarded(F.col("confidence"), chars).alias("snippet_chars"), "cache_hit")


def compare(flat: DataFrame, engine: DataFrame) -> DataFrame:
    """Both metrics of each query side by side, as flat_* and engine_*."""
    return flat.select("query_id", *(F.col(m).alias(f"flat_{m}") for m in MEASURES)).join(engine.select("query_id", *(F.col(m).alias(f"engine_{m}") for m in MEASURES)), "query_id")


def summary(compared: DataFrame) -> DataFrame:
    """One row: means, tiers (low holds none too), queries done at attempt 1, and changes in percent (0 from 0)."""
    change = lambda m: F.coalesce(F.try_divide(F.avg(f"engine_{m}") - F.avg(f"flat_{m}"), F.avg(f"flat_{m}")) * 100, F.lit(0.0))
    means = [F.avg(f"{side}_{m}").alias(f"{side}_{m}") for m in ("top_score", "chunks_forwarded", "snippet_chars") for side in ("flat", "engine")]
    tiers = [F.count_if(F.col("engine_confidence").isin(*own)).alias(name) for name, own in (("high", ["high"]), ("medium", ["medium"]), ("low_or_none", ["low", "none"]))]
    return compared.agg(F.count("*").alias("queries"), *tiers, *means, F.count_if(F.col("engine_attempts_made") == 1).alias("first_attempt"), change("chunks_forwarded").alias("forwarded_change"), change("snippet_chars").alias("chars_change"))


def unexpected(engine: DataFrame, expected: DataFrame) -> DataFrame:
    """Queries whose tier isn't among expected_confidence or that took more than max_attempts."""
    x = engine.join(expected, "query_id")
    return x.where(~F.array_contains("expected_confidence", F.col("confidence")) | (F.col("attempts_made") > F.col("max_attempts")))


def text(compared: DataFrame) -> str:
    """The report as text. A report is of a handful of queries that someone reads."""
    blocks = []
    for r in compared.orderBy("query_id").toLocalIterator():
        lines = [f"{m.replace('_', ' '):<20}{r[f'flat_{m}']!s:>24}{r[f'engine_{m}']!s:>24}" for m in MEASURES]
        blocks.append("\n".join([f"Query {r['query_id']}", f"{'':<20}{'unfiltered':>24}{'filtered':>24}", *lines]))
    s = summary(compared).first()
    if not s["queries"]:
        return ""
    n = s["queries"]
    blocks.append("\n".join([
        f"Summary of {n} queries", f"tiers: high {s['high']}/{n}, medium {s['medium']}/{n}, low or none {s['low_or_none']}/{n}",
        f"mean top score: {s['flat_top_score']:.2f} unfiltered, {s['engine_top_score']:.2f} filtered",
        f"mean chunks forwarded: {s['flat_chunks_forwarded']:.1f}, {s['engine_chunks_forwarded']:.1f} ({s['forwarded_change']:+.1f}%)",
        f"mean snippet characters: {s['flat_snippet_chars']:.0f}, {s['engine_snippet_chars']:.0f} ({s['chars_change']:+.1f}%)", f"done at attempt 1: {s['first_attempt']}/{n}",
    ]))
    return "\n\n".join(blocks)
