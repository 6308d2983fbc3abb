"""Running a plan: the first attempt, broader ones where it is weak, and the choice among them."""

from __future__ import annotations

import builtins
import logging
import re
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topograph import errors
from topograph.errors import StoreConfigurationError, StoreError
from topograph.functions.confidence import CONFIDENT, Thresholds, should_answer, tier
from topograph.lineage import cut
from topograph.operators.search import HIT


def summarise(attempts: DataFrame, found: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """attempts with results (hits by rank), result_count, top_score, confidence and store_error; those without a hit stay.
    found has query_id, attempt, rank and hit, and error if there can be any. An attempt with an error has no results."""
    error = F.col("error") if "error" in found.columns else F.lit(None).cast("string")
    hit = F.struct("rank", "hit")
    held = found.groupBy("query_id", "attempt").agg(F.max(error).alias("store_error"), F.collect_list(F.when(F.col("hit").isNotNull(), F.col("rank"))).alias("ranks"), F.map_from_entries(F.collect_list(F.when(F.col("hit").isNotNull(), hit))).alias("by_rank"))
    held = held.select("query_id", "attempt", "store_error", F.when(F.col("store_error").isNull(), F.transform(F.array_sort("ranks"), lambda r: F.element_at("by_rank", r))).alias("results"))
    x = attempts.join(held, ["query_id", "attempt"], "left").withColumn("results", F.coalesce("results", F.array().cast(f"array<{HIT}>")))
    n, top, second = F.size("results"), F.get("results.score", F.lit(0)), F.get("results.score", F.lit(1))
    return x.withColumns({"result_count": n, "top_score": F.coalesce(top, F.lit(0.0)), "confidence": tier(top, second, n, thresholds)})


def broadens() -> Column:
    """Whether an attempt that has been summarised asks for the next ones."""
    return F.col("allow_broaden") & ((F.col("result_count") == 0) | ~F.col("confidence").isin(*CONFIDENT))


def run(attempts: DataFrame, find: Callable[[DataFrame], DataFrame], thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Summaries of the first attempts, and of all others of the queries whose first one is weak; both stages are one
    search each, for all queries. find: attempts to (query_id, attempt, rank, hit, and error if it may fail for some).
    Attempts whose search fails have no results; store_error says why. A store that isn't set up as it must be, and
    anything that isn't a store's failure, fails the whole."""
    one = tried(attempts.where("attempt = 1"), find, thresholds)
    rest = attempts.where("attempt > 1").join(one.where(broadens()).select("query_id"), "query_id", "left_semi")
    return one.unionByName(tried(rest, find, thresholds))


def tried(attempts: DataFrame, find: Callable[[DataFrame], DataFrame], thresholds: Thresholds = Thresholds()) -> DataFrame:
    """summarise() of a search that is run here, so that what it raises while it runs is seen as well."""
    try:
        return cut(summarise(attempts, find(attempts), thresholds))
    except StoreConfigurationError:
        raise
    except (StoreError, OSError, PySparkException) as e:
        said = failure(e)
        if said is None:
            raise
    logging.getLogger(__name__).warning("a search failed: %s", said)
    none = attempts.select("query_id", "attempt", F.lit(1).alias("rank"), F.lit(None).cast(HIT).alias("hit")).where("false")
    return cut(summarise(attempts, none, thresholds).withColumn("store_error", F.lit(said)))


def failure(e: BaseException) -> str | None:
    """What a store raised, here or in a worker; null for all that isn't a store's failure, such as an error in a program."""
    if isinstance(e, (StoreError, OSError)):
        return f"{type(e).__name__}: {e}"
    texts, cause = [str(e)], getattr(e, "_origin", None)
    while cause is not None:
        texts.append(cause.getMessage() or "")
        cause = cause.getCause()
    for name, rest in (found for t in texts for found in re.findall(r"^(?:[\w.]+\.)?(\w+): (.*)$", t, re.MULTILINE)):
        kind = getattr(errors, name, None) or getattr(builtins, name, None)
        if isinstance(kind, type) and issubclass(kind, (StoreError, OSError)) and not issubclass(kind, StoreConfigurationError):
            return f"{name}: {rest}"
    return None


def choose(summaries: DataFrame) -> DataFrame:
    """Outcomes: for each query the first attempt with results that is confident or the last resort, else the last one
    with results, else the first. summaries hold the attempts that were made, or more of them."""
    own = Window.partitionBy("query_id")
    some = F.col("result_count") > 0
    good = some & (F.col("confidence").isin(*CONFIDENT) | ~F.col("allow_broaden"))
    seen = summaries.withColumn("_weak", F.max(F.when(F.col("attempt") == 1, broadens())).over(own)).where("_weak or attempt = 1")
    pick = F.coalesce(F.min(F.when(good, F.col("attempt"))).over(own), F.max(F.when(some, F.col("attempt"))).over(own), F.lit(1))
    executed = F.lit(True)
    return seen.withColumn("_pick", pick).where("attempt = _pick").select(
        "query_id", executed.alias("executed"), "attempt", "reason", "confidence", "top_score", F.when(F.col("_weak"), F.col("planned")).otherwise(1).cast("int").alias("attempts_made"), "results", "result_count",
        should_answer(executed, F.col("confidence"), F.col("result_count")).alias("should_answer"), F.lit(False).alias("cache_hit"), (F.col("store_error") if "store_error" in summaries.columns else F.lit(None).cast("string")).alias("error"),
    )


def with_unplanned(outcomes: DataFrame, queries: DataFrame) -> DataFrame:
    """Adds an outcome that wasn't executed for each query without any attempt."""
    left = queries.select("query_id").join(outcomes.select("query_id"), "query_id", "left_anti")
    fixed = {"executed": F.lit(False), "attempt": F.lit(None).cast("int"), "reason": F.lit("no_attempts"), "confidence": F.lit("none"), "top_score": F.lit(0.0), "attempts_made": F.lit(0), "results": F.array().cast(f"array<{HIT}>"), "result_count": F.lit(0), "should_answer": F.lit(False), "cache_hit": F.lit(False), "error": F.lit("the plan has no attempts")}
    return outcomes.unionByName(left.select("query_id", *(v.alias(k) for k, v in fixed.items())))
