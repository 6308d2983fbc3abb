"""Questions back to the user where a query is ambiguous."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topograph.functions.confidence import CONFIDENT
from topograph.functions.text import titles

MOST_OPTIONS, MOST_QUESTIONS = 4, 2
#: The wording of questions.
WHICH, ABOUT, REPLY = "Which", " is this about?", "Reply with the option number."


def _named(levels: Sequence[str], level: Column) -> Column:
    return F.get(F.array(*map(F.lit, levels)), level)


def _of_results(level: Column) -> Column:
    """The level's values in order of the results, each once."""
    return F.array_distinct(F.filter(F.transform("results", lambda r: F.element_at(r["metadata"], level)), lambda v: v.isNotNull() & (v != "")))


def _prompt(ask: Column, labels: Column) -> Column:
    lines = F.transform(labels, lambda v, i: F.concat((i + 1).cast("string"), F.lit(". "), v))
    return F.array_join(F.concat(F.array(ask, F.lit("")), lines, F.array(F.lit(""), F.lit(REPLY))), "\n")


def clarify(contexts: DataFrame, outcomes: DataFrame, first_values: DataFrame, levels: Sequence[str], most_options: int = MOST_OPTIONS, most_questions: int = MOST_QUESTIONS) -> DataFrame:
    """query_id and clarification (prompt, options, original_query) of the queries that need one.

    The next level is asked about if it has several candidates and the results don't all point at one; else, if no level
    is resolved, the first one, from what the query named, what confident results have, or all. first_values has value
    and pos of the first level.
    """
    if not levels:
        return contexts.select("query_id").where("false").withColumn("clarification", F.lit(None).cast("string"))
    head = first_values.orderBy("pos").limit(max(2, most_options)).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("_first"))
    x = contexts.join(outcomes.select("query_id", "results", "confidence"), "query_id", "left").where(F.col("clarification_count") < most_questions)
    x = x.withColumn("results", F.coalesce("results", F.array().cast(dict(outcomes.dtypes)["results"])))
    x = x.withColumn("_one", F.lit(1)).join(F.broadcast(head.withColumn("_one", F.lit(1))), "_one").drop("_one")

    next_name = _named(levels, F.col("next_level"))
    pointed = F.array_intersect(_of_results(next_name), F.col("next_values"))
    several = F.col("next_level").isNotNull() & (F.size("next_values") > 1)
    x = x.withColumn("_pointed", F.when(F.col("next_level").isNotNull(), pointed))
    sub = several & ~((F.size("_pointed") == 1) & (F.size("results") > 0))
    open_ = F.forall("resolved", lambda v: v.isNull() | (v == "")) & (F.size("_first") > 1)
    lit = F.lit(levels[0])
    seen = F.array_distinct(F.get("matched", F.lit(0)))
    told = F.when(F.col("confidence").isin(*CONFIDENT), _of_results(lit))
    ranked = F.when(sub, F.when(F.size("_pointed") > 0, F.col("_pointed")).otherwise(F.col("next_values"))).when(open_, F.when(F.size(seen) > 0, seen).when(F.size(told) > 0, told).otherwise(F.col("_first")))
    x = x.withColumns({"_sub": sub, "_values": F.slice(ranked, 1, most_options)}).where("_values is not null")
    anchor = F.try_element_at(F.filter("resolved", lambda v: v.isNotNull() & (v != "")), F.lit(-1))
    x = x.withColumn("_level", F.when(F.col("_sub"), next_name).otherwise(lit)).withColumn("_labels", titles("_values")).withColumn("_anchor", F.get(titles(F.array(anchor)), F.lit(0)))
    resolved = F.when(F.col("_sub"), F.map_from_arrays(F.array(*map(F.lit, levels)), F.col("resolved")))
    options = F.transform("_values", lambda v, i: F.struct((i + 1).cast("string").alias("id"), F.get("_labels", i).alias("label"), F.col("_level").alias("level"), v.alias("value"), resolved.alias("resolved")))
    about = F.concat_ws(" ", F.lit(WHICH), F.when(F.col("_sub"), F.col("_anchor")), F.concat(F.col("_level"), F.lit(ABOUT)))
    return x.select("query_id", F.struct(_prompt(about, F.col("_labels")).alias("prompt"), options.alias("options"), F.col("effective_query").alias("original_query")).alias("clarification"))


def attach(outcomes: DataFrame, questions: DataFrame) -> DataFrame:
    """Outcomes with needs_clarification and clarification, whatever their confidence."""
    return outcomes.join(questions, "query_id", "left").withColumn("needs_clarification", F.col("clarification").isNotNull())
