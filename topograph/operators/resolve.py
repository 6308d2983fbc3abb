"""Resolving queries against a corpus, a whole batch at a time.

queries has query_id and message, and may have explicit (map of level name to value) and conversation (array of
struct<role,type,content,options array<struct<id,label,level,value,resolved map>>,original_query>). Levels are known on
the driver, so steps over levels are unrolled. Of queries and documents nothing comes to the driver but a vocabulary under
a checked size.

The order of the steps is fixed: explicit values, a reply to a clarification, the only value of a level that occurs in
the query, what the documents agree on that the query names, the only ancestor of a resolved value, and the only
candidate of the next level.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from topograph.functions import beginnings
from topograph.functions import text as T
from topograph.lineage import cut
from topograph.operators import corpus

try:
    import ahocorasick
except ImportError:  # all vocabularies are joined
    ahocorasick = None

HINTS = 4
#: Terms found in queries, for one part of them.
PART_TERMS = 20_000
#: The fields of an option of the older shape.
OLD = ("product", "category", "sub_type")
OPTION = "struct<id:string,label:string,level:string,value:string,resolved:map<string,string>>"
#: Distinct terms, and their bytes, that are broadcast; more are joined.
FEW_TERMS, FEW_BYTES = 200_000, 8 << 20
CONVERSATION = f"array<struct<role:string,type:string,content:string,options:array<{OPTION}>,original_query:string>>"


def _clean(documents: DataFrame) -> DataFrame:
    return documents.withColumn("levels", F.transform_values("levels", lambda _, v: T.strip(v)))


def marks(documents: DataFrame, levels: Sequence[str]) -> DataFrame:
    """term, level and value, for each document's terms and values."""
    return corpus.alias_terms(_clean(documents), corpus.level_array(levels).alias("_at")).select("term", F.posexplode("_at").alias("level", "value")).where("value <> ''")


def leading(terms: DataFrame) -> DataFrame:
    """The first HINTS documents of each term."""
    order = Window.partitionBy("term").orderBy("name", "relative_path")
    return terms.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= HINTS).drop("_n")


def spanning(found: DataFrame) -> DataFrame:
    """The lowest and highest value that a term's documents have at a level."""
    return found.groupBy("term", "level").agg(F.min("value").alias("low"), F.max("value").alias("high"))


@dataclass
class Catalog:
    """What queries are resolved against; keep() holds it for several batches."""

    levels: list[str]
    values: DataFrame
    terms: DataFrame
    tuples: DataFrame
    parents: DataFrame
    leads: DataFrame
    spans: DataFrame
    holders: int = 0

    @classmethod
    def of(cls, documents: DataFrame, levels: Sequence[str], values: DataFrame | None = None) -> Catalog:
        """values: stored (level, value, pos) rows; those of a level that has none are taken from the documents."""
        parts = corpus.spread(documents)
        return cls.made(documents, corpus.alias_terms(documents), leading(corpus.alias_terms(parts)), spanning(marks(parts, levels)), levels, values)

    @classmethod
    def made(cls, shapes: DataFrame, terms: DataFrame, leads: DataFrame, spans: DataFrame, levels: Sequence[str], values: DataFrame | None = None) -> Catalog:
        """shapes has the `levels` that documents have, each at least once."""
        derived = corpus.level_values(shapes, levels)
        values = derived if values is None else values.select("level", "value", "pos").unionByName(derived.join(values.select("level").distinct(), "level", "left_anti"))
        clean = _clean(shapes)
        return cls(list(levels), values.withColumn("norm", T.normalize("value")), terms, corpus.level_tuples(clean, levels), corpus.single_ancestors(clean, levels), leads, spans)

    def _frames(self) -> tuple[DataFrame, ...]:
        return self.values, self.terms, self.tuples, self.parents, self.leads, self.spans

    def keep(self) -> Catalog:
        self.holders += 1
        if self.holders == 1:
            for f in self._frames():
                f.persist()
        return self

    def release(self) -> None:
        """The last of those that keep it lets go of what is held."""
        self.holders = max(self.holders - 1, 0)
        if not self.holders:
            for f in self._frames():
                f.unpersist()


@cache
def _automaton(patterns: frozenset[str]):
    found = ahocorasick.Automaton()
    for p in patterns:
        found.add_word(p, p)
    found.make_automaton()
    return found


def _by_automaton(queries: DataFrame, query: str, patterns: list[str]) -> DataFrame:
    """Queries with _term, for each of the patterns that occur in them: one pass over a query, whatever their number."""
    shared = queries.sparkSession.sparkContext.broadcast(frozenset(patterns))

    def run(batch: pd.Series) -> pd.Series:
        seek = _automaton(shared.value)
        return batch.map(lambda q: [] if q is None else sorted({p for _, p in seek.iter(q)}))

    return queries.withColumn("_term", F.explode(F.pandas_udf(run, "array<string>")(F.col(query))))


def contained(queries: DataFrame, query: str, terms: DataFrame, term: str) -> DataFrame:
    """Pairs where the term is a substring of the query, with no regard to words; an empty term is in nothing.

    A vocabulary under a checked size (FEW_TERMS, FEW_BYTES) is broadcast as an automaton that finds all of its terms in
    one pass. A larger one is joined: by whole terms if they have few lengths (a query's text then stays out of the join),
    else by their beginnings of a few lengths. Of a query's strings of these lengths only those go to the join that a
    filter of the vocabulary's size, up to a bound, lets through, and neither side of it is broadcast, as the planner can't
    know how many they are.
    """
    distinct = terms.where(F.col(term) != "").select(F.col(term).alias("_term")).distinct()
    if ahocorasick is not None:
        size = distinct.limit(FEW_TERMS + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("_term")), F.lit(0)).alias("bytes")).first()
        if size["n"] <= FEW_TERMS and size["bytes"] <= FEW_BYTES:
            found = _by_automaton(queries, query, [r[0] for r in distinct.collect()]) if size["n"] else queries.limit(0).withColumn("_term", F.lit(""))
            return found.join(terms, F.col("_term") == F.col(term)).drop("_term")

    distinct = cut(distinct)
    if not (lengths := beginnings.lengths_of(distinct, "_term")):
        return queries.limit(0).join(terms, F.contains(query, term))
    keyed = distinct.select("_term", beginnings.key_of("_term", lengths).alias("_key"))
    if distinct.where(~F.octet_length("_term").isin(lengths)).isEmpty():  # whole terms
        left = queries.withColumn("_term", F.explode(beginnings.strings_in(queries, query, lengths, beginnings.filter_of(keyed, "_key"))))
        found = left.hint("merge").join(distinct, "_term").select(*queries.columns, "_term")
    else:
        keyed = cut(keyed)
        left = queries.withColumn("_key", F.explode(beginnings.keys_in(queries, query, lengths, beginnings.filter_of(keyed, "_key"))))
        found = left.hint("merge").join(keyed, "_key").where(F.contains(query, "_term")).drop("_key")
    if terms.columns == [term]:
        return found.withColumnRenamed("_term", term)
    return found.hint("merge").join(terms, F.col("_term") == F.col(term)).drop("_term")


def shaped(queries: DataFrame) -> Column:
    """conversation with all fields that an option can have; those that the frame's options lack are null."""
    kind = queries.schema["conversation"].dataType
    there = set(kind.elementType["options"].dataType.elementType.names) if isinstance(kind, ArrayType) else set()
    fields = [f.split(":", 1) for f in ("id:string", "label:string", "level:string", "value:string", "resolved:map<string,string>", *(f"{n}:string" for n in OLD))]

    def option(o: Column) -> Column:
        return F.struct(*((o[n].cast(t) if n in there else F.lit(None).cast(t)).alias(n) for n, t in fields))

    return F.transform("conversation", lambda t: t.withField("options", F.transform(t["options"], option)))


def asked(conversation: Column) -> Column:
    """How many questions have been asked back, by anyone."""
    return F.coalesce(F.greatest(F.size(F.filter(conversation, lambda t: t["type"] == "clarification")), F.lit(0)), F.lit(0))


def reply(message: Column, conversation: Column) -> Column:
    """The option that a message chooses from the last clarification, by id or label, with the question's query."""
    asked = F.try_element_at(F.filter(conversation, lambda t: (t["role"] == "assistant") & (t["type"] == "clarification")), F.lit(-1))
    word = F.lower(T.strip(message))
    chosen = F.get(F.filter(asked["options"], lambda o: (F.lower(o["id"]) == word) | (F.lower(o["label"]) == word)), F.lit(0))
    return F.when(chosen.isNotNull(), F.struct(chosen.alias("option"), asked["original_query"].alias("original_query")))


def _placed(rows: DataFrame, depth: int, value: str = "value") -> Column:
    """Aggregate of (level, value) rows to an array with a place for each level."""
    held = F.map_from_entries(F.collect_list(F.struct("level", value)))
    return F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda i: F.element_at(held, i)) if depth else F.array().cast("array<string>")


def _or(depth: int, *arrays: Column) -> Column:
    """The first given value of each level."""
    return F.array(*(F.coalesce(*(T.given(F.get(a, F.lit(i))) for a in arrays)) for i in range(depth))) if depth else F.array().cast("array<string>")


def pins(queries: DataFrame, catalog: Catalog) -> DataFrame:
    """query_id, level and value of the explicit values (a map by level name): the catalog's first value of the same
    normal form, or the value as it was given. A blank one is none."""
    given = queries.select("query_id", F.posexplode(corpus.level_array(catalog.levels, F.col("explicit"))).alias("level", "raw")).where("raw <> ''")
    same = catalog.values.groupBy("level", "norm").agg(F.min_by("value", "pos").alias("canon"))
    return given.withColumn("norm", T.normalize("raw")).join(same, ["level", "norm"], "left").select("query_id", "level", F.coalesce("canon", "raw").alias("value"))


def answers(chosen: Column, levels: Sequence[str]) -> Column:
    """Level values (array) of a reply's option: its resolved ones and its own. An option without a level is of the
    older shape, which names values in fields of their own."""
    old = {n: chosen[n] for n in OLD}
    own = [F.when(chosen["level"] == n, chosen["value"]).otherwise(F.element_at(chosen["resolved"], F.lit(n))) for n in levels]
    return F.array(*(F.when(chosen["level"].isNull() | chosen["value"].isNull(), old[n]).otherwise(v) if n in old else F.when(chosen["level"].isNotNull() & chosen["value"].isNotNull(), v) for n, v in zip(levels, own, strict=True))) if levels else F.array().cast("array<string>")


def lexical_matches(queries: DataFrame, catalog: Catalog) -> DataFrame:
    """query_id, level and values (in catalog order) that occur in the query's `norm`."""
    pairs = contained(queries.select("query_id", F.col("norm").alias("q")), "q", catalog.values.select("level", "value", "pos", "norm"), "norm")
    return pairs.groupBy("query_id", "level").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("values"))


def named_terms(queries: DataFrame, catalog: Catalog) -> DataFrame:
    """query_id and term: the distinct terms of documents that occur in a query's `norm`, found now. Documents come in only
    by what is known of a term, so a term that all documents share doesn't pair each query with each of them."""
    return cut(contained(queries.select("query_id", F.col("norm").alias("q")), "q", catalog.terms.select("term").distinct(), "term").select("query_id", "term"))


def _dealt(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows that were joined to found terms, whole queries in parts of a bounded number of terms. (Summed before this
    shuffle, a task would hold each of its rows, as hardly two are of one document; and Spark's own parts are bounded in
    packed bytes, of which one may be sixty in memory.)"""
    return rows.repartition(found.count() // PART_TERMS + 1, "query_id")


def hints(found: DataFrame, catalog: Catalog) -> DataFrame:
    """query_id, relative_path, name, score (length of the longest term that occurs) and rank of the HINTS best documents
    named. A document among them is among the first HINTS of its longest term."""
    rows = _dealt(found.join(catalog.leads, "term"), found).groupBy("query_id", "relative_path", "name").agg(F.max(F.length("term")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "name", "relative_path")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= HINTS)


def agreed(found: DataFrame, catalog: Catalog) -> DataFrame:
    """query_id, level and value where all named documents that have the level have one value."""
    rows = _dealt(found.join(catalog.spans, "term"), found).groupBy("query_id", "level").agg(F.min("low").alias("value"), F.max("high").alias("high"))
    return rows.where("value = high").drop("high")


def cascade(contexts: DataFrame, catalog: Catalog) -> DataFrame:
    """Fills unresolved levels from the nearest resolved level below that has one ancestor there."""
    depth = len(catalog.levels)
    children = contexts.select("query_id", F.posexplode("resolved").alias("child_level", "child_value")).where("child_value is not null")
    above = children.join(catalog.parents, ["child_level", "child_value"]).groupBy("query_id", F.col("parent_level").alias("level")).agg(F.min_by("parent_value", "child_level").alias("value"))
    filled = above.groupBy("query_id").agg(_placed(above, depth).alias("_above"))
    return contexts.join(filled, "query_id", "left").withColumn("resolved", _or(depth, F.col("resolved"), F.col("_above"))).drop("_above")


def _deepest(resolved: Column, depth: int) -> Column:
    """Number of the deepest resolved level, -1 without one."""
    return F.coalesce(*(F.when(F.get(resolved, F.lit(i)).isNotNull(), F.lit(i)) for i in range(depth - 1, -1, -1)), F.lit(-1))


def candidates(contexts: DataFrame, catalog: Catalog) -> DataFrame:
    """Adds next_level (its number, null below the last) and next_values: sorted values of the level after the deepest
    resolved one, in documents that agree with all resolved levels above it."""
    depth = len(catalog.levels)
    if not depth:
        return contexts.withColumns({"next_level": F.lit(None).cast("int"), "next_values": F.array().cast("array<string>")})
    rows = contexts.withColumn("_deep", _deepest(F.col("resolved"), depth))
    rows = rows.withColumn("_at", F.when(F.col("_deep") >= 0, F.get("resolved", F.col("_deep"))).otherwise(F.lit("")))
    at = F.array(F.struct(F.lit(-1).alias("_deep"), F.lit("").alias("_at")), *(F.struct(F.lit(i).alias("_deep"), F.get("tuple", F.lit(i)).alias("_at")) for i in range(depth - 1)))
    there = catalog.tuples.select("tuple", F.explode(at).alias("a")).select("tuple", "a.*").withColumn("_next", F.get("tuple", F.col("_deep") + 1)).where("_at is not null and _next <> ''")
    top = there.where("_deep = -1").groupBy("_deep", "_at").agg(F.collect_set("_next").alias("_all"))  # one row: nothing resolved
    some = rows.where("_deep >= 0").join(there.where("_deep >= 0"), ["_deep", "_at"])
    fits = F.forall(F.sequence(F.lit(0), F.lit(depth - 1)), lambda i: (i >= F.col("_deep")) | F.get("resolved", i).isNull() | F.get("resolved", i).eqNullSafe(F.get("tuple", i)))
    some = some.where(fits).groupBy("query_id").agg(F.collect_set("_next").alias("_some"))
    out = rows.join(F.broadcast(top), ["_deep", "_at"], "left").join(some, "query_id", "left")
    out = out.withColumn("next_level", F.when(F.col("_deep") < depth - 1, F.col("_deep") + 1))
    return out.withColumn("next_values", F.array_sort(F.coalesce("_all", "_some", F.array().cast("array<string>")))).drop("_deep", "_at", "_all", "_some")


def auto_pin(contexts: DataFrame, catalog: Catalog) -> DataFrame:
    """Takes the next level's only candidate, once, and looks again."""
    depth = len(catalog.levels)
    x = candidates(contexts, catalog)
    if not depth:
        return x
    x = cut(x)
    only = (F.size("next_values") == 1) & F.col("next_level").isNotNull()
    pinned = F.transform("resolved", lambda v, i: F.when(only & (i == F.col("next_level")), F.get("next_values", F.lit(0))).otherwise(v))
    return candidates(x.withColumn("resolved", pinned).drop("next_level", "next_values"), catalog)


def resolve(queries: DataFrame, catalog: Catalog) -> DataFrame:
    """Contexts (steps are run and cut as they are made): query_id, user_query, effective_query, normalized_query, resolved, matched (arrays in level order),
    next_level, next_values, hint_names, clarification_count and reply_resolved."""
    depth = len(catalog.levels)
    none = F.array().cast("array<string>")
    q = queries.select("query_id", "message", *(F.col(c) if c in queries.columns else F.lit(None).cast(kind).alias(c) for c, kind in (("explicit", "map<string,string>"), ("conversation", CONVERSATION))))
    q = q.withColumn("conversation", shaped(q)).withColumn("_reply", reply(F.col("message"), F.col("conversation")))
    base = F.coalesce(T.given(T.strip(F.col("_reply.original_query"))), T.strip(F.col("message")))
    q = q.withColumns({"base": base, "norm": T.normalize(base)})

    pinned = pins(q, catalog)
    pinned = pinned.groupBy("query_id").agg(_placed(pinned, depth).alias("_pinned"))
    replied = answers(F.col("_reply.option"), catalog.levels)

    seen = lexical_matches(q, catalog)
    matched = seen.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("level", "values"))).alias("_seen"))
    found = named_terms(q, catalog)
    named, told = hints(found, catalog), agreed(found, catalog)
    told = told.groupBy("query_id").agg(_placed(told, depth).alias("_told"))
    names = named.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("hint_names"))

    x = q.join(pinned, "query_id", "left").join(matched, "query_id", "left").join(told, "query_id", "left").join(names, "query_id", "left")
    x = x.withColumn("matched", F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda i: F.coalesce(F.element_at("_seen", i), none)) if depth else F.array().cast("array<array<string>>"))
    single = F.transform("matched", lambda v: F.when(F.size(v) == 1, F.get(v, F.lit(0)))) if depth else none
    x = x.withColumn("resolved", _or(depth, F.col("_pinned"), replied, single, F.col("_told")))
    x = auto_pin(cut(cascade(cut(x), catalog)), catalog)  # else each step would repeat the whole plan before it
    effective = T.strip(T.enrich(F.col("base"), F.col("resolved")))
    return x.select(
        "query_id", T.strip(F.col("message")).alias("user_query"), effective.alias("effective_query"), T.normalize(effective).alias("normalized_query"), "resolved", "matched", "next_level", "next_values",
        F.coalesce("hint_names", none).alias("hint_names"), asked(F.col("conversation")).alias("clarification_count"), F.col("_reply").isNotNull().alias("reply_resolved"),
    )
