"""String functions as Column builders."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def normalize(value: Column) -> Column:
    """Lower case, runs of anything but ASCII letters and digits as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", " "))


def strip(value: Column) -> Column:
    """Without white space of any kind at the ends (trim() knows only spaces)."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def given(value: Column) -> Column:
    """Null for an empty string: both mean that a level isn't resolved."""
    return F.nullif(value, F.lit(""))


def stem(filename: Column) -> Column:
    """Without the last suffix; a name that only begins with a dot is all stem."""
    return F.regexp_replace(filename, r"(?<=.)\.[^.]*$", "")


def display_name(filename: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.regexp_replace(filename, r"\.[^.]*$", ""), "_-", "  "), r"(?U)\s+", " "))


def aliases(filename: Column, levels: Column, own: Column | None = None) -> Column:
    """Sorted distinct lower-case names of a document: its stem, its level values, and those of a sidecar file."""
    more = F.coalesce(own, F.array().cast("array<string>")) if own is not None else F.array().cast("array<string>")
    found = F.concat(F.array(F.trim(F.lower(F.translate(stem(filename), "_-", "  ")))), F.transform(F.coalesce(levels, F.array().cast("array<string>")), F.lower), F.transform(more, F.lower))
    return F.array_sort(F.array_distinct(F.filter(found, lambda a: a.isNotNull() & (a != ""))))


def enrich(query: Column, resolved: Column) -> Column:
    """Each resolved value, in level order, put in front of the query unless the query has it already."""
    return F.aggregate(resolved, query, lambda q, v: F.when(v.isNull() | F.contains(F.lower(q), F.lower(v)), q).otherwise(strip(F.concat(v, F.lit(" "), q))))


def signature(resolved: Column) -> Column:
    """Resolved values in level order, joined by ::, empty where there is none."""
    return F.array_join(F.transform(resolved, lambda v: F.coalesce(v, F.lit(""))), "::")


def resolved_count(resolved: Column) -> Column:
    return F.size(F.filter(resolved, lambda v: v.isNotNull() & (v != "")))


def cache_key(query: Column, version: Column, context: Column) -> Column:
    return F.concat(F.lit("retrieval-"), F.sha2(F.concat_ws("::", F.lower(strip(query)), version, context), 256))


def filter_signature(pairs: Column) -> Column:
    """k=v,... sorted by key; * without a pair. pairs: array<struct<key,value>>."""
    ordered = F.array_sort(F.transform(pairs, lambda p: F.concat(p["key"], F.lit("="), p["value"])))
    return F.coalesce(given(F.array_join(ordered, ",")), F.lit("*"))


def snippet(text: Column, size: int = 1500) -> Column:
    return F.substring(text, 1, size)


def first_parts(parts: Column, n: int = 2) -> Column:
    """The first parts of a many-part hit, joined by a space."""
    return F.array_join(F.slice(parts, 1, n), " ")


def score_of_distance(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - distance)


def known(metadata: Column) -> Column:
    """Without null values, for stores that refuse them."""
    return F.map_filter(metadata, lambda _, v: v.isNotNull())


def _titles(values: pd.Series) -> pd.Series:
    return values.map(lambda own: None if own is None else [None if v is None else v.title() for v in own])


def titles(values: Column | str) -> Column:
    """Title case as for labels; initcap() differs after digits, hyphens and underscores."""
    return F.pandas_udf(_titles, ArrayType(StringType()))(values)


def level_list(text: str) -> list[str]:
    """Level names from a comma-separated argument."""
    return [part for part in (piece.strip() for piece in text.split(",")) if part]


def pair_array(keys: Sequence[str], values: Sequence[Column]) -> Column:
    """array<struct<key,value>> of the keys whose value is given."""
    made = F.array(*(F.struct(F.lit(k).alias("key"), given(v).alias("value")) for k, v in zip(keys, values, strict=True))) if keys else F.array().cast("array<struct<key:string,value:string>>")
    return F.filter(made, lambda p: p["value"].isNotNull())
