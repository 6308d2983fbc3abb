"""Filters: a small tree, as a Column, and in the dialects of stores that take a dictionary.

A filter is None, {"type": "eq", "key", "value"} or {"type": "and", "filters": [...]}.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from topograph.errors import MissingDependency


def of_pairs(pairs: list[tuple[str, str]]) -> dict[str, Any] | None:
    made = [{"type": "eq", "key": k, "value": v} for k, v in pairs]
    return None if not made else made[0] if len(made) == 1 else {"type": "and", "filters": made}


def pairs_of(tree: Mapping[str, Any] | None) -> list[tuple[str, Any]]:
    """The equalities of a filter, in order; a node of an unknown type has none."""
    if not tree:
        return []
    if tree.get("type") == "eq":
        return [(tree["key"], tree["value"])]
    return [p for x in tree.get("filters", []) for p in pairs_of(x)] if tree.get("type") == "and" else []


def signature_of(tree: Mapping[str, Any] | None) -> str:
    return ",".join(sorted(f"{k}={v}" for k, v in pairs_of(tree))) or "*"


def to_column(tree: Mapping[str, Any] | None, column: Callable[[str], Column] = F.col) -> Column:
    """A predicate that reaches the scan; a null level never equals."""
    return reduce(and_, (column(k) == F.lit(v) for k, v in pairs_of(tree)), F.lit(True))


def to_operators(tree: Mapping[str, Any] | None) -> dict[str, Any] | None:
    """{"k": {"$eq": v}}, joined by "$and"; one equality stands alone, none is no filter. Two hosted stores share this
    dialect."""
    equal = [{k: {"$eq": v}} for k, v in pairs_of(tree)]
    return {"$and": equal} if len(equal) > 1 else next(iter(equal), None)


def to_same(tree: Mapping[str, Any] | None) -> dict[str, Any] | None:
    """For a store whose filters have this very shape."""
    return dict(tree) if tree else None


def to_conditions(tree: Mapping[str, Any] | None, models: Any = None) -> Any:
    """A `must` list of match conditions, of the classes of that store's client (its `models` module)."""
    found = pairs_of(tree)
    if not found:
        return None
    if models is None:
        try:
            from qdrant_client import models  # noqa: PLC0415
        except ImportError as e:
            raise MissingDependency("this filter needs the store's client library") from e
    return models.Filter(must=[models.FieldCondition(key=k, match=models.MatchValue(value=v)) for k, v in found])


def _json(pairs: Column, one: Callable[[Column], Column], many: str) -> Column:
    """JSON of the equalities of a whole batch of attempts: null without one, a single one alone, else a list."""
    made = F.transform(pairs, one)
    listed = F.concat(F.lit(many[: many.index("@")]), F.array_join(made, ","), F.lit(many[many.index("@") + 1 :]))
    return F.when(F.size(pairs) == 1, F.get(made, F.lit(0))).when(F.size(pairs) > 1, listed)


def _text(value: Column) -> Column:
    """A JSON string."""
    return F.regexp_extract(F.to_json(F.array(value)), r"(?s)^\[(.*)\]$", 1)


def operators_json(pairs: Column) -> Column:
    """to_operators() as JSON, for attempts' pairs (array<struct<key,value>>)."""
    return _json(pairs, lambda p: F.concat(F.lit("{"), _text(p["key"]), F.lit(':{"$eq":'), _text(p["value"]), F.lit("}}")), '{"$and":[@]}')


def same_json(pairs: Column) -> Column:
    """to_same() as JSON."""
    return _json(pairs, lambda p: F.concat(F.lit('{"type":"eq","key":'), _text(p["key"]), F.lit(',"value":'), _text(p["value"]), F.lit("}")), '{"type":"and","filters":[@]}')


def conditions_json(pairs: Column) -> Column:
    """to_conditions() as JSON: a `must` list, also of one."""
    must = F.transform(pairs, lambda p: F.concat(F.lit('{"key":'), _text(p["key"]), F.lit(',"match":{"value":'), _text(p["value"]), F.lit("}}")))
    return F.when(F.size(pairs) > 0, F.concat(F.lit('{"must":['), F.array_join(must, ","), F.lit("]}")))
