"""Input columns under names that clash with nothing an operator adds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held(docs: DataFrame, *needed: str) -> tuple[DataFrame, list[str]]:
    """docs with its columns as _c0, _c1, ..., and these names; the needed ones are there under their own name, too."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names).select(*names, *(F.col(names[docs.columns.index(c)]).alias(c) for c in needed)), names


def back(docs: DataFrame, names: Sequence[str], **other: Column) -> list[Column]:
    """The columns of docs again, in order; other: what is to stand for some of them."""
    return [other.get(c, F.col(n)).alias(c) for c, n in zip(docs.columns, names, strict=True)]


def fresh(docs: DataFrame, *wanted: str) -> list[str]:
    """The names that an operator gives its own columns, with more underscores before those that docs has."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
