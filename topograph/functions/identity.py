"""Names and versions of documents and corpora."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doc_id(relative_path: Column) -> Column:
    return F.substring(F.sha1(relative_path), 1, 16)


def checksum(content: Column) -> Column:
    return F.sha2(content, 256)


def path_parts(relative_path: Column) -> Column:
    return F.split(relative_path, "/")


def path_levels(relative_path: Column, depth: int) -> Column:
    """Directory i of the path as level i, null where the path is shallower."""
    folders = F.slice(path_parts(relative_path), 1, F.greatest(F.size(path_parts(relative_path)) - 1, F.lit(0)))
    return F.array(*(F.get(folders, F.lit(i)) for i in range(depth))) if depth else F.array().cast("array<string>")


def extra_path(relative_path: Column, depth: int) -> Column:
    """Directories below the last level."""
    parts = path_parts(relative_path)
    return F.slice(parts, depth + 1, F.greatest(F.size(parts) - 1 - depth, F.lit(0)))


def corpus_version(documents: DataFrame) -> str:
    """The version of a documents frame. Three short columns pass the driver a partition at a time, in path order."""
    digest, first = hashlib.sha256(b"["), True
    for r in documents.select("relative_path", "checksum", "size_bytes").orderBy("relative_path").toLocalIterator():
        piece = json.dumps({"checksum": r[1], "path": r[0], "size": r[2]}, sort_keys=True)
        digest.update(("" if first else ", ").encode() + piece.encode())
        first = False
    digest.update(b"]")
    return digest.hexdigest()[:16]
