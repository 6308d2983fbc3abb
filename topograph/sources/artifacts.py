"""The four artifacts of a crawl: corpus map, manifest, search plan and confidence configuration.

The first two grow with the corpus and are kept as Parquet tables as well. As JSON they are written piece by piece: rows
pass the driver one at a time, in path order, and nothing but the tree's open branch and the level values is held.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from itertools import groupby
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topograph.errors import CorpusValidationError
from topograph.functions.confidence import Thresholds
from topograph.functions.identity import corpus_version
from topograph.operators import corpus
from topograph.plans.template import Template, default_attempts

SCHEMA_VERSION = "1.0"
NAMES = {"corpus_map": "corpus_map.json", "metadata_manifest": "metadata_manifest.json", "search_plan": "search_plan_template.json", "confidence_config": "confidence_config.json"}
#: Fields of a document in the corpus map, and of a manifest row.
FLAT = ("doc_id", "filename", "relative_path", "levels", "extra_path", "aliases", "checksum", "size_bytes", "last_modified", "extension")
ROW = ("doc_id", "filename", "relative_path", "metadata", "text_sample", "aliases", "checksum", "size_bytes")
ABOUT = "version string, generated_at string, level_names array<string>, template string, thresholds string, notes string"
DOCUMENTS = "doc_id string, filename string, relative_path string, levels map<string,string>, extra_path array<string>, aliases array<string>, checksum string, size_bytes bigint, last_modified string, extension string"


@dataclass
class Artifacts:
    level_names: list[str]
    version: str
    generated_at: str
    documents: DataFrame
    manifest: DataFrame
    template: Template
    thresholds: Thresholds
    notes: str = ""
    values: DataFrame | None = None


def build(documents: DataFrame, level_names: Sequence[str], generated_at: str | None = None, thresholds: Thresholds | None = None, compatible: bool = True) -> Artifacts:
    """Artifacts of a documents frame with one version and time; thresholds: tuned ones to carry over. compatible: the
    version is a hash over all files in order, for which they pass the driver; else it is that of a tree of digests."""
    if bad := [n for n in level_names if n.startswith("_")]:
        raise ValueError(f"level names can't begin with an underscore: {bad}")
    when, version = generated_at or datetime.now(timezone.utc).isoformat(), (corpus_version if compatible else corpus.tree_version)(documents)
    names = list(level_names)
    return Artifacts(names, version, when, documents, corpus.manifest(documents, names), Template(version, when, names, default_attempts(names)), thresholds or Thresholds())


def flat(documents: DataFrame) -> DataFrame:
    """The flat documents of a corpus map."""
    return documents.select(*FLAT)


def _rows(frame: DataFrame, fields: Sequence[str]) -> Iterator[dict[str, Any]]:
    """Rows in path order as plain values; times as ISO text."""
    for r in frame.orderBy("relative_path").toLocalIterator(prefetchPartitions=True):
        own = r.asDict(recursive=True)
        yield {k: v.replace(tzinfo=v.tzinfo or timezone.utc).isoformat() if isinstance(v := own.get(k), datetime) else v for k in fields}


def listed(rows: Iterable[dict[str, Any]], indent: int) -> Iterator[str]:
    """A JSON list of rows, in pieces."""
    empty = True
    for r in rows:
        body = json.dumps(r, indent=2, ensure_ascii=False).replace("\n", "\n" + " " * (indent + 2))
        yield ("[\n" if empty else ",\n") + " " * (indent + 2) + body
        empty = False
    yield "[]" if empty else "\n" + " " * indent + "]"


def branches(rows: Iterable[dict[str, Any]], indent: int) -> Iterator[str]:
    """The topology tree as JSON, in pieces: the first level's values are keys, deeper ones are below "_<level>", and
    documents are in "_documents" where their next level is missing. rows are a node's documents each (path, documents), sorted by path: what is
    open is the path to the last one."""
    def pad(n: int) -> str:
        return "\n" + " " * (indent + 2 * n)

    open_: list[str] = []  # keys of the objects that are open below the root
    filled = [False]
    yield "{"
    for keys, documents in rows:
        same = next((i for i, (a, b) in enumerate(zip(open_, keys, strict=False)) if a != b), min(len(open_), len(keys)))
        while len(open_) > same:
            open_.pop()
            filled.pop()
            yield pad(len(open_) + 1) + "}"
        for key in [*keys[same:], "_documents"]:
            yield ("," if filled[-1] else "") + pad(len(filled)) + json.dumps(key, ensure_ascii=False) + ": "
            filled[-1] = True
            if key != "_documents":
                open_.append(key)
                filled.append(False)
                yield "{"
        yield from listed(documents, indent + 2 * len(filled))
    while open_:
        open_.pop()
        filled.pop()
        yield pad(len(open_) + 1) + "}"
    yield (pad(0) if filled[-1] else "") + "}"


def _object(fields: dict[str, Any]) -> Iterator[str]:
    """A JSON object in pieces; a field that is an iterator gives its value's pieces itself."""
    for i, (k, v) in enumerate(fields.items()):
        yield ("{" if not i else ",") + f"\n  {json.dumps(k)}: "
        if isinstance(v, Iterator):
            yield from v
        else:
            yield json.dumps(v, indent=2, ensure_ascii=False).replace("\n", "\n  ")
    yield "\n}"


def _nodes(a: Artifacts) -> Iterator[tuple[list[str], list[dict[str, Any]]]]:
    """The keys of each node that has documents, in order, and these; one node's documents are held at a time."""
    depth = len(a.level_names)
    keys = F.transform(corpus._reach(corpus.level_array(a.level_names)), lambda v, i: F.array(F.concat(F.lit("_"), F.get(F.array(*map(F.lit, a.level_names)), i)), v)) if depth else F.array().cast("array<array<string>>")
    rows = a.documents.select(F.flatten(keys).alias("keys"), "doc_id", "filename", "relative_path", "aliases").orderBy("keys", "relative_path").toLocalIterator(prefetchPartitions=True)
    for keys, own in groupby(rows, lambda r: tuple(r["keys"])):
        yield list(keys[1:]), [{k: r[k] for k in ("doc_id", "filename", "relative_path", "aliases")} for r in own]


def write_json(a: Artifacts, folder: str | Path) -> dict[str, Path]:
    """Writes the four JSON files, indented and in UTF-8, as their rows come."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    head = {"schema_version": SCHEMA_VERSION, "version": a.version, "generated_at": a.generated_at, "level_names": a.level_names}
    values: dict[str, list[str]] = {n: [] for n in a.level_names}
    for r in corpus.level_values(a.documents, a.level_names).orderBy("level", "pos").toLocalIterator():
        values[a.level_names[r["level"]]].append(r["value"])
    found = {
        "corpus_map": _object(head | {"document_count": a.documents.count(), "tree": branches(_nodes(a), 2), "flat_documents": listed(_rows(a.documents, FLAT), 2), "level_values": values}),
        "metadata_manifest": _object(head | {"documents": listed(_rows(a.manifest, ROW), 2)}),
        "search_plan": _object(a.template.to_json()), "confidence_config": _object({"schema_version": SCHEMA_VERSION, "thresholds": a.thresholds.to_json(), "notes": a.notes}),
    }
    paths = {k: folder / name for k, name in NAMES.items()}
    for k, path in paths.items():
        with path.open("w", encoding="utf-8") as f:
            f.writelines(found[k])
    return paths


def write_tables(a: Artifacts, folder: str) -> None:
    """Writes documents, manifest, level values and tree nodes as Parquet, and one row with all else."""
    spark = a.documents.sparkSession
    about = spark.createDataFrame([(a.version, a.generated_at, a.level_names, json.dumps(a.template.to_json()), json.dumps(a.thresholds.to_json()), a.notes)], ABOUT)
    tables = {"documents": a.documents, "manifest": a.manifest, "level_values": corpus.level_values(a.documents, a.level_names), "tree_nodes": corpus.tree_nodes(a.documents, a.level_names), "about": about}
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_tables(spark: SparkSession, folder: str) -> Artifacts:
    """What write_tables() wrote, with the stored level values."""
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    r = read("about").first()
    if r is None:
        raise CorpusValidationError(f"{folder} has no tables of a corpus")
    return Artifacts(list(r["level_names"]), r["version"], r["generated_at"], read("documents"), read("manifest"), Template.from_json(json.loads(r["template"])), Thresholds.from_json(json.loads(r["thresholds"])), r["notes"], read("level_values"))


def _load(path: str | Path) -> dict[str, Any]:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def load_template(path: str | Path) -> Template:
    try:
        return Template.from_json(_load(path))
    except ValueError as e:
        raise CorpusValidationError(f"{path} isn't a search plan: {e}") from e


def load_thresholds(path: str | Path) -> Thresholds:
    return Thresholds.from_json(_load(path).get("thresholds", {}))


def load_manifest(spark: SparkSession, path: str | Path) -> tuple[dict[str, Any], DataFrame]:
    """(version, generated_at and level_names, rows)."""
    try:
        found = _load(path)
        head = {k: found[k] for k in ("version", "generated_at", "level_names")}
        rows = [tuple(r[k] if k in ("doc_id", "relative_path", "metadata") else r.get(k) for k in ROW) for r in found["documents"]]
    except (KeyError, TypeError, ValueError, AttributeError) as e:
        raise CorpusValidationError(f"{path} isn't a manifest: {e}") from e
    return head, spark.createDataFrame(rows, "doc_id string, filename string, relative_path string, metadata map<string,string>, text_sample string, aliases array<string>, checksum string, size_bytes bigint")


def load_documents(spark: SparkSession, path: str | Path) -> tuple[list[str], str, DataFrame]:
    """(level names, version, documents) of a corpus map."""
    found = _load(path)
    rows = [tuple(r.get(k) for k in FLAT) for r in found["flat_documents"]]
    return list(found["level_names"]), str(found["version"]), spark.createDataFrame(rows, DOCUMENTS)
