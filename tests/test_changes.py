"""Versions of a chunk table against plain dictionaries, and uploads that are interrupted."""

import random

import pytest

from topograph.errors import StoreConfigurationError
from topograph.operators import changes

KIND = "chunk_id string, key string, change double, row array<float>"


def frame(spark, rows):
    return spark.createDataFrame([(k, *v) for k, v in rows.items()], KIND)


def held(versions):
    return {r[0]: (r[1], r[2], list(r[3]) if r[3] is not None else None) for r in versions.read().collect()}


def test_random_versions(spark, tmp_path):
    """Columns are named like those of change sets; null values count as values."""
    rng = random.Random(5)
    some = lambda: (rng.choice(["a", "", None]), rng.choice([0.5, None]), rng.choice([[1.0], [], None]))
    versions, rows = changes.Versions(spark, f"file://{tmp_path}/v"), {}
    for n, (gone, more) in enumerate([(0, 40), (3, 2), (2, 3), (10, 5), (99, 0), (0, 4)]):
        old = dict(rows)
        for k in rng.sample(sorted(rows), min(gone, len(rows))):
            del rows[k]
        for k in rng.sample(sorted(rows), min(2, len(rows))):
            rows[k] = some()
        rows |= {f"{n}-{i}": some() for i in range(more)}
        got = versions.upload(frame(spark, rows), f"v{n}")
        assert got == {"added": len(rows.keys() - old.keys()), "changed": sum(old[k] != rows[k] for k in rows.keys() & old.keys()), "removed": len(old.keys() - rows.keys())}
        assert held(versions) == rows
        assert versions.upload(frame(spark, {}), f"v{n}") is None and held(versions) == rows
    assert versions.upload(frame(spark, rows), "v5", force=True) == {"added": 0, "changed": 0, "removed": 0}
    versions.compact()
    assert held(versions) == rows and not versions.state()["changes"]


def test_interrupted(spark, tmp_path, monkeypatch):
    versions = changes.Versions(spark, f"file://{tmp_path}/v")
    first, second = {"a": ("x", 1.0, None), "b": (None, None, [])}, {"b": ("y", None, []), "c": (None, 2.0, None)}
    with pytest.raises(StoreConfigurationError):
        versions.read()
    versions.upload(frame(spark, first), "1")
    with monkeypatch.context() as m:
        m.setattr(changes.Versions, "_record", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            versions.upload(frame(spark, second), "2")
    assert held(versions) == first and versions.state()["version"] == "1"
    assert versions.upload(frame(spark, second), "2") == {"added": 1, "changed": 1, "removed": 1}
    assert held(changes.Versions(spark, versions.folder)) == second


def test_wrong_versions(spark, tmp_path):
    versions = changes.Versions(spark, f"file://{tmp_path}/v")
    one = frame(spark, {"a": (None, None, None)})
    for wrong in (one.unionByName(one), frame(spark, {None: (None, None, None)})):
        with pytest.raises(StoreConfigurationError):
            versions.upload(wrong, "1")
    assert versions.state() is None
    versions.upload(one, "1")
    with pytest.raises(StoreConfigurationError):
        versions.upload(one.drop("key"), "2")
