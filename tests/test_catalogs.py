"""Catalogs that are kept up, against ones made again from all documents."""

import gc
import random

import pytest

from topograph.engine import Engine
from topograph.errors import StoreConfigurationError
from topograph.operators import catalogs
from topograph.operators.resolve import HINTS, Catalog

LEVELS = ["kind", "topic"]
KIND = "relative_path string, filename string, display_name string, levels map<string,string>, aliases array<string>, n long, count string"


def frame(spark, rows):
    return spark.createDataFrame([(path, *v) for path, v in rows.items()], KIND)


def some(rng):
    name = rng.choice(["a.txt", "b_c.txt", "", None])
    levels = rng.choice([None, {}, {"kind": rng.choice(["x", " x", "", None, "y"]), "topic": rng.choice(["t", "u", "T", None])}])
    return name, rng.choice([None, "", "Shown"]), levels, rng.choice([None, [], ["hot"], ["hot", "Hot", rng.choice("pqr"), None]]), rng.choice([None, 1]), rng.choice([None, "z"])


def plain(catalog):
    """Every frame's rows; of the terms only which there are."""
    rows = lambda f: sorted(map(repr, f.select(*sorted(f.columns)).collect()))
    return [rows(f) for f in (catalog.values, catalog.tuples, catalog.parents, catalog.leads, catalog.spans, catalog.terms.select("term").distinct())]


def test_random_changes(spark, tmp_path):
    """Documents, names, levels and terms come, go and change, down to none and up again."""
    rng, rows, old = random.Random(11), {}, {}
    kept = catalogs.Catalogs(spark, f"file://{tmp_path}/c", LEVELS)
    for n, (gone, more) in enumerate([(0, 25), (3, 2), (99, 0), (0, 6)]):
        for k in rng.sample(sorted(rows), min(gone, len(rows))):
            del rows[k]
        for k in rng.sample(sorted(rows), min(2, len(rows))):
            rows[k] = some(rng)
        rows |= {f"{n}/{i}": some(rng) for i in range(more)}
        assert kept.advance(frame(spark, old), frame(spark, rows), f"v{n}")
        assert not kept.advance(frame(spark, old), frame(spark, {}), f"v{n}")
        want = plain(Catalog.of(frame(spark, rows), LEVELS))
        assert plain(kept.catalog()) == want
        assert kept.state()["documents"] == len(rows)
        old = dict(rows)
    assert plain(kept.catalog("v2"))[0] == [] and len(plain(kept.catalog("v0"))[3]) > HINTS
    kept.compact()
    assert not kept.state()["changes"] and plain(kept.catalog()) == want


def test_a_lead_goes(spark, tmp_path):
    """The next document of a term that all share takes the place of one that goes; other terms aren't counted again."""
    rows = {f"p{i}": ("f.txt", None, {"kind": "k", "topic": f"t{i}"}, ["hot", f"own {i}"], 1, None) for i in range(8)}
    later = {k: v for k, v in rows.items() if k not in ("p0", "p2")}
    kept = catalogs.Catalogs(spark, f"file://{tmp_path}/c", LEVELS)
    kept.build(frame(spark, rows), "1")
    first = kept.catalog()
    kept.advance(frame(spark, rows), frame(spark, later), "2")
    leads = lambda c: {r.relative_path for r in c.leads.where("term = 'hot'").collect()}
    assert (leads(first), leads(kept.catalog())) == ({"p0", "p1", "p2", "p3"}, {"p1", "p3", "p4", "p5"})
    assert {(r.low, r.high) for r in kept.catalog().spans.where("term = 'hot' and level = 1").collect()} == {("t1", "t7")}


def test_interrupted_and_wrong(spark, tmp_path, monkeypatch):
    one, two = {"a": ("f", None, {"kind": "x"}, None, 1, None)}, {"b": ("g", None, {"kind": "y"}, None, 1, None)}
    kept = catalogs.Catalogs(spark, f"file://{tmp_path}/c", LEVELS)
    with pytest.raises(StoreConfigurationError):
        kept.catalog()
    kept.build(frame(spark, one), "1")
    with monkeypatch.context() as m:
        m.setattr(catalogs.Catalogs, "_record", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            kept.advance(frame(spark, one), frame(spark, two), "2")
    assert [r.value for r in kept.catalog().values.collect()] == ["x"]
    with pytest.raises(StoreConfigurationError):  # not the documents of version 1
        kept.advance(frame(spark, two), frame(spark, {}), "2")
    assert kept.advance(frame(spark, one), frame(spark, two), "2")
    assert [r.value for r in kept.catalog().values.collect()] == ["y"]
    for wrong in (frame(spark, one).unionByName(frame(spark, one)), frame(spark, {None: one["a"]})):
        with pytest.raises(StoreConfigurationError):
            kept.advance(frame(spark, two), wrong, "3")
    with pytest.raises(StoreConfigurationError):
        catalogs.Catalogs(spark, kept.folder, ["other"]).catalog()


def test_engines_share(spark, tmp_path):
    """Two engines of one version hold one catalog, which goes with the last of them."""
    rows = {"docs/a.txt": ("a.txt", None, {"kind": "docs", "topic": "howto"}, ["alpha"], 1, None)}
    documents = frame(spark, rows)
    chunks = spark.createDataFrame([("c1", "d", "a.txt", "t", "docs", "howto", [1.0, 0.0])], "chunk_id string, doc_id string, filename string, text string, kind string, topic string, embedding array<float>")
    folder = f"file://{tmp_path}/c"
    catalogs.Catalogs(spark, folder, LEVELS).build(documents, "1")
    engines = [Engine(documents, chunks, LEVELS, version="1", catalog=catalogs.Catalogs(spark, folder, LEVELS).catalog("1")) for _ in range(2)]
    assert engines[0].catalog is engines[1].catalog
    asked = spark.createDataFrame([(1, "about alpha", [1.0, 0.0])], "query_id long, message string, vector array<float>")
    assert engines[0].search(asked, ask=False).first()["resolved"] == ["docs", "howto"]
    engines[0].close()
    assert engines[1].catalog.leads.is_cached and engines[1].resolve(asked).first()["hint_names"] == ["a.txt"]
    engines[1].close()
    assert not engines[1].catalog.leads.is_cached
    del engines
    gc.collect()
    assert not [k for k in catalogs._HELD if k[1] == folder]
    with pytest.raises(StoreConfigurationError):
        Engine(documents, chunks, ["kind"], catalog=catalogs.Catalogs(spark, folder, LEVELS).catalog())
