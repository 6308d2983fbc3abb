import json
import warnings

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from topograph import cli
from topograph.errors import CorpusValidationError, MissingDependency, UnsupportedFileType
from topograph.sources import artifacts, crawl, extract, listing
from topograph.sources.crawl import Crawler, infer_levels

FILES = {"docs/tutorial/a_class.txt": "classes", "docs/howto/logging.txt": "logs", "docs/over view é.txt": "all", "src/net/x.py": "pass", "src/net/deep/er/y.py": "y", "_under/_z.md": "", "docs/.hidden.txt": "no", ".git/c.txt": "no"}


@pytest.fixture
def corpus(tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text, encoding="utf-8")
    (tmp_path / "docs/howto/_aliases.json").write_text(json.dumps({"logging.txt": ["Log Files", " "], "x": 3}))
    (tmp_path / "src/_aliases.json").write_text("not json")
    return tmp_path


def test_crawl(spark, corpus):
    rows = {r.relative_path: r for r in Crawler(corpus, ["kind", "topic"]).documents(spark).collect()}
    assert list(rows) == sorted(["_under/_z.md", "docs/howto/logging.txt", "docs/over view é.txt", "docs/tutorial/a_class.txt", "src/net/deep/er/y.py", "src/net/x.py"])
    assert rows["docs/over view é.txt"].levels == {"kind": "docs", "topic": None}
    assert rows["src/net/deep/er/y.py"].extra_path == ["deep", "er"]
    assert rows["docs/howto/logging.txt"].aliases == ["docs", "howto", "log files", "logging"]
    assert rows["_under/_z.md"].size_bytes == 0 and rows["_under/_z.md"].text_sample == ""


def test_crawl_options(spark, corpus):
    (corpus / "docs/blob.xyz").write_bytes(b"?")
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert Crawler(corpus, ["kind"], require_text=True).documents(spark).count() == 5
    assert any(".xyz" in str(w.message) for w in seen)
    with pytest.raises(UnsupportedFileType):
        Crawler(corpus, ["kind"], strict_unknown_extensions=True).documents(spark)
    with pytest.raises(ValueError):
        Crawler(corpus, ["a", "a"])
    with pytest.raises(FileNotFoundError):
        Crawler(corpus / "none")
    with pytest.raises(NotADirectoryError):
        Crawler(corpus / "docs/blob.xyz")
    assert infer_levels(corpus) == [f"level_{i}" for i in range(4)]
    bad = Crawler(corpus, ["kind"])
    bad.registry.register(".xyz", lambda data: 1 / 0)
    row = bad.documents(spark).where("extension = '.xyz'").first()
    assert row.text_sample == "" and "ZeroDivisionError" in row.problem


def test_issues(spark, corpus):
    """What a crawl passes by is told: sidecars that aren't JSON, files without an extractor, links that lead back."""
    (corpus / "docs/blob.xyz").write_bytes(b"?")
    (corpus / "docs/howto/back").symlink_to(corpus / "docs")
    (corpus / "src/also.txt").symlink_to(corpus / "docs/howto/logging.txt")
    (corpus / "src/more").symlink_to(corpus / "docs/tutorial")
    own = Crawler(corpus, ["kind"], follow_symlinks=True)
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        paths = {r.relative_path for r in own.documents(spark).collect()}
    assert {"src/also.txt", "src/more/a_class.txt"} <= paths and not any("back" in p for p in paths)
    assert {(r.kind, r.path.rpartition("/")[2]) for r in own.issues(spark).collect()} == {("bad sidecar", "_aliases.json"), ("cycle", "docs"), ("no extractor", "blob.xyz")}
    assert all(any(what in str(w.message) for w in seen) for what in ("bad sidecar", "cycle", ".xyz"))
    plain = Crawler(corpus, ["kind"])
    assert not {"src/also.txt", "src/more/a_class.txt"} & {r.relative_path for r in plain.documents(spark).collect()}
    assert plain.issues(spark).where("kind = 'cycle'").count() == 0


def test_listing(spark, corpus):
    """Rows of a tree, hidden ones if asked for; a folder that can't be read is a row."""
    names = lambda kind, **more: {r.relative_path for r in listing.listing(spark, str(corpus), **more).where(F.col("kind") == kind).collect()}
    assert names("file") == {p for p in FILES if not any(x.startswith(".") for x in p.split("/"))}
    assert names("file", skip_hidden=False) == set(FILES)
    assert names("folder") == {"docs", "docs/tutorial", "docs/howto", "src", "src/net", "src/net/deep", "src/net/deep/er", "_under"} and names("sidecar") == {"docs/howto/_aliases.json", "src/_aliases.json"}
    ((kind, relative, path, _, _, problem),) = listing.entries("gone", str(corpus / "gone"), False, True)
    assert (kind, relative, path) == (listing.UNREADABLE, "gone", str(corpus / "gone")) and problem.startswith("FileNotFoundError")
    assert [b.num_rows for b in listing._listed(False, True)([pa.RecordBatch.from_pydict({"relative_path": ["gone"], "path": [str(corpus / "gone")]})])] == [1]
    big = corpus / "many"
    big.mkdir()
    for i in range(30):
        (big / f"{i}.txt").touch()
    assert listing.listing(spark, f"file://{big}").count() == 30


def test_binary_files(spark, tmp_path):
    """Paths are what follows the root, also where its name occurs again, with blanks and other letters."""
    root = tmp_path / "b"
    for name in ("b/b/x.txt", "a b/c%20d é.txt", "b.txt", "tmp/b"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"text of {name}")
    for start in (str(root), f"file://{root}/"):
        rows = {r.relative_path: bytes(r.content).decode() for r in crawl.binary_files(spark, start).collect()}
        assert rows == {n: f"text of {n}" for n in ("b/b/x.txt", "a b/c%20d é.txt", "b.txt", "tmp/b")}
    docs = {r.relative_path: r.levels for r in crawl.documents_of(crawl.binary_files(spark, str(root)), ["one"]).collect()}
    assert docs == {"b/b/x.txt": {"one": "b"}, "a b/c%20d é.txt": {"one": "a b"}, "b.txt": {"one": None}}


def test_extractors():
    assert extract.plain("a\r\né".encode()) == "a\né" and extract.plain(b"\xff\xfea") == "ÿþa"
    assert extract.html(b"<p>a &amp; b</p><script>x<style>y</script>z</style><div> c </div>") == "a & b\nz\nc"
    assert extract.html(b"</script><script>x</script>y") == "y" and extract.html(b"</style></style>a<style>b") == "a"
    assert extract.html(b"<template><p>no</p></template>yes") == "yes"
    assert extract.flat_json(b'{"a": {"b": [1, {"c": null}]}, "t": true, "e": {}}') == "a.b[0]: 1\na.b[1].c: \nt: True"
    assert extract.flat_json(b"7") == "value: 7" and extract.flat_json(b"{oops") == "{oops"
    assert extract.flat_json(json.dumps({"k": "x" * 2001}).encode()) == "k: " + "x" * 2000 + "…"
    assert extract.rendered_csv(b"name,age\nann,3\nbob,4,extra\n") == "row 1: name: ann | age: 3\nrow 2: name: bob | age: 4 | col_2: extra"
    assert extract.rendered_csv(b"1,2\n3,4\n") == "row 1: col_0: 1 | col_1: 2\nrow 2: col_0: 3 | col_1: 4" and extract.rendered_csv(b"") == ""
    assert extract.rendered_csv(b"h\n" + b"v\n" * 6000).count("\n") == 4999
    assert extract.repaired_pdf(b"%PDF\nstartxref\n12\n%note\n%%EOF\n") == b"%PDF\nstartxref\n12\n%%EOF\n" and extract.repaired_pdf(b"junk") is None
    r = extract.Registry()
    r.deregister(".txt")
    assert r.get(".TXT") is None and r.get("") is None and r.get(".MD") is extract.plain and r.supported_extensions() == sorted(r.supported_extensions())
    with pytest.raises(ValueError):
        r.register("txt", extract.plain)
    with pytest.raises(MissingDependency):
        r.check({".pdf", ".docx"})


def test_artifacts_and_cli(spark, corpus, tmp_path, capsys):
    out = tmp_path / "out"
    assert cli.main(["crawl", str(corpus), "--levels", "kind,topic", "--output", str(out)], spark) == 0
    said = json.loads(capsys.readouterr().out)
    assert said["document_count"] == 6
    made = json.loads((out / "corpus_map.json").read_text(encoding="utf-8"))
    assert made["version"] == said["corpus_version"] and made["level_values"]["kind"] == ["_under", "docs", "src"]
    assert made["tree"]["docs"]["_documents"][0]["filename"] == "over view é.txt" and "howto" in made["tree"]["docs"]["_topic"]
    levels, version, docs = artifacts.load_documents(spark, out / "corpus_map.json")
    assert (levels, version, docs.count()) == (["kind", "topic"], said["corpus_version"], 6)
    head, rows = artifacts.load_manifest(spark, out / "metadata_manifest.json")
    assert head["level_names"] == levels and rows.first().metadata["source_path"] == rows.first().relative_path
    assert [a.reason for a in artifacts.load_template(out / "search_plan_template.json").attempts] == ["resolved_context", "kind_only", "global_fallback"]
    assert artifacts.load_thresholds(out / "confidence_config.json").medium_min == 0.58
    (out / "bad.json").write_text("{}")
    for load in (artifacts.load_template, lambda p: artifacts.load_manifest(spark, p)):
        with pytest.raises(CorpusValidationError):
            load(out / "bad.json")
    assert cli.main(["crawl", str(corpus / "none"), "--output", str(out)], spark) == 2
    (corpus / "q.xyz").write_text("?")
    assert cli.main(["crawl", str(corpus), "--levels", "kind", "--strict-unknown-extensions", "--output", str(out)], spark) == 1


def test_references_without_a_semicolon():
    """As in HTML5 and the reference: the old names are decoded, others are text."""
    from topograph.sources import extract

    assert extract.html(b"<h1>a&amp</h1><p>b&amp;amp c&am</p>") == "a&\nb&amp c&am"
