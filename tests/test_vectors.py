"""Texts that are embedded once, counted by the calls of the embedding function."""

import pytest

from topograph.engine import Engine
from topograph.operators import vectors
from topograph.operators.vectors import Vectors


@pytest.fixture
def model(tmp_path):
    """An embedding function that writes down what it is asked, and a reader of that."""
    log = tmp_path / "asked"

    def embed(texts):
        with log.open("a") as f:
            f.writelines(repr(t) + "\n" for t in texts)
        if "lost" in set(texts):
            raise OSError("no answer")
        return texts.map(lambda t: None if t == "never" else [float(len(t)), 1.0])

    return embed, lambda: sorted(log.read_text().splitlines()) if log.exists() else []


def rows(spark, *texts):
    return spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "text_key int, message string, vector string")


def test_each_text_once(spark, tmp_path, model):
    """Repeated, null and empty texts, columns of clashing names, and texts of an earlier batch."""
    embed, asked = model
    held = Vectors(spark, f"file://{tmp_path}/v", embed, "m")
    got = {r["text_key"]: r["vector"] for r in held.of(rows(spark, "a", "bb", "a", None, "", "A")).collect()}
    assert got == {0: [1.0, 1.0], 1: [2.0, 1.0], 2: [1.0, 1.0], 3: None, 4: [0.0, 1.0], 5: [1.0, 1.0]}
    assert asked() == sorted(map(repr, ["a", "bb", "", "A"]))
    held.of(rows(spark, "bb", "ccc", "ccc")).collect()
    assert asked() == sorted(map(repr, ["a", "bb", "", "A", "ccc"]))
    assert held.of(rows(spark, *["bb"] * 3000)).where("vector[0] = 2").count() == 3000 and len(asked()) == 5
    assert held.of(rows(spark).limit(0)).count() == 0 and len(asked()) == 5
    held.compact()
    assert held.stored().count() == 5 and held.of(rows(spark, "ccc")).first()["vector"] == [3.0, 1.0] and len(asked()) == 5
    Vectors(spark, f"file://{tmp_path}/v", embed, "another").of(rows(spark, "bb")).collect()
    assert len(asked()) == 6  # another model's vectors are its own


def test_keys_stand_for_texts(spark, tmp_path, model, monkeypatch):
    """What is written on the way has no text, and rows whose text nobody reads are joined without it."""
    written = []
    cut = vectors.cut
    monkeypatch.setattr(vectors, "cut", lambda frame: written.append(frame.columns) or cut(frame))
    held = Vectors(spark, f"file://{tmp_path}/v", model[0], "m")
    out = held.of(rows(spark, "a", "bb", "a", None)).select("text_key", "vector")
    assert written and all(c == ["_text_key"] for c in written)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "message" not in plan.partition("Join")[2].partition("\n")[0] and out.count() == 4


def test_failures(spark, tmp_path, model):
    """A batch that fails stores nothing; a text without an answer is asked again."""
    embed, asked = model
    held = Vectors(spark, f"file://{tmp_path}/v", embed, "m")
    with pytest.raises(Exception, match="no answer"):
        held.of(rows(spark, "a", "lost"))
    assert held.stored().count() == 0
    assert [r["vector"] for r in held.of(rows(spark, "a", "never")).orderBy("text_key").collect()] == [[1.0, 1.0], None]
    n = asked().count("'never'")
    held.of(rows(spark, "a", "never")).collect()
    assert asked().count("'never'") == n + 1 and held.stored().count() == 1


def test_engine_embeds(spark, tmp_path, model):
    embed, asked = model
    documents = spark.createDataFrame([("d", "a.txt", "docs/a.txt", {"kind": "docs"}, ["alpha"])], "doc_id string, filename string, relative_path string, levels map<string,string>, aliases array<string>")
    chunks = spark.createDataFrame([("c1", "d", "a.txt", "t", "docs", [5.0, 1.0])], "chunk_id string, doc_id string, filename string, text string, kind string, embedding array<float>")
    engine = Engine(documents, chunks, ["kind"], vectors=Vectors(spark, f"file://{tmp_path}/v", embed, "m"))
    queries = spark.createDataFrame([(1, "alpha"), (2, "alpha")], "query_id long, message string")
    assert [r["top_score"] for r in engine.search(queries, ask=False).collect()] == pytest.approx([1.0, 1.0]) and asked() == ["'alpha'"]
    engine.close()
