import json

import pandas as pd
from pyspark.sql import functions as F

from topograph.engine import Engine
from topograph.operators.search import embedded
from topograph.streaming.answers import answer, asked_back


def test_answers_and_counts(spark, tmp_path):
    documents = spark.createDataFrame([("d0", "a.txt", "docs/a.txt", {"kind": "docs"}, ["a", "docs"]), ("d1", "b.txt", "src/b.txt", {"kind": "src"}, ["b", "src"])], "doc_id string, filename string, relative_path string, levels map<string,string>, aliases array<string>")
    chunks = spark.createDataFrame([(0, "d0", "a.txt", "t", [1.0, 0.0], "docs"), (1, "d1", "b.txt", "t", [0.0, 1.0], "src")], "chunk_id long, doc_id string, filename string, text string, embedding array<float>, kind string")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/0.json").write_text("\n".join(json.dumps(x) for x in ({"query_id": 1, "message": "about docs"}, {"query_id": 2, "message": "src"})))

    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [1.0, 0.0] if "docs" in t else [0.0, 1.0])

    stream = embedded(spark.readStream.schema("query_id long, message string").json(str(tmp_path / "in")), embed)
    answer(stream, Engine(documents, chunks, ["kind"]), str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
    got = {r.query_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1].results[0].doc_id == "d0" and got[2].results[0].doc_id == "d1" and got[1].confidence == "high"

    (tmp_path / "turns").mkdir()
    (tmp_path / "turns/0.json").write_text("\n".join(json.dumps({"ts": f"2024-01-01T00:0{i}:00", "conv_id": 1, "type": t}) for i, t in enumerate(["clarification", "message", "clarification"])))
    turns = spark.readStream.schema("ts timestamp, conv_id long, type string").json(str(tmp_path / "turns"))
    asked_back(turns).writeStream.format("memory").queryName("asked").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert [r.n for r in spark.sql("select n from asked").collect()] == [2]
    assert asked_back(spark.createDataFrame([("2024-01-01", 1, "message")], "ts string, conv_id int, type string").withColumn("ts", F.to_timestamp("ts"))).count() == 0
