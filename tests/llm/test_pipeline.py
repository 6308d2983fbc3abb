"""The pipeline against a plain version of it, and the guard of the entry module."""

import hashlib
import subprocess
import sys
from pathlib import Path

import numpy as np
import tiktoken
from public_tokenizers import PATTERN

import corpus_pipeline
from topograph.llm import bpe

ROOT = Path(__file__).resolve().parent.parent.parent
RNG = np.random.default_rng(11)


def say(n):
    return " ".join(RNG.choice([f"v{i}" for i in range(500)], n).tolist())


def test_pipeline(spark, tmp_path):
    base, passage = say(150), say(55)
    near = " ".join(["other" if i == 70 else w for i, w in enumerate(base.split())])
    texts = {i: say(60) + (" nasty vileword nasty" if i % 5 == 0 else "") for i in range(200)}
    texts |= {200: base, 201: base, 202: near, 203: say(20) + " " + passage, 204: passage + " " + say(30), 205: None, 206: passage}
    docs = spark.createDataFrame([(i, t, "en", f"s{0 if i < 150 else 1}", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    kept = {i: t for i, t in texts.items() if not (i < 200 and i % 5 == 0) and i not in (201, 202)}
    kept[204] = kept[204].removeprefix(passage + " ")
    del kept[206]
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(), special_tokens={})
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == set(kept)
    for r in rows:
        want = kept[r.doc_id] or ""
        assert np.frombuffer(r.ids, np.uint32).tolist() == enc.encode_ordinary(want) and r.n_tokens == len(r.ids) // 4
        assert r.decoded_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert max(sum(r.doc_id == i for r in rows) for i in kept) == 2  # the small source comes again, within its limit

    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_entry_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "topograph"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-r", str(tmp_path / "topograph/llm")], check=True)
    code = "import __spark_entry__ as e; n = e.queries(); assert n and not any(x.startswith('op') for x in n) and 'pipeline' not in n and set(e.oracle_sql()) <= set(n)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
