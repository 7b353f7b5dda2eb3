"""The pipeline's stages against plain Python on small tables."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_llm import BPE, DOC, brute_components, languages, toxic_rows  # noqa: E402


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    rng = np.random.default_rng(12)
    rows, labels = toxic_rows(rng, 300)
    rows = [(k, t + " " + " ".join(f"x{k}y{i}" for i in range(8)), *r) for k, t, *r in rows]
    rows += [(1000 + k, t, *r) for k, t, *r in rows[:40]] + [(2000, None, "aa", "s", 0), (2001, "12 34", "aa", "s", 5)]
    spark.createDataFrame(rows, DOC).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows, dict((k, t) for k, _, t in labels)


def test_stages_are_named():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "jaccard_join", "mixing", "bpe"]


def test_pipeline_equals_plain_python(spark, tables):
    from tokenizers import Tokenizer

    folder, rows, labels = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    now, state = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = now
        now = stage(spark, now, folder).cache()
        assert now.columns == before.columns
        state.append((name, before, now))
    toxic = {r["doc_id"] for r in state[0][1].collect()} - {r["doc_id"] for r in state[0][2].collect()}
    truth = {k for k, t in labels.items() if t} | {1000 + k for k, _, *_ in rows[:40] if labels.get(k)}
    assert len(toxic ^ truth) <= 0.03 * len(rows)
    gone = {r["doc_id"] for r in state[1][1].collect()} - {r["doc_id"] for r in state[1][2].collect()}
    assert {2000, 2001} <= gone and len(gone) <= 0.05 * len(rows)
    before = [(r["doc_id"], r["text"]) for r in state[2][1].collect()]
    assert {r["doc_id"] for r in state[2][2].collect()} == {c for _, _, c in brute_components(before)}
    mixed = [r["doc_id"] for r in state[3][2].collect()]
    assert set(mixed) <= {r["doc_id"] for r in state[3][1].collect()} and max(mixed.count(k) for k in set(mixed)) <= 3
    out = corpus_pipeline.run(spark, folder).collect()
    library = Tokenizer.from_file(BPE)
    texts = {r[0]: r[1] for r in rows}
    assert sorted(r["doc_id"] for r in out) == sorted(mixed)
    for r in out[:50]:
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert languages(np.random.default_rng(0), 4) and public_tokenizers.path("byte_bpe_50k.json")
