"""Plans: native operators run no Python, and pruned scans read what they need."""

from __future__ import annotations

import re

import pytest

from lumenlake.llm import queries


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op1_mixing", "op2_fingerprints", "op8_chat_formatting", "op11_exact_dedup"])
def test_no_python_in_native_operators(spark, sf_dir, name):
    assert not re.search("Python|Pandas|Arrow", plan(queries.QUERIES[name](spark, sf_dir)))


def test_no_cartesian_products(spark, sf_dir):
    for name, query in queries.QUERIES.items():
        text = plan(query(spark, sf_dir))
        assert "CartesianProduct" not in text, name


@pytest.mark.parametrize("name,columns", [("op5_bpe", {"doc_id", "text"}), ("op7_html_extraction", {"page_id", "url", "html"}), ("op10_lm_scoring", {"doc_id", "text"})])
def test_scans_are_pruned(spark, sf_dir, name, columns):
    found = re.findall(r"ReadSchema: struct<([^>]*)>", plan(queries.QUERIES[name](spark, sf_dir)))
    assert found and {c.split(":")[0] for c in found[0].split(",")} == columns


def test_results_have_the_contracts_columns(spark, sf_dir):
    wanted = {
        "op1_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
        "op2_fingerprints": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
        "op3_ngram_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
        "op4_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
        "op5_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
        "op6_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op7_html_extraction": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
        "op8_chat_formatting": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
        "op9_nearest_neighbours": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    }
    for name, columns in wanted.items():
        assert columns.items() <= dict(queries.QUERIES[name](spark, sf_dir).dtypes).items(), name


def test_no_local_folder_on_a_cluster():
    """Without a shared folder named, a cluster's session is refused instead of given a folder of the driver."""
    from types import SimpleNamespace

    from lumenlake.llm import shared

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    lost = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default=None: default), sparkContext=context)
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared.shared_dir(lost)
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default=None: "/shared"), sparkContext=context)
    assert shared.shared_dir(named) == "/shared"
