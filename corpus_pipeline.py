"""A training-data pipeline over ``documents``: filter, deduplicate, mix, tokenize.

Every stage takes (spark, docs, sf_dir) and returns a table; all but the last
return the columns of documents.  ``run`` writes each stage's rows as Parquet to
the folder that the cluster shares and reads them again for the next, so a lost
executor repeats one stage's tasks at most.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.llm import bpe, jaccard_join, langid, mixing, toxicity
from lumenlake.llm.shared import drop_table, table, write_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject; it learns as in op6, from labelled rows that are not held out."""
    learn = ~F.coalesce(langid.held_out(), F.lit(False))
    model = toxicity.fit(docs.where(learn), table(spark, sf_dir, "labels").where(learn))
    return toxicity.clean(docs, model)


def keep_recognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without a letter, and those that no language claims for more than half, go."""
    return langid.recognised(docs, langid.fit(docs.where(~F.coalesce(langid.held_out(), F.lit(False)))))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard_join.distinct_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.emit(docs, mixing.mix(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and packed token ids of each document of the mixture."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("language_id", keep_recognised),
    ("jaccard_join", keep_distinct),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: No SQL expresses the trained stages; tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table goes when the next one's is written (the last is read by the result)."""
    docs, path = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, written = write_table(stage(spark, docs, sf_dir))
        if path:
            drop_table(spark, path)
        path = written
    return STAGES[-1][1](spark, docs, sf_dir)
