"""From raw documents to packed training windows, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last
keep the columns of ``documents``. ``run`` writes each result as Parquet and gives
the next stage the reread table.

Nulls count as empty texts, repeated rows are one document after the second stage,
an empty table stays empty through all stages, and further columns are kept until
the last stage. A clean document is only dropped as a copy or near copy of another
that stays."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkrecon.llm import exact_dedup, jaccard_join, packing, personal_data, toxicity
from sparkrecon.llm.common import importable, staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that a factorization machine, fitted on ``labels``, calls toxic."""
    importable(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal up to the case of A-Z, keep the row of the largest id."""
    index = exact_dedup.DigestIndex(spark, f"pipeline_digests_{uuid.uuid4().hex}")
    return exact_dedup.distinct_rows(docs, index)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a similarity of 0.75, keep the smallest id."""
    importable(spark)
    return jaccard_join.one_per_component(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by the name of its kind."""
    return personal_data.without_personal_data(docs, personal_data.learn(docs))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in windows of 4096: a row per piece, which holds its ids."""
    importable(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("personal_data", mask_personal_data),
    ("packing", pack_windows),
]

#: The first and the fourth stage learn a model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
