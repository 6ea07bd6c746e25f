"""From documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and gives the rows that go on, in the columns
of ``docs`` (the last one gives pieces).  ``run`` writes every stage to the shared folder
and reads it back, so that a lost executor never costs more than one stage.

* ``language``: documents without a letter, without a clear language or too unlike
  every learned one go.
* ``near_duplicates``: of each group of SimHash neighbours one document stays, the one
  with the smallest key.
* ``secrets``: what the scan finds is replaced in the text; every document stays.
* ``mix``: domains, languages and sources share a budget of three quarters of all words,
  one epoch at most; the document in which a leaf's budget ends stays whole.
* ``pack``: documents are tokenised, cut and packed into sequences of 1024 tokens.

Null and empty texts are rejected by the first stage.  Repeated rows meet in the second.
Null keys, languages and sources are kept as they are.  An empty table gives an empty
result.  Extra columns ride along through all stages but the last, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftline.llm import language, mixing, packing, secrets, simhash
from driftline.llm.queries import MIX_WEIGHTS, mix_levels
from driftline.session import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _beside(docs: DataFrame, names: set[str], operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply an operator that adds ``names``, keeping columns of ``docs`` that are called so."""
    aside = {}
    for c in docs.columns:
        if c in names:
            aside[c] = f"~{c}"
            while aside[c] in docs.columns:
                aside[c] = f"~{aside[c]}"
    out = operator(docs.withColumnsRenamed(aside))
    return out.select(*[out[f"`{aside.get(c, c)}`"].alias(c) for c in docs.columns])


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = {"lang_pred", "score", "bits_per_byte"}
    return _beside(docs, names, lambda d: language.identify(d).filter(language.confident()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = {"domain", "epoch", "n_tokens", "tokens_taken"}
    return _beside(
        docs, names, lambda d: mixing.mix(d, mix_levels(), MIX_WEIGHTS, total=(3, 4), max_epochs=1)
    )


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, keep=["doc_id"])


STAGES: list[tuple[str, Stage]] = [
    ("language", by_language),
    ("near_duplicates", near_duplicates),
    ("secrets", without_secrets),
    ("mix", mixed),
    ("pack", packed),
]

# Code lengths, key parsing and byte-pair merges have no SQL; tests/llm holds brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table: one row per packed piece."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
