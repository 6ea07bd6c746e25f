"""Repeated texts: how often a normalised text occurs and how its copies fare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..functions.scalars import ladder, wilson_bounds

# Multiplicity bins (inclusive upper edge, label).
COPY_BINS = [
    (1, "1"), (2, "2"), (5, "3-5"), (10, "6-10"), (50, "11-50"),
    (200, "51-200"), (1000, "201-1000"), (5000, "1001-5000"),
]


def keyed_templates(docs: DataFrame, text: str = "body", min_len: int = 5) -> DataFrame:
    keyed = docs.withColumn("template", tx.template_key(text))
    return keyed.filter(F.length("template") >= min_len)


def copy_counts(docs: DataFrame, text: str = "body", key: str = "doc_id", min_len: int = 5):
    """Documents per normalised text, each document key once."""
    keyed = keyed_templates(docs, text, min_len).select(key, "template").distinct()
    return keyed.groupBy("template").agg(F.count(F.lit(1)).alias("n_copies"))


def outcome_by_copies(docs: DataFrame, outcome: Column, **kw) -> DataFrame:
    """Outcome rate and Wilson interval per multiplicity bin.

    Copies are collapsed to (template, n, hits) before anything is joined, so a
    text shared by a third of the rows is one row here.
    """
    keyed = keyed_templates(docs, **kw)
    per = keyed.groupBy("template").agg(
        F.count(F.lit(1)).alias("n_copies"), F.count_if(outcome).alias("hits")
    )
    binned = per.withColumn("copies", ladder(F.col("n_copies"), COPY_BINS, "5000+"))
    out = binned.groupBy("copies").agg(
        F.count(F.lit(1)).alias("n_templates"),
        F.sum("n_copies").alias("n"),
        F.sum("hits").alias("hits"),
    )
    out = out.withColumn("rate", F.col("hits") / F.col("n"))
    lo, hi = wilson_bounds(F.col("rate"), F.col("n"))
    return out.withColumn("lo", lo).withColumn("hi", hi)


def top_templates(docs: DataFrame, outcome: Column, k: int = 50, **kw) -> DataFrame:
    per = keyed_templates(docs, **kw).groupBy("template").agg(
        F.count(F.lit(1)).alias("n_copies"), F.avg(outcome.cast("double")).alias("rate")
    )
    return per.orderBy(F.desc("n_copies"), "template").limit(k)
