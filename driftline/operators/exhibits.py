"""Side-by-side views of how a document is encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def encodings(doc_terms: DataFrame, vocab: DataFrame, theta: DataFrame, k: int = 5) -> DataFrame:
    """Top terms per document with class document frequency, an out-of-vocabulary
    flag, and the document's ``k`` heaviest topics with their joint share."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("cnt"), "term")
    top = doc_terms.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    top = top.join(vocab.select("cls", "term", "doc_freq"), ["cls", "term"], "left")
    heavy = Window.partitionBy("doc_id").orderBy(F.round("theta", 12).desc(), "k")
    best = theta.withColumn("_r", F.row_number().over(heavy)).filter(F.col("_r") <= k).groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "k"))), lambda x: x["k"].cast("string")), ",").alias("topics"),
        F.sum("theta").alias("topic_share"),
    )
    return top.join(best, "doc_id").select(
        "doc_id", "rank", "term", "cnt", "doc_freq", F.col("doc_freq").isNull().alias("oov"), "topics", "topic_share"
    )
