"""How the use of phrases and words moves over the years."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx


def phrase_shares(docs: DataFrame, phrases: dict[str, str], min_docs: int = 50) -> DataFrame:
    """Share of each year's documents with each phrase: one pass over the text."""
    flagged = docs.select("year", *[tx.has_phrase("body", p).alias(k) for k, p in phrases.items()])
    wide = flagged.groupBy("year").agg(
        F.count(F.lit(1)).alias("n_docs"), *[F.count_if(F.col(k)).alias(k) for k in phrases]
    )
    pairs = ", ".join(f"'{k}', `{k}`" for k in phrases)
    out = wide.filter(F.col("n_docs") >= min_docs).selectExpr(
        "year", "n_docs", f"stack({len(phrases)}, {pairs}) as (phrase, hits)"
    )
    return out.withColumn("share", F.col("hits") / F.col("n_docs"))


def word_year_frequency(docs: DataFrame) -> DataFrame:
    """Share of a year's documents that use a word (each document once)."""
    words = docs.select("year", F.explode(tx.word_set("body")).alias("word"))
    counts = words.groupBy("word", "year").agg(F.count(F.lit(1)).alias("n"))
    years = docs.groupBy("year").agg(F.count(F.lit(1)).alias("n_docs"))
    return counts.join(years, "year").withColumn("freq", F.col("n") / F.col("n_docs"))


def first_last_lift(
    freq: DataFrame, first: tuple[int, int], last: tuple[int, int], min_years: int = 2
) -> DataFrame:
    """Mean frequency in the last period over the first, and the yearly slope of
    log frequency."""
    out = freq.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_years"),
        F.avg(F.when(F.col("year").between(*first), F.col("freq"))).alias("_f"),
        F.avg(F.when(F.col("year").between(*last), F.col("freq"))).alias("_l"),
        F.regr_slope(F.log("freq"), F.col("year").cast("double")).alias("log_slope"),
    )
    return (
        out.filter(F.col("n_years") >= min_years)
        .withColumn("lift", F.col("_l") / F.col("_f"))
        .drop("_f", "_l")
    )
