"""Grouped summaries: owner-years, concentration, cohorts, size tiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import ladder, ratio, wilson_bounds
from . import ranking
from .surprise import clean_condition


def owner_year(
    scores: DataFrame, high: float = 0.5, min_past: int = 1000, min_future: int = 1000,
    min_terms: int = 3, owner: str = "owner",
) -> DataFrame:
    """Owner-year table of scored documents; means and quantiles over clean rows."""
    lead = F.col("kl_past") - F.col("kl_future")
    df = scores.filter(F.col(owner).isNotNull() & F.col("year").isNotNull()).withColumn(
        "_ok", clean_condition(min_past, min_future, min_terms)
    ).withColumn("_lead", lead)
    ok = F.col("_ok")

    def only(c):
        return F.when(ok, F.col(c))

    out = df.groupBy(owner, "year").agg(
        F.count(F.lit(1)).alias("n_filings"),
        F.count_if(ok).alias("n_clean"),
        F.avg(only("_lead")).alias("mean_lead"),
        F.max(only("_lead")).alias("max_lead"),
        F.count_if(ok & (F.col("_lead") >= high)).alias("n_high"),
        F.avg(only("kl_past")).alias("mean_past"),
        F.avg(only("kl_future")).alias("mean_future"),
        F.coalesce(F.sum(only("n_terms")), F.lit(0)).alias("n_terms_total"),
    ).withColumn("share_high", ratio(F.col("n_high"), F.col("n_clean")))
    p90 = ranking.quantiles(
        df.filter(ok), "_lead", [0.9], [owner, "year"], ["p90_lead"], method="nearest"
    )
    return out.join(p90, [owner, "year"], "left")


def concentration(
    df: DataFrame, entity: str, by: Sequence[str], k: int = 10, floor: int = 0
) -> DataFrame:
    """HHI (0..10,000), top-k count and share, distinct entities per cell.

    Rows are first counted per entity, so a cell's largest owner is one row.
    """
    per = df.groupBy(*by, entity).agg(F.count(F.lit(1)).alias("_n"))
    totals = per.groupBy(*by).agg(
        F.sum("_n").alias("n"),
        F.count(F.lit(1)).alias("n_entities"),
        F.sum(F.col("_n").cast("double") * F.col("_n")).alias("_sq"),
    )
    w = Window.partitionBy(*by).orderBy(F.desc("_n"), entity)
    top = per.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    top = top.groupBy(*by).agg(F.sum("_n").alias("n_top"))
    out = totals.join(top, list(by)).filter(F.col("n") >= floor)
    return out.select(
        *by, "n", "n_entities", "n_top",
        (F.col("n_top") / F.col("n")).alias("top_share"),
        (F.col("_sq") / F.col("n") / F.col("n") * 10000).alias("hhi"),
    )


def entropy_concentration(
    df: DataFrame, category: str, by: Sequence[str], categories: int, value: str, floor: int = 0
) -> DataFrame:
    """Largest share, 1 - H / ln(categories), and the count-weighted mean of ``value``."""
    cells = df.groupBy(*by, category).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(value).alias("_m")
    )
    tot = cells.groupBy(*by).agg(F.sum("_n").alias("n"))
    cells = cells.join(tot, list(by)).withColumn("_s", F.col("_n") / F.col("n"))
    import math

    out = cells.groupBy(*by).agg(
        F.max("n").alias("n"),
        F.max("_s").alias("max_share"),
        (1 + F.sum(F.col("_s") * F.log("_s")) / math.log(categories)).alias("concentration"),
        (F.sum(F.col("_m") * F.col("_n")) / F.sum("_n")).alias("weighted_mean"),
    )
    return out.filter(F.col("n") >= floor)


def dominant_category(df: DataFrame, entity: str, category: str) -> DataFrame:
    """Most frequent category per entity, the lower code on ties."""
    n = df.groupBy(entity, category).agg(F.count(F.lit(1)).alias("_n"))
    best = n.groupBy(entity).agg(F.min(F.struct((-F.col("_n")).alias("m"), category)).alias("_b"))
    return best.select(entity, F.col(f"_b.{category}").alias(category), (-F.col("_b.m")).alias("n"))


def outcome_cohorts(
    df: DataFrame, entity: str, outcome: Column, min_rows: int = 3
) -> DataFrame:
    """all / none / mixed label per entity with enough rows."""
    per = df.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(outcome).alias("n_good")
    ).filter(F.col("n") >= min_rows)
    label = (
        F.when(F.col("n_good") == F.col("n"), "all").when(F.col("n_good") == 0, "none")
    ).otherwise("mixed")
    return per.withColumn("cohort", label)


def tier_shares(df: DataFrame, entity: str, by: Sequence[str], k: int = 10) -> DataFrame:
    """Share of a cell's volume from entities with 1, 2-9 and 10+ rows and from the top k."""
    per = df.groupBy(*by, entity).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy(F.desc("_n"), entity)
    top = per.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    top = top.groupBy(*by).agg(F.sum("_n").alias("_top"))
    n = F.col("_n")
    out = per.groupBy(*by).agg(
        F.sum("_n").alias("n"),
        F.sum(F.when(n == 1, n).otherwise(0)).alias("_single"),
        F.sum(F.when(n.between(2, 9), n).otherwise(0)).alias("_mid"),
        F.sum(F.when(n >= 10, n).otherwise(0)).alias("_heavy"),
    ).join(top, list(by))
    return out.select(
        *by, "n",
        *[(F.col(f"_{t}") / F.col("n")).alias(f"{t}_share") for t in ("single", "mid", "heavy", "top")],
    )


SIZE_EDGES = [(1, "1"), (2, "2"), (5, "3-5"), (10, "6-10"), (20, "11-20"), (50, "21-50")]


def outcome_by_size(df: DataFrame, entity: str, outcome: Column, edges=None) -> DataFrame:
    """Pooled outcome by size of the owning entity, with a Wilson interval."""
    per = df.groupBy(entity).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(outcome).alias("_h")
    ).withColumn("size", ladder(F.col("_n"), edges or SIZE_EDGES, "50+"))
    out = per.groupBy("size").agg(
        F.count(F.lit(1)).alias("n_entities"),
        F.sum("_n").alias("n"),
        F.sum("_h").alias("_hits"),
        F.avg(F.col("_h") / F.col("_n")).alias("entity_rate"),
    ).withColumn("rate", F.col("_hits") / F.col("n"))
    lo, hi = wilson_bounds(F.col("rate"), F.col("n"))
    return out.withColumn("lo", lo).withColumn("hi", hi).drop("_hits")
