"""Summaries and reliability checks of score tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import correlation, share
from . import ranking


def summary(scores: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, sd, quantiles, share positive and the correlation of both sides."""
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        share(F.col(value) > 0).alias("share_positive"),
        F.avg(F.abs(value)).alias("mean_abs"),
        correlation("kl_past", "kl_future").alias("corr_sides"),
    ]
    q = ranking.quantiles(scores, value, [0.1, 0.5, 0.9], by, ["p10", "p50", "p90"])
    if by:
        return scores.groupBy(*by).agg(*aggs).join(q, list(by))
    row = scores.agg(*aggs)
    for c in ("p10", "p50", "p90"):
        row = row.withColumn(c, q.select(c).scalar())
    return row


def extremes(scores: DataFrame, value: str, key: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    """k highest and k lowest rows, per group or overall."""
    out = None
    for side, order in (("high", F.desc(value)), ("low", F.asc(value))):
        if by:
            w = Window.partitionBy(*by).orderBy(order, key)
            part = scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        else:
            w = Window.partitionBy(F.lit(0)).orderBy(order, key)
            part = scores.orderBy(order, key).limit(k).withColumn("rank", F.row_number().over(w))
        part = part.withColumn("side", F.lit(side))
        out = part if out is None else out.unionByName(part)
    return out


def length_bins(n: Column) -> Column:
    return (
        F.when(n < 5, "1:<5").when(n < 15, "2:5-14").when(n < 40, "3:15-39").otherwise("4:40+")
    )


def length_reliability(scores: DataFrame, other: DataFrame, bins: Column | None = None):
    """Mean magnitude of the lead by document length for two scorings of the same
    documents and how often their signs differ."""
    second = other.select("doc_id", F.col("lead").alias("_lead2"))
    j = scores.join(second, "doc_id").withColumn("length", length_bins(F.col("n_terms")) if bins is None else bins)
    return j.groupBy("length").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs("lead")).alias("mean_abs"),
        F.avg(F.abs("_lead2")).alias("mean_abs_other"),
        share(F.signum("lead") != F.signum("_lead2")).alias("flip_rate"),
    )


def residualise(
    scores: DataFrame, values: Sequence[str], on: str, by: Sequence[str] = (), min_rows: int = 5
) -> DataFrame:
    """Residual of each value after a straight-line fit on ``on``, pooled or per
    group; groups under ``min_rows`` are only centred."""
    stats = {}
    for v in values:
        stats[f"_{v}_b"] = F.regr_slope(v, on)
        stats[f"_{v}_a"] = F.regr_intercept(v, on)
        stats[f"_{v}_r2"] = F.regr_r2(v, on)
        stats[f"_{v}_m"] = F.avg(v)
    stats["_rows"] = F.count(F.lit(1))
    out = ranking.with_stats(scores, by, **stats)
    for v in values:
        fit = F.col(f"_{v}_a") + F.col(f"_{v}_b") * F.col(on)
        small = F.col("_rows") < min_rows
        out = out.withColumn(
            f"{v}_resid", F.col(v) - F.when(small, F.col(f"_{v}_m")).otherwise(fit)
        )
        out = out.withColumnsRenamed(
            {f"_{v}_b": f"{v}_slope", f"_{v}_a": f"{v}_intercept", f"_{v}_r2": f"{v}_r2"}
        ).drop(f"_{v}_m")
    return out.drop("_rows")


def compare_by(a: DataFrame, b: DataFrame, by: Column, value: str = "lead", key: str = "doc_id") -> DataFrame:
    """Means, sds and, from three rows on, the correlation of two scorings per period of ``a``."""
    j = a.select(key, by, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key)
    j = j.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    period = [c for c in j.columns if c not in (key, "a", "b")]
    out = j.groupBy(*period).agg(
        F.count(F.lit(1)).alias("n"), correlation("a", "b").alias("pearson"), F.avg("a").alias("mean_a"),
        F.avg("b").alias("mean_b"), F.stddev_samp("a").alias("sd_a"), F.stddev_samp("b").alias("sd_b"),
    )
    return out.withColumn("pearson", F.when(F.col("n") > 2, F.col("pearson")))


def compare_scorings(a: DataFrame, b: DataFrame, value: str = "lead", key: str = "doc_id"):
    """Pearson, Spearman, means and sds of two scorings on identical rows."""
    j = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key)
    j = j.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    stats = j.agg(
        correlation("a", "b").alias("pearson"),
        F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"),
        F.stddev_samp("a").alias("sd_a"), F.stddev_samp("b").alias("sd_b"),
    )
    rho = ranking.spearman(j, "a", "b", out="spearman")
    return stats.crossJoin(F.broadcast(rho))  # a row each
