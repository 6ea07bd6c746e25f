"""Owner debuts, shares, tiers and firm-level panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import correlation, ratio, share
from . import ranking
from .regression import demean


def debuts(rows: DataFrame, owner: str = "owner", key: str = "case_id") -> DataFrame:
    """One row per owner: the record on the owner's first date with the lowest key."""
    cols = [c for c in rows.columns if c not in (owner, "filed", key)]
    first = rows.groupBy(owner).agg(F.min_by(F.struct("filed", key, *cols), F.struct("filed", key)).alias("_f"))
    return first.select(owner, "_f.*")


def debut_flags(rows: DataFrame, owner: str = "owner") -> DataFrame:
    out = ranking.with_stats(rows, [owner], _first=F.min("filed"))
    return out.withColumn("is_debut", F.col("filed") == F.col("_first")).drop("_first")


def share_shift(cells: DataFrame, by: str = "cls") -> DataFrame:
    """Within and composition parts of the yearly change of a pooled share.

    ``cells``: (by, year, n, hits); one row per class and year.
    """
    tot = cells.groupBy("year").agg(F.sum("n").alias("_t"))
    c = cells.join(tot, "year").select(
        by, "year", (F.col("hits") / F.col("n")).alias("_s"), (F.col("n") / F.col("_t")).alias("_w")
    )
    w = Window.partitionBy(by).orderBy("year")
    ds, dw = F.col("_s") - F.lag("_s").over(w), F.col("_w") - F.lag("_w").over(w)
    c = c.withColumn("_in", F.lag("_w").over(w) * ds).withColumn("_mix", F.lag("_s").over(w) * dw)
    return c.groupBy(by).agg(
        F.sum("_in").alias("within"), F.sum("_mix").alias("composition"), F.sum(F.col("_in") + F.col("_mix")).alias("total")
    )


def series_coverage(own: DataFrame, external: DataFrame) -> DataFrame:
    """Yearly ratio of two series (year, n) / (year, ext)."""
    return own.join(external, "year").withColumn("ratio", ratio(F.col("n"), F.col("ext")))


def level_and_growth_corr(series: DataFrame) -> DataFrame:
    """Correlation in levels and in yearly changes (a row per year)."""
    w = Window.partitionBy(F.lit(0)).orderBy("year")
    d = series.withColumn("_dn", F.col("n") - F.lag("n").over(w)).withColumn("_de", F.col("ext") - F.lag("ext").over(w))
    return d.agg(
        F.count(F.lit(1)).alias("n_years"), correlation(F.col("n").cast("double"), F.col("ext").cast("double")).alias("corr_level"),
        correlation(F.col("_dn").cast("double"), F.col("_de").cast("double")).alias("corr_growth"),
    )


def scale_strata(rows: DataFrame, small: int, large: int, outcome: Column, owner: str = "owner") -> DataFrame:
    """Small and large owners by high and low level: size, mean lead, outcome."""
    d = ranking.with_stats(rows, [owner], _n=F.count(F.lit(1)))
    d = ranking.with_quantiles(d, "level", [0.5], ["_med"])
    size = F.when(F.col("_n") <= small, "small").when(F.col("_n") >= large, "large")
    d = d.withColumn("size", size).filter(F.col("size").isNotNull())
    d = d.withColumn("band", F.when(F.col("level") > F.col("_med"), "high").otherwise("low"))
    return d.groupBy("size", "band").agg(
        F.count(F.lit(1)).alias("n"), F.avg("lead").alias("mean_lead"), share(outcome).alias("rate")
    )


def diversification(rows: DataFrame, owner: str = "owner", key: str = "case_id") -> DataFrame:
    out = rows.groupBy(owner).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("cls").alias("n_classes"),
        F.min_by("cls", F.struct("filed", key)).alias("debut_cls"),
        F.avg("lead").alias("mean_lead"), F.stddev_samp("lead").alias("sd_lead"),
    )
    k = F.col("n_classes")
    return out.withColumn("tier", F.when(k == 1, "single").when(k <= 3, "2-3").otherwise("4+"))


def membership_contrast(firms: DataFrame, value: str, listed: Column) -> DataFrame:
    """Mean gap of listed against other firms in sds of the others, and its z."""
    v = F.col(value)
    on, off = F.when(listed, v), F.when(~listed, v)
    s = firms.agg(
        F.count(on).alias("n_on"), F.count(off).alias("n_off"), F.avg(on).alias("mean_on"), F.avg(off).alias("mean_off"),
        F.stddev_samp(off).alias("_sd"),
    )
    gap = F.col("mean_on") - F.col("mean_off")
    return s.select("n_on", "n_off", "mean_on", "mean_off", ratio(gap, F.col("_sd")).alias("gap_sd"),
                    ratio(gap * F.sqrt("n_on"), F.col("_sd")).alias("z"))


def finance_rollup(panel: DataFrame, entity: str, value: str, margin: str, min_years: int) -> DataFrame:
    out = panel.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n_years"), F.max(value).alias("peak"), F.avg(value).alias("mean"), F.stddev_samp(margin).alias("sd_margin")
    ).filter(F.col("n_years") >= min_years)
    med = ranking.quantiles(panel, value, [0.5], [entity], ["median"])
    return out.join(med, entity)


def within_between(panel: DataFrame, x: str, y: str, entity: str) -> DataFrame:
    """Correlation of entity means, and of what is left after entity and year means."""
    m = panel.groupBy(entity).agg(F.avg(x).alias("_x"), F.avg(y).alias("_y"))
    left = demean(demean(panel.select(entity, "year", x, y), [x, y], entity), [x, y], "year")
    return m.agg(F.count(F.lit(1)).alias("n_entities"), correlation("_x", "_y").alias("between")).withColumn(
        "within", left.agg(correlation(x, y)).scalar()
    )


def distinct_items_per_year(rows: DataFrame, entity: str, item: str) -> DataFrame:
    return rows.groupBy(entity, "year").agg(F.countDistinct(item).alias("n_items"))


def class_summary(
    rows: DataFrame, outcome: Column, by: Sequence[str] = ("cls",), key: str = "case_id", value: str = "lead", k: int = 3
) -> DataFrame:
    """Size, owners, span, means and outcome per class, with its ``k`` largest owners and the
    rows with the highest and lowest value as examples."""
    by = list(by)
    base = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("owner").alias("n_owners"),
        F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.avg("lead").alias("mean_lead"), F.avg("level").alias("mean_level"), share(outcome).alias("rate"),
    )

    def best(df: DataFrame, order: Sequence[Column], item: str, out: str) -> DataFrame:
        """The first ``k`` items of each class as one string."""
        w = Window.partitionBy(*by).orderBy(*order)
        top = df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
        items = F.array_sort(F.collect_list(F.struct("_r", F.col(item).cast("string").alias("v"))))
        return top.groupBy(*by).agg(F.array_join(F.transform(items, lambda x: x["v"]), ",").alias(out))

    per = rows.groupBy(*by, "owner").agg(F.count(F.lit(1)).alias("_k"))
    out = base.join(best(per, [F.desc("_k"), F.col("owner")], "owner", "top_owners"), by)
    out = out.join(best(rows, [F.desc(value), F.col(key)], key, "highest"), by)
    return out.join(best(rows, [F.asc(value), F.col(key)], key, "lowest"), by)
