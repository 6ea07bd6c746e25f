"""Tests, shrinkage and smoothed surfaces from group aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import clip, ratio
from . import ranking


def welch(df: DataFrame, value: str, group: Column) -> DataFrame:
    """Gap, standard error and t of two groups with unequal variances."""
    v = F.col(value).cast("double")
    a, b = F.when(group, v), F.when(~group, v)
    m = df.agg(
        F.count(a).alias("n_a"), F.count(b).alias("n_b"), F.avg(a).alias("mean_a"),
        F.avg(b).alias("mean_b"), F.var_samp(a).alias("_va"), F.var_samp(b).alias("_vb"),
    )
    se = F.sqrt(F.col("_va") / F.col("n_a") + F.col("_vb") / F.col("n_b"))
    m = m.withColumn("gap", F.col("mean_a") - F.col("mean_b")).withColumn("se", se)
    return m.withColumn("t", F.col("gap") / F.nullif(F.col("se"), F.lit(0.0))).drop("_va", "_vb")


def rank_sum(df: DataFrame, value: str, group: str) -> DataFrame:
    """Mann-Whitney U of a boolean grouping with the tie-corrected normal z."""
    rows = df.filter(F.col(value).isNotNull()).select(value, F.col(group).cast("int").alias("_g"))
    per = rows.groupBy(value).agg(F.count(F.lit(1)).alias("cnt"), F.sum("_g").alias("_a"))
    small = ranking.largest_group(rows) <= ranking.SPLIT_ROWS
    pos = ranking.running_total(per, [value], F.col("cnt"), (), "below", small=small or None)
    mid = F.col("below") + (F.col("cnt") + 1) / 2
    c = F.col("cnt").cast("double")
    s = pos.agg(
        F.sum(mid * F.col("_a")).alias("_r"), F.sum("_a").alias("n_a"), F.sum("cnt").alias("_n"),
        F.sum(c * c * c - c).alias("_ties"),
    )
    n, na = F.col("_n").cast("double"), F.col("n_a").cast("double")
    nb = n - na
    s = s.withColumn("n_b", F.col("_n") - F.col("n_a")).withColumn("u", F.col("_r") - na * (na + 1) / 2)
    sd = F.sqrt(na * nb / 12 * ((n + 1) - F.coalesce(ratio(F.col("_ties"), n * (n - 1)), F.lit(0.0))))
    return s.withColumn("z", ratio(F.col("u") - na * nb / 2, sd)).select("n_a", "n_b", "u", "z")


def benjamini_hochberg(df: DataFrame, p: str, key: str, q: float = 0.05) -> DataFrame:
    """Step-up rejection at false discovery rate ``q``."""
    ranked = ranking.sequence_number(df, [p, key], out="_rank")
    m = df.agg(F.count(F.lit(1))).scalar()
    ranked = ranked.withColumn("_ok", F.col(p) <= q * F.col("_rank") / m)
    last = ranked.agg(F.coalesce(F.max(F.when(F.col("_ok"), F.col("_rank"))), F.lit(0))).scalar()
    return ranked.withColumn("rejected", F.col("_rank") <= last).drop("_rank", "_ok")


def shrink_rates(cells: DataFrame, n: str = "n", hits: str = "hits") -> DataFrame:
    """Beta-binomial empirical Bayes: prior by moments, shrunken rate per cell."""
    nn, y = F.col(n).cast("double"), F.col(hits).cast("double")
    total = ranking.with_stats(cells, [], _N=F.sum(nn), _m=F.sum(y) / F.sum(nn), _K=F.count(F.lit(1)), _q=F.sum(nn * nn))
    r, m = y / nn, F.col("_m")
    ss = total.agg(F.sum(nn * (r - m) * (r - m))).scalar()
    out = total.withColumn("_ss", ss)
    num = F.col("_ss") - m * (1 - m) * (F.col("_K") - 1)
    s2 = F.greatest(ratio(num, F.col("_N") - F.col("_q") / F.col("_N")), F.lit(1e-12))
    nu = m * (1 - m) / s2 - 1
    return out.select(
        *cells.columns, m.alias("prior_mean"), nu.alias("prior_n"),
        ((y + nu * m) / (nn + nu)).alias("shrunk"),
    )


def intraclass(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way ANOVA intraclass correlation of ``value`` by ``group``."""
    v = F.col(value).cast("double")
    per = df.groupBy(group).agg(
        F.count(F.lit(1)).cast("double").alias("_c"), F.avg(v).alias("_g"),
        F.coalesce(F.var_pop(v), F.lit(0.0)).alias("_v"),
    )
    c, g = F.col("_c"), F.col("_g")
    s = per.agg(
        F.sum(c).alias("_N"), F.count(F.lit(1)).alias("_G"), F.sum(c * g).alias("_sy"),
        F.sum(c * g * g).alias("_sgg"), F.sum(c * F.col("_v")).alias("_ssw"), F.sum(c * c).alias("_cc"),
    )
    N, G = F.col("_N"), F.col("_G")
    ssb = F.col("_sgg") - F.col("_sy") * F.col("_sy") / N
    msb, msw = ratio(ssb, G - 1), ratio(F.col("_ssw"), N - G)
    m0 = ratio(N - F.col("_cc") / N, G - 1)
    rho = ratio(msb - msw, msb + (m0 - 1) * msw)
    return s.select(N.cast("long").alias("n"), G.alias("n_groups"), clip(rho, 0.0, 1.0).alias("icc"))


def design_effects(df: DataFrame, cell: Sequence[str], group: str, rho: Column) -> DataFrame:
    """1 + (mean cluster size - 1) * rho per cell, size weighted by cluster size."""
    per = df.groupBy(*cell, group).agg(F.count(F.lit(1)).cast("double").alias("_c"))
    out = per.groupBy(*cell).agg(
        F.sum("_c").cast("long").alias("n"), (F.sum(F.col("_c") * F.col("_c")) / F.sum("_c")).alias("mbar")
    )
    deff = F.greatest(1 + (F.col("mbar") - 1) * rho, F.lit(1.0))
    return out.withColumn("deff", deff).withColumn("n_eff", F.col("n") / F.col("deff"))


def hexagons(df: DataFrame, x: str, y: str, outcome: str, lo: float, hi: float, size: int) -> DataFrame:
    """Hexagonal cells: the nearer of two candidate centres on offset lattices."""
    ny = int(size / math.sqrt(3))
    ix, iy = (F.col(x) - lo) / (hi - lo) * size, (F.col(y) - lo) / (hi - lo) * ny
    ax, ay = F.round(ix), F.round(iy)
    bx, by = F.floor(ix), F.floor(iy)
    da = (ix - ax) * (ix - ax) + 3 * (iy - ay) * (iy - ay)
    db = (ix - bx - 0.5) * (ix - bx - 0.5) + 3 * (iy - by - 0.5) * (iy - by - 0.5)
    first = da < db
    cells = df.filter(F.col(x).between(lo, hi) & F.col(y).between(lo, hi)).select(
        F.when(first, ax).otherwise(bx + 0.5).alias("hx"),
        F.when(first, ay).otherwise(by + 0.5).alias("hy"),
        F.col(outcome).cast("double").alias("_y"),
    )
    return cells.groupBy("hx", "hy").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("hits"))


def lattice(df: DataFrame, x: str, y: str, outcome: str, lo: float, hi: float, k: int, by=()) -> DataFrame:
    """k x k counts and sums, values outside clipped to the border cells."""
    h = (hi - lo) / k
    cell = lambda c: clip(F.floor((F.col(c) - lo) / h), 0, k - 1).cast("int")
    g = df.select(cell(x).alias("ix"), cell(y).alias("iy"), F.col(outcome).cast("double").alias("_y"), *by)
    return g.groupBy("ix", "iy", *by).agg(F.count(F.lit(1)).alias("c"), F.sum("_y").alias("s"))


def kernel_surfaces(cells: DataFrame, sigmas: Sequence[float], k: int, by: Sequence[str] = (), reach: float = 5.0) -> DataFrame:
    """Gaussian-kernel rate and effective n on the lattice for every bandwidth (``sigma`` in cells)
    and every group of ``by``.

    The kernel and its square are products over the axes, so cells are spread and summed along
    one axis and then along the other: a cell makes ``2 m + 1`` rows an axis and bandwidth.  The
    input is the k x k lattice, so its size does not depend on the data.
    """
    def along(df: DataFrame, axis: str, other: str) -> DataFrame:
        spread = df.withColumn("_d", F.explode(F.sequence(-F.col("_m"), F.col("_m")))).withColumn(axis, F.col(axis) + F.col("_d"))
        spread = spread.filter(F.col(axis).between(0, k - 1))
        w = F.exp(-(F.col("_d") * F.col("_d")) / (2 * F.col("sigma") * F.col("sigma")))
        return spread.groupBy(*by, "sigma", "_m", axis, other).agg(
            F.sum(w * F.col("_k")).alias("_k"), F.sum(w * F.col("_y")).alias("_y"), F.sum(w * w * F.col("_k2")).alias("_k2")
        )

    widths = F.array(*[F.struct(F.lit(float(s)).alias("sigma"), F.lit(int(reach * s + 0.5)).alias("_m")) for s in sigmas])
    start = cells.select(*by, "ix", "iy", F.col("c").alias("_k"), F.col("s").alias("_y"), F.col("c").alias("_k2"), F.explode(widths).alias("_s"))
    out = along(along(start.select("*", "_s.sigma", "_s._m").drop("_s"), "ix", "iy"), "iy", "ix")
    return out.select(
        *by, "sigma", "ix", "iy", (F.col("_y") / F.col("_k")).alias("rate"), (F.col("_k") * F.col("_k") / F.col("_k2")).alias("n_eff")
    )


def kernel_surface(cells: DataFrame, sigma: float, k: int, reach: float = 5.0) -> DataFrame:
    """One bandwidth of :func:`kernel_surfaces`."""
    return kernel_surfaces(cells, [sigma], k, reach=reach).drop("sigma")


def bandwidth_scores(
    df: DataFrame, x: str, y: str, outcome: str, owner: str, lo: float, hi: float, k: int,
    sigmas: Sequence[float], folds: int = 5, seed: int = 42,
) -> DataFrame:
    """Out-of-fold binomial deviance per bandwidth with folds blocked on the owner: the surfaces
    of all folds and bandwidths in one pass."""
    place = F.md5(F.concat_ws(":", F.col(owner).cast("string"), F.lit(str(seed))).cast("binary"))
    fold = (F.conv(F.substring(place, 1, 8), 16, 10).cast("long") % folds).cast("int")
    cells = lattice(df.withColumn("fold", fold), x, y, outcome, lo, hi, k, ["fold"])
    base = cells.agg((F.sum("s") / F.sum("c"))).scalar()
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("fold"))
    train = cells.select(F.explode(others).alias("out"), "ix", "iy", "c", "s").groupBy("out", "ix", "iy").agg(F.sum("c").alias("c"), F.sum("s").alias("s"))
    held = cells.withColumnRenamed("fold", "out").withColumn("sigma", F.explode(F.array(*[F.lit(float(s)) for s in sigmas])))
    p = held.join(kernel_surfaces(train, sigmas, k, ["out"]).drop("n_eff"), ["out", "sigma", "ix", "iy"], "left")
    rate = clip(F.coalesce("rate", base), 1e-4, 1 - 1e-4)
    dev = -(F.col("s") * F.log(rate) + (F.col("c") - F.col("s")) * F.log(1 - rate))
    return p.groupBy("sigma").agg((F.sum(dev) / F.sum("c")).alias("deviance"))


def tail_bins(df: DataFrame, score: str, outcome: str, k: int) -> DataFrame:
    """Mean magnitude and outcome rate per quantile bin on each side of zero."""
    d = df.filter(F.col(score) != 0).select(
        F.when(F.col(score) < 0, "neg").otherwise("pos").alias("side"),
        F.abs(score).alias("mag"), F.col(outcome).cast("double").alias("_y"),
    )
    b = ranking.quantile_bin(d, "mag", k, ["side"])
    return b.groupBy("side", "bin").agg(F.avg("mag").alias("x"), F.avg("_y").alias("y"), F.count(F.lit(1)).alias("n"))


def log_linear_tails(bins: DataFrame, min_n: int = 100, min_bins: int = 4) -> DataFrame:
    """log rate = a + b |x| on the bins of each side."""
    b = bins.filter(F.col("n") >= min_n).withColumn("_ly", F.log(F.col("y") + 1e-9))
    out = b.groupBy("side").agg(
        F.count(F.lit(1)).alias("n_bins"), F.regr_intercept("_ly", "x").alias("a"),
        F.regr_slope("_ly", "x").alias("b"), F.regr_r2("_ly", "x").alias("r2"),
    )
    return out.filter(F.col("n_bins") >= min_bins)


def exponential_tails(bins: DataFrame, rates: Sequence[float] = tuple(0.1 * 1.15**i for i in range(50))) -> DataFrame:
    """y = a + b exp(-c x) per side: for fixed c the fit is linear, so the best c
    of a grid is found by aggregates over the few bins."""
    c = bins.withColumn("c", F.explode(F.array(*[F.lit(float(x)) for x in rates])))
    c = c.withColumn("_e", F.exp(-F.col("c") * F.col("x")))
    f = c.groupBy("side", "c").agg(
        F.regr_intercept("y", "_e").alias("a"), F.regr_slope("y", "_e").alias("b"), F.regr_r2("y", "_e").alias("r2")
    )
    w = Window.partitionBy("side").orderBy(F.desc_nulls_last("r2"), "c")
    return f.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")
