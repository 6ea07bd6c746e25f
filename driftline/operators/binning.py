"""Binned curves and grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import ratio, share, wilson_bounds
from . import ranking


def quantile_curve(
    df: DataFrame, score: str, outcome: str, k: int = 20, by: Sequence[str] = ()
) -> DataFrame:
    """n, rate, mean position and Wilson interval per quantile bin."""
    binned = ranking.quantile_bin(df.filter(F.col(score).isNotNull()), score, k, by)
    out = binned.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"),
        share(F.col(outcome)).alias("rate"),
        F.avg(score).alias("mid"),
    )
    lo, hi = wilson_bounds(F.col("rate"), F.col("n"))
    return out.withColumn("lo", lo).withColumn("hi", hi)


def fixed_edges(df: DataFrame, value: str, edges: Sequence[float], out: str = "bin") -> DataFrame:
    """Half-open bins [e_i, e_i+1); values outside get NULL."""
    v, b = F.col(value), None
    for i in range(len(edges) - 1):
        cond = (v >= edges[i]) & (v < edges[i + 1])
        b = F.when(cond, i) if b is None else b.when(cond, i)
    return df.withColumn(out, b)


def linear_bin(
    df: DataFrame, value: str, k: int, q_lo: float = 0.02, q_hi: float = 0.98, out: str = "bin",
    by: Sequence[str] = (), centre: str | None = "centre",
) -> DataFrame:
    """k equal bins between two quantiles, [edge_i, edge_i+1); outside dropped."""
    lo, hi = f"_{out}_lo", f"_{out}_hi"
    cut = ranking.with_quantiles(df, value, [q_lo, q_hi], [lo, hi], by)
    width = (F.col(hi) - F.col(lo)) / k
    v = F.col(value)
    kept = cut.filter((v >= F.col(lo)) & (v < F.col(hi)))
    kept = kept.withColumn(out, F.least(F.floor((v - F.col(lo)) / width), F.lit(k - 1)).cast("int"))
    if centre:
        kept = kept.withColumn(centre, F.col(lo) + (F.col(out) + 0.5) * width)
    return kept.drop(lo, hi)


def bin_means(
    df: DataFrame, y: str, by: Sequence[str], min_n: int = 30, draws: int = 0, seed: int = 42,
    key: str | None = None,
) -> DataFrame:
    """Mean per bin; with ``draws`` a bootstrap interval as well.

    The bootstrap reweights each row by a Poisson(1) draw made from a hash of
    its key, so all draws are sums in one aggregation and repeat exactly.
    """
    base = [F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean")]
    for i in range(draws):
        u = (F.pmod(F.xxhash64(F.col(key), F.lit(seed + i)), F.lit(1 << 30)) + 0.5) / (1 << 30)
        cum, p, w = 0.0, 0.36787944117144233, F.lit(0)
        for j in range(8):
            cum += p
            w = w + (u > cum).cast("int")
            p /= j + 1
        base.append((F.sum(w * F.col(y)) / F.sum(w)).alias(f"_d{i}"))
    out = df.groupBy(*by).agg(*base).filter(F.col("n") >= min_n)
    if draws:
        s = F.array_sort(F.array(*[F.col(f"_d{i}") for i in range(draws)]))
        lo, hi = int(0.025 * (draws - 1)), int(round(0.975 * (draws - 1)))
        out = out.withColumn("lo", s[lo]).withColumn("hi", s[hi])
        out = out.drop(*[f"_d{i}" for i in range(draws)])
    return out


def curve_shape(bins: DataFrame, x: str, y: str, by: Sequence[str] = (), min_bins: int = 5):
    """Peak position, slopes left and right of it, overall slope and curvature.

    Works on the few rows of a binned curve.
    """
    peak = bins.groupBy(*by).agg(
        F.max_by(x, F.struct(F.col(y), -F.col(x))).alias("_px"),
        F.max(y).alias("y_max"),
        F.min(x).alias("_x0"),
        F.max(x).alias("_x1"),
        F.avg(x).alias("_mx"),
    )
    j = bins.join(peak, list(by))
    xc, yv, p = F.col(x) - F.col("_mx"), F.col(y), F.col("_px")
    out = j.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_bins"),
        F.max("y_max").alias("y_max"),
        F.max("_px").alias("argmax"),
        F.max(ratio(p - F.col("_x0"), F.col("_x1") - F.col("_x0"))).alias("argmax_pos"),
        F.min_by(y, x).alias("y_at_low"),
        F.max_by(y, x).alias("y_at_high"),
        F.coalesce(
            F.regr_slope(F.when(F.col(x) <= p, yv), F.when(F.col(x) <= p, F.col(x))), F.lit(0.0)
        ).alias("slope_left"),
        F.coalesce(
            F.regr_slope(F.when(F.col(x) >= p, yv), F.when(F.col(x) >= p, F.col(x))), F.lit(0.0)
        ).alias("slope_right"),
        F.regr_slope(yv, F.col(x)).alias("overall_slope"),
        *[F.sum(F.pow(xc, F.lit(i))).alias(f"_s{i}") for i in range(1, 5)],
        *[F.sum(F.pow(xc, F.lit(i)) * yv).alias(f"_t{i}") for i in range(3)],
    )
    n, s1, s2, s3, s4 = (F.col(c) for c in ("n_bins", "_s1", "_s2", "_s3", "_s4"))
    t0, t1, t2 = (F.col(f"_t{i}") for i in range(3))
    det = n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2)
    num = n * (s2 * t2 - s3 * t1) - s1 * (s1 * t2 - s3 * t0) + s2 * (s1 * t1 - s2 * t0)
    out = out.withColumn("curvature", ratio(num, det)).filter(n >= min_bins)
    return out.drop(*[f"_s{i}" for i in range(1, 5)], *[f"_t{i}" for i in range(3)])


def grid(df: DataFrame, x: str, y: str, outcome: str, k: int = 36) -> DataFrame:
    """k x k grid between the 2nd and 98th percentile of both scores."""
    names = ["_x0", "_x1"]
    cut = ranking.with_quantiles(df, x, [0.02, 0.98], names)
    cut = ranking.with_quantiles(cut, y, [0.02, 0.98], ["_y0", "_y1"])
    inside = F.col(x).between(F.col("_x0"), F.col("_x1")) & F.col(y).between(
        F.col("_y0"), F.col("_y1")
    )

    def cell(v, lo, hi):
        raw = F.floor(ratio(F.col(v) - F.col(lo), F.col(hi) - F.col(lo)) * k)
        return F.least(raw, F.lit(k - 1)).cast("int")

    binned = cut.filter(inside).select(
        cell(x, "_x0", "_x1").alias("gx"), cell(y, "_y0", "_y1").alias("gy"), outcome
    )
    return binned.groupBy("gx", "gy").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(outcome).cast("double")).alias("mean")
    )


def corner_penalty(
    df: DataFrame, x: str, y: str, outcome: str, qs: Sequence[float] = (0.25, 0.10)
) -> DataFrame:
    """Outcome in the low-low corner at each quantile against the rest of the
    first corner's complement."""
    names = [f"{a}{i}" for i in range(len(qs)) for a in ("_cx", "_cy")]
    cut = ranking.with_quantiles(df, x, list(qs), names[0::2])
    cut = ranking.with_quantiles(cut, y, list(qs), names[1::2])
    out = F.col(outcome).cast("double")
    corner = [
        (F.col(x) < F.col(names[2 * i])) & (F.col(y) < F.col(names[2 * i + 1]))
        for i in range(len(qs))
    ]
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(F.when(~corner[0], out)).alias("rest")]
    for i, q in enumerate(qs):
        tag = str(round(q * 100))
        aggs += [F.count_if(corner[i]).alias(f"n_{tag}"), F.avg(F.when(corner[i], out)).alias(f"rate_{tag}")]
    res = cut.agg(*aggs)
    for q in qs:
        tag = str(round(q * 100))
        res = res.withColumn(f"penalty_{tag}", F.col("rest") - F.col(f"rate_{tag}"))
    return res


def duplication(df: DataFrame, key: str) -> DataFrame:
    """How many keys occur how often."""
    k = df.groupBy(key).agg(F.count(F.lit(1)).alias("copies"))
    return k.groupBy("copies").agg(F.count(F.lit(1)).alias("n_keys"))


def clustered_contrast(df: DataFrame, score: str, outcome: str, key: str, k: int = 5) -> DataFrame:
    """Top-minus-bottom contrast with a key-clustered standard error from the
    summed influence of each key's rows."""
    b = ranking.quantile_bin(df.filter(F.col(score).isNotNull()), score, k, out="_b")
    y = F.col(outcome).cast("double")
    at = {"lo": F.col("_b") == 1, "hi": F.col("_b") == k}
    stats = {}
    for n, c in at.items():
        stats[f"_p{n}"] = F.avg(F.when(c, y))
        stats[f"_n{n}"] = F.count_if(c)
    b = ranking.with_stats(b, [], **stats)
    infl = (
        F.when(at["hi"], (y - F.col("_phi")) / F.col("_nhi"))
        .when(at["lo"], -(y - F.col("_plo")) / F.col("_nlo"))
        .otherwise(0.0)
    )
    per = b.withColumn("_i", infl).groupBy(key).agg(
        F.sum("_i").alias("_s"), F.count(F.lit(1)).alias("_m"),
        F.max("_phi").alias("_phi"), F.max("_plo").alias("_plo"),
    )
    return per.agg(
        F.sum("_m").alias("n_rows"),
        F.count(F.lit(1)).alias("n_keys"),
        F.max(F.col("_phi") - F.col("_plo")).alias("lift"),
        F.sqrt(F.sum(F.col("_s") * F.col("_s"))).alias("cluster_se"),
    )


def winsorise(df: DataFrame, value: str, lo: float = 0.01, hi: float = 0.99, out: str | None = None):
    cut = ranking.with_quantiles(df, value, [lo, hi], ["_wl", "_wh"])
    clipped: Column = F.greatest(F.col("_wl"), F.least(F.col("_wh"), F.col(value)))
    return cut.withColumn(out or value, clipped).drop("_wl", "_wh")
