"""Themes over classes and years: panels, arrivals, spread, carriers."""

from __future__ import annotations

import math

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import correlation, ratio, share
from . import ranking


def panel(theta: DataFrame, top: DataFrame, tau: float, floor: int = 10) -> DataFrame:
    """Per theme, class and year: share of documents topped by the theme and share
    carrying it at ``tau``; class-years under ``floor`` documents drop out.

    Every document has a row per theme, so the theta table is its own frame.
    """
    t = theta.join(top.select("doc_id", "top_topic"), "doc_id")
    out = t.groupBy(F.col("k").alias("theme"), "cls", "year").agg(
        F.count(F.lit(1)).alias("n_cy"),
        share(F.col("k") == F.col("top_topic")).alias("share_top"),
        share(F.col("theta") >= tau).alias("share_tau"),
        F.avg("theta").alias("mean_theta"),
    )
    return out.filter(F.col("n_cy") >= floor)


def autocorrelation(series: DataFrame, value: str, min_years: int = 4) -> DataFrame:
    """Lag-1 autocorrelation of each theme's series in a class (a row per year)."""
    w = Window.partitionBy("theme", "cls").orderBy("year")
    s = series.withColumn("_p", F.lag(value).over(w)).filter(F.col("_p").isNotNull())
    out = s.groupBy("theme", "cls").agg(F.count(F.lit(1)).alias("n_pairs"), correlation(value, "_p").alias("ar1"))
    return out.filter(F.col("n_pairs") >= min_years)


def shuffled(top: DataFrame, seed: int) -> DataFrame:
    """The same documents with their theme labels permuted: the i-th document of
    one hash order takes the label of the i-th of another.  The orders are those of the
    MD5 of ``doc_id:seed``, which other engines have as well."""
    place = lambda s: F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(str(s))).cast("binary"))
    a = ranking.sequence_number(top.withColumn("_h", place(seed)), ["_h", "doc_id"])
    b = ranking.sequence_number(top.withColumn("_h", place(-seed - 1)), ["_h", "doc_id"])
    labels = b.select("seq", F.col("top_topic").alias("_t"))
    return a.join(labels, "seq").withColumn("top_topic", F.col("_t")).drop("_t", "_h", "seq")


def top_share_series(top: DataFrame, floor: int) -> DataFrame:
    """share_top per theme, class and year from labels alone (zeros included)."""
    n = top.groupBy("cls", "year").agg(F.count(F.lit(1)).alias("n_cy")).filter(F.col("n_cy") >= floor)
    c = top.groupBy("top_topic", "cls", "year").agg(F.count(F.lit(1)).alias("c"))
    themes = top.select(F.col("top_topic").alias("theme"), "cls").distinct()
    grid = themes.join(n, "cls")
    j = grid.join(c.withColumnRenamed("top_topic", "theme"), ["theme", "cls", "year"], "left")
    return j.withColumn("share_top", F.coalesce("c", F.lit(0)) / F.col("n_cy")).drop("c")


def ahead_behind(rows: DataFrame, floor: int = 50) -> DataFrame:
    """Rank correlation of lead and year per theme and class; share negative."""
    out = ranking.spearman(rows, "lead", "year", ["theme", "cls"]).filter(F.col("n") >= floor)
    return ranking.with_stats(out, [], share_negative=share(F.col("rho") < 0))


def examples(theta: DataFrame, lengths: DataFrame, k: int = 8, min_terms: int = 10, from_year: int = 0) -> DataFrame:
    """Strongest documents per theme with floors on length and year."""
    j = theta.join(lengths, "doc_id").filter((F.col("n_terms") >= min_terms) & (F.col("year") >= from_year))
    j = j.withColumn("theta", F.round("theta", 9))
    w = Window.partitionBy("k").orderBy(F.desc("theta"), "doc_id")
    j = j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return j.select(F.col("k").alias("theme"), "rank", "doc_id", "cls", "year", "theta")


def arrivals(pan: DataFrame, floor: float) -> DataFrame:
    """Cumulative (theme, class) arrivals against cumulative documents, with the
    slope of their logs."""
    first = pan.filter(F.col("share_tau") >= floor).groupBy("theme", "cls").agg(F.min("year").alias("year"))
    a = first.groupBy("year").agg(F.count(F.lit(1)).alias("n_new"))
    docs = pan.select("cls", "year", "n_cy").distinct().groupBy("year").agg(F.sum("n_cy").alias("n_docs"))
    w = Window.partitionBy(F.lit(0)).orderBy("year").rowsBetween(Window.unboundedPreceding, 0)  # a row per year
    j = docs.join(a, "year", "left").select(
        "year",
        F.sum(F.coalesce("n_new", F.lit(0))).over(w).alias("cum_themes"), F.sum("n_docs").over(w).alias("cum_docs"),
    )
    slope = j.filter(F.col("cum_themes") > 0).agg(F.regr_slope(F.log("cum_themes"), F.log("cum_docs"))).scalar()
    return j.withColumn("heaps", slope)


def transit(pan: DataFrame, floor: float) -> DataFrame:
    """First year above the floor and peak per class, lag behind the origin class."""
    t = pan.groupBy("theme", "cls").agg(
        F.min(F.when(F.col("share_tau") >= floor, F.col("year"))).alias("first_year"), F.max("share_tau").alias("peak")
    ).filter(F.col("first_year").isNotNull())
    origin = t.groupBy("theme").agg(F.min(F.struct("first_year", "cls")).alias("_o"))
    return t.join(origin, "theme").select(
        "theme", "cls", "first_year", "peak", F.col("_o.cls").alias("origin"), (F.col("first_year") - F.col("_o.first_year")).alias("lag")
    )


def breadth(tr: DataFrame) -> DataFrame:
    """Origin -> later class flows over all themes, with the mean lag."""
    later = tr.filter(F.col("cls") != F.col("origin"))
    return later.groupBy("origin", F.col("cls").alias("reached")).agg(
        F.count(F.lit(1)).alias("n_themes"), F.avg("lag").alias("mean_lag")
    )


BASS_LOW, BASS_HIGH, BASS_GRID, BASS_ROUNDS = -5.0, (0.0, math.log10(5.0)), 25, 5  # powers of ten of p and q


def bass_fits(series: DataFrame, min_years: int = 5, r2_floor: float = 0.7) -> DataFrame:
    """Bass curve per theme and class: (p, q, R2) on the normalised cumulative share.

    The error of every point of a log-spaced grid of p and q is a fold over the series, which has
    a value a year; each of five rounds narrows the grid to two steps around the best
    point, the first one of equally good ones (to twelve digits).
    """
    upto = Window.partitionBy("theme", "cls").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    rows = series.select("theme", "cls", "year", F.sum(F.col("value").cast("double")).over(upto).alias("_c"))
    s = rows.groupBy("theme", "cls").agg(
        F.array_sort(F.collect_list(F.struct(F.col("year").cast("double").alias("year"), F.col("_c").alias("c")))).alias("_s")
    )
    s = s.filter((F.size("_s") >= min_years) & (F.element_at("_s", -1)["c"] > 0))
    point = lambda x: F.struct(
        (x["year"] - F.col("_s")[0]["year"]).alias("t"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x["c"] / F.element_at("_s", -1)["c"])).alias("y")
    )
    s = s.withColumn("_s", F.transform("_s", point))
    total = lambda f: F.aggregate("_s", F.lit(0.0), lambda a, x: a + f(x))
    s = s.withColumn("_mean", total(lambda x: x["y"]) / F.size("_s"))
    s = s.withColumn("_ss", total(lambda x: (x["y"] - F.col("_mean")) * (x["y"] - F.col("_mean"))) + 1e-12)
    s = s.select("*", *[F.lit(BASS_LOW).alias(f"_lo{i}") for i in (0, 1)], *[F.lit(BASS_HIGH[i]).alias(f"_hi{i}") for i in (0, 1)])
    steps = F.sequence(F.lit(0), F.lit(BASS_GRID - 1))
    for _ in range(BASS_ROUNDS):
        grid = s.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps))
        at = [F.col(f"_lo{n}") + F.col(c) * ((F.col(f"_hi{n}") - F.col(f"_lo{n}")) / (BASS_GRID - 1)) for n, c in ((0, "_i"), (1, "_j"))]
        grid = grid.select("*", at[0].alias("_gp"), at[1].alias("_gq")).select("*", F.pow(F.lit(10.0), "_gp").alias("_p"), F.pow(F.lit(10.0), "_gq").alias("_q"))

        def miss(x):
            e = F.exp(-(F.col("_p") + F.col("_q")) * x["t"])
            m = (1 - e) / (1 + F.col("_q") / F.col("_p") * e) - x["y"]
            return m * m

        grid = grid.withColumn("_sse", total(miss))
        key = F.struct(F.round("_sse", 12).alias("e"), "_i", "_j")
        keep = ["_s", "_mean", "_ss", "_lo0", "_lo1", "_hi0", "_hi1"]
        best = grid.groupBy("theme", "cls").agg(F.min_by(F.struct(*keep, "_gp", "_gq", "_p", "_q", "_sse"), key).alias("_b")).select("theme", "cls", "_b.*")
        half = [(F.col(f"_hi{n}") - F.col(f"_lo{n}")) / 12 for n in (0, 1)]
        s = best.select(
            "theme", "cls", "_s", "_mean", "_ss", "_p", "_q", "_sse",
            *[F.greatest(F.col(g) - half[n], F.lit(BASS_LOW)).alias(f"_lo{n}") for n, g in ((0, "_gp"), (1, "_gq"))],
            *[F.least(F.col(g) + half[n], F.lit(BASS_HIGH[n])).alias(f"_hi{n}") for n, g in ((0, "_gp"), (1, "_gq"))],
        )
        last, s = s, s.drop("_p", "_q", "_sse")
    fits = last.select("theme", "cls", F.col("_p").alias("p"), F.col("_q").alias("q"), (1 - F.col("_sse") / F.col("_ss")).alias("r2"))
    return fits.filter(F.col("r2") >= r2_floor)


def entrant_shares(carriers: DataFrame, first_years: DataFrame, k: int = 50) -> DataFrame:
    """Of a theme's first ``k`` carriers, the share whose owner was new, beside the
    rate of new owners among all documents of the same years.

    ``carriers``: (theme, doc_id, owner, filed, year); ``first_years``: (owner, y0).
    """
    w = Window.partitionBy("theme").orderBy("filed", "doc_id")
    early = carriers.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    j = early.join(first_years, "owner")
    return j.groupBy("theme").agg(
        F.count(F.lit(1)).alias("n"), share(F.col("y0") >= F.col("year") - 1).alias("new_share"), F.avg("base_rate").alias("base_rate")
    ).withColumn("excess", F.col("new_share") - F.col("base_rate"))


def inflow(pan: DataFrame, active: float) -> DataFrame:
    """Yearly change of a class's mean share and of its number of active themes."""
    g = pan.groupBy("cls", "year").agg(F.avg("share_tau").alias("mean_share"), F.count_if(F.col("share_tau") >= active).alias("n_active"))
    w = Window.partitionBy("cls").orderBy("year")
    return g.select(
        "cls", "year", (F.col("mean_share") - F.lag("mean_share").over(w)).alias("d_share"),
        (F.col("n_active") - F.lag("n_active").over(w)).alias("d_active"),
    ).filter(F.col("d_share").isNotNull())


def adjusted_rand(labels: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings from their contingency table."""
    cell = labels.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    rows, cols = cell.groupBy(a).agg(F.sum("_n").alias("_n")), cell.groupBy(b).agg(F.sum("_n").alias("_n"))
    s = cell.agg(pairs("_n").alias("ij"), F.sum("_n").alias("n"))
    s = s.withColumn("ra", rows.agg(pairs("_n")).scalar()).withColumn("cb", cols.agg(pairs("_n")).scalar())
    expected = F.col("ra") * F.col("cb") / (F.col("n") * (F.col("n") - 1) / 2)
    top, bottom = F.col("ij") - expected, (F.col("ra") + F.col("cb")) / 2 - expected
    return s.select(F.col("n").cast("long").alias("n"), F.coalesce(ratio(top, bottom), F.lit(1.0)).alias("ari"))


def word_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Jaccard of the word lists of every overlapping topic pair: (topic, word) x 2."""
    na, nb = (x.groupBy("topic").agg(F.count(F.lit(1)).alias("n")) for x in (a, b))
    c = a.select(F.col("topic").alias("a"), "word").join(b.select(F.col("topic").alias("b"), "word"), "word")
    c = c.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    j = c.join(na.toDF("a", "_na"), "a").join(nb.toDF("b", "_nb"), "b")
    return j.select("a", "b", "common", (F.col("common") / (F.col("_na") + F.col("_nb") - F.col("common"))).alias("jaccard"))


def greedy_match(overlap: DataFrame) -> DataFrame:
    """One-to-one topic matching, best Jaccard first (topics x topics rows)."""
    used_a, used_b, out = set(), set(), []
    for row in overlap.orderBy(F.desc("jaccard"), "a", "b").collect():
        if row["a"] not in used_a and row["b"] not in used_b:
            used_a.add(row["a"])
            used_b.add(row["b"])
            out.append((int(row["a"]), int(row["b"]), float(row["jaccard"])))
    return overlap.sparkSession.createDataFrame(out, "a int, b int, jaccard double")


def seed_topics(words: DataFrame, seeds: Sequence[str]) -> DataFrame:
    """Topic whose top words contain each seed most often (ties to the lower topic)."""
    hits = F.array_compact(F.array(*[F.when(F.contains(F.col("word"), F.lit(s)), F.lit(s)) for s in seeds]))
    m = words.select("topic", F.explode(hits).alias("seed")).groupBy("seed", "topic").agg(F.count(F.lit(1)).alias("n"))
    best = m.groupBy("seed").agg(F.min(F.struct((-F.col("n")).alias("m"), "topic")).alias("_b"))
    return best.select("seed", F.col("_b.topic").alias("topic"), (-F.col("_b.m")).alias("matches"))
