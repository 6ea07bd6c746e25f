"""Topic-distribution scoring.

Scorers take one row per document with its distribution as an array,
``(doc_id, cls, filed, year, theta array<double>)``: the table that is shuffled has as
many rows as documents, whatever the number of topics.  Sums by topic are partial
aggregates of exploded arrays, so only (class, period, topic) totals leave a task.
``long`` gives the rows ``(doc_id, cls, filed, year, k, theta)`` that theme operators read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

EPS = 1e-12


def normalised(theta: DataFrame) -> DataFrame:
    """Clip and renormalise each document's distribution."""
    clipped = F.transform("theta", lambda x: F.greatest(x, F.lit(EPS)))
    theta = theta.withColumn("theta", clipped)
    total = F.aggregate("theta", F.lit(0.0), lambda a, x: a + x)
    return theta.withColumn("_z", total).withColumn("theta", F.transform("theta", lambda x: x / F.col("_z"))).drop("_z")


def long(theta: DataFrame) -> DataFrame:
    return theta.select("doc_id", "cls", "filed", "year", F.posexplode("theta").alias("k", "theta"))


def _score(theta: DataFrame, refs: DataFrame, on: list[str], sides: list[str]) -> DataFrame:
    """Join each period's reference array and sum p (ln p - ln q)."""
    p = F.col("theta")
    j = theta.join(refs, on)

    def divergence(s: str) -> Column:
        parts = F.zip_with(p, F.col(f"q_{s}"), lambda x, q: x * (F.log(x) - F.log(q)))
        return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)

    cols = [c for s in sides for c in (divergence(s).alias(f"kl_{s}"), F.col(f"n_{s}"))]
    return j.select("doc_id", "cls", "filed", "year", *cols)


def _references(sums: DataFrame, on: list[str]) -> DataFrame:
    """One row a period from ``(on, k, m_past, n_past, m_future, n_future)``: the clipped mean
    distribution of each side as an array, NULL where the side has no mean."""
    aggs = []
    for s in ("past", "future"):
        clipped = F.greatest(F.col(f"m_{s}"), F.lit(EPS))
        aggs += [
            F.array_sort(F.collect_list(F.when(F.col(f"m_{s}").isNotNull(), F.struct("k", clipped.alias("q"))))).alias(f"_q_{s}"),
            F.max(f"n_{s}").alias(f"n_{s}"),
        ]
    out = sums.groupBy(*on).agg(*aggs)
    for s in ("past", "future"):
        q = F.transform(f"_q_{s}", lambda x: x["q"])
        out = out.withColumn(f"_t_{s}", F.aggregate(q, F.lit(0.0), lambda a, x: a + x)).withColumn(
            f"q_{s}", F.when(F.size(f"_q_{s}") > 0, F.transform(q, lambda x: x / F.col(f"_t_{s}")))
        )
    return out.select(*on, "n_past", "n_future", "q_past", "q_future")


def year_scores(theta: DataFrame, window: int = 5) -> DataFrame:
    """Against the count-weighted mean of exactly ``window`` available years per side."""
    sums = long(theta).groupBy("cls", "year", "k").agg(F.sum("theta").alias("_s"), F.count("theta").alias("_n"))
    w = Window.partitionBy("cls", "k").orderBy("year")
    spans = {"past": w.rangeBetween(-window, -1), "future": w.rangeBetween(1, window)}
    refs = sums.select(
        "cls", "year", "k",
        *[F.sum("_s").over(x).alias(f"_s_{s}") for s, x in spans.items()],
        *[F.coalesce(F.sum("_n").over(x), F.lit(0)).alias(f"n_{s}") for s, x in spans.items()],
        *[F.count("_n").over(x).alias(f"_y_{s}") for s, x in spans.items()],
    )
    full = (F.col("_y_past") == window) & (F.col("_y_future") == window)
    means = [F.when(full, F.col(f"_s_{s}") / F.col(f"n_{s}")).alias(f"m_{s}") for s in spans]
    refs = _references(refs.select("cls", "year", "k", "n_past", "n_future", *means), ["cls", "year"])
    return _score(theta, refs, ["cls", "year"], ["past", "future"])


def rolling_scores(theta: DataFrame, days: int = 1826) -> DataFrame:
    """Against the mean of the ``days`` before and after each document's own date.

    Same-day documents are in neither window.  Theta is summed to (class, k,
    day), laid on a gap-free calendar and turned into running totals; a window
    sum is then the difference of two rows a fixed offset apart, so the cost does
    not grow with the width of the window.
    """
    t = theta.withColumn("day", F.unix_date("filed"))
    daily = t.select("cls", "day", F.posexplode("theta").alias("k", "theta")).groupBy("cls", "k", "day").agg(
        F.sum("theta").alias("_s"), F.count("theta").alias("_n")
    )
    span = daily.groupBy("cls", "k").agg(F.min("day").alias("_a"), F.max("day").alias("_b"))
    calendar = span.select("cls", "k", F.explode(F.sequence("_a", "_b")).alias("day"))
    dense = calendar.join(daily, ["cls", "k", "day"], "left")
    w = Window.partitionBy("cls", "k").orderBy("day")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    for c in ("_s", "_n"):
        dense = dense.withColumn(f"{c}c", F.sum(F.coalesce(c, F.lit(0))).over(run))
    last = dense.groupBy("cls", "k").agg(F.max_by("_sc", "day").alias("_sl"), F.max("_nc").alias("_nl"))
    dense = dense.join(last, ["cls", "k"])

    def before(c: str, offset: int) -> Column:
        return F.coalesce(F.lag(c, offset).over(w), F.lit(0))

    def after(c: str, end: str) -> Column:
        return F.coalesce(F.lead(c, days).over(w), F.col(end))

    refs = dense.select(
        "cls", "k", "day", F.col("_n").alias("_seen"),
        (before("_sc", 1) - before("_sc", days + 1)).alias("_s_past"),
        (before("_nc", 1) - before("_nc", days + 1)).alias("n_past"),
        (after("_sc", "_sl") - F.col("_sc")).alias("_s_future"),
        (after("_nc", "_nl") - F.col("_nc")).alias("n_future"),
    ).filter(F.col("_seen").isNotNull())
    means = [F.when(F.col(f"n_{s}") > 0, F.col(f"_s_{s}") / F.col(f"n_{s}")).alias(f"m_{s}") for s in ("past", "future")]
    refs = _references(refs.select("cls", "k", "day", "n_past", "n_future", *means), ["cls", "day"])
    return _score(t, refs, ["cls", "day"], ["past", "future"])


def quality_mask(
    scores: DataFrame, days: int = 1826, min_ref: int = 500, years: tuple[int, int] = (1995, 2019)
) -> DataFrame:
    """Null both scores on thin references, windows leaving the class's own date
    span, or years out of range; rows stay."""
    span = scores.groupBy("cls").agg(F.min("filed").alias("_a"), F.max("filed").alias("_b"))
    ok = (
        (F.col("n_past") >= min_ref)
        & (F.col("n_future") >= min_ref)
        & (F.date_sub("filed", days) >= F.col("_a"))
        & (F.date_add("filed", days) <= F.col("_b"))
        & F.col("year").between(*years)
    )
    out = scores.join(span, "cls").withColumn("scored", ok)
    for s in ("past", "future"):
        out = out.withColumn(f"kl_{s}", F.when(ok, F.col(f"kl_{s}")))
    return out.drop("_a", "_b")


def top_topic(theta: DataFrame) -> DataFrame:
    """Heaviest topic per document, the lower index on ties."""
    best = F.max(F.struct("theta", (-F.col("k")).alias("nk"))).alias("_b")
    out = theta.groupBy("doc_id", "cls", "filed", "year").agg(best)
    return out.select(
        "doc_id", "cls", "filed", "year",
        (-F.col("_b.nk")).alias("top_topic"), F.col("_b.theta").alias("top_weight"),
    )
