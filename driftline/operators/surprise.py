"""Surprise of a document against what its class wrote before and after it.

All scores are ``KL(P || Q) = sum p ln p - sum p ln q``.  P is the document's
term distribution over the vocabulary, Q the smoothed reference
``(tf + alpha) / (total + alpha * V)``.  The factored form needs per document
only sums of ``cnt * ln(...)``, so scoring is: one pre-aggregation of terms to
(class, term, period), a window over those few periods, one equi-join back and
one aggregation per document.  No dense vector is ever built.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import DAYS_PER_YEAR, ratio
from ..sources.staging import drop_shuffles

SIDES = ("past", "future")
Stage = Callable[[DataFrame, str], DataFrame]


class Bounds(NamedTuple):
    """Document frequencies between which a term is in the vocabulary: a count and a share."""

    min_df: int = 5
    max_df: float = 0.5


def with_text(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("year").isNotNull() & (F.length("body") > 0))


def period_totals(docs: DataFrame, doc_terms: DataFrame, period: str = "year"):
    """(class, period, term) sums and (class, period) document counts."""
    tf = doc_terms.groupBy("cls", period, "term").agg(F.sum("cnt").alias("tf"))
    n = docs.groupBy("cls", period).agg(F.count(F.lit(1)).alias("n_docs"))
    return tf, n


def vocabulary_size(vocab: DataFrame) -> DataFrame:
    return vocab.groupBy("cls").agg(F.count(F.lit(1)).alias("v_size"))


def _doc_sums(scored: DataFrame, logs: dict[str, Column], key: str = "doc_id", extra: Sequence[Column] = ()) -> DataFrame:
    cnt = F.col("cnt")
    return scored.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_terms"),
        F.sum("cnt").alias("_t"),
        F.sum(cnt * F.log(cnt)).alias("_self"),
        *[F.sum(cnt * log).alias(f"_{s}") for s, log in logs.items()],
        *extra,
    )


def _divergence(side: str, total: Column) -> Column:
    t = F.col("_t")
    return (F.col("_self") - F.col(f"_{side}")) / t - F.log(t) + F.log(total)


def window_references(
    docs: DataFrame,
    doc_terms: DataFrame,
    vocab: DataFrame,
    spans: dict[str, tuple[int, int]],
    period: str = "year",
):
    """Reference counts per (class, term, period) and totals per (class, period).

    ``spans`` names each reference and gives its range of relative periods, so
    any number of references share one pass over the terms.  The windows see at
    most one row per period.
    """
    tf, n = period_totals(docs, doc_terms, period)
    tf = tf.join(vocab.select("cls", "term"), ["cls", "term"], "left_semi")
    by_term = Window.partitionBy("cls", "term").orderBy(period)
    by_cls = Window.partitionBy("cls").orderBy(period)

    def over(column: str, w, span, out: str) -> Column:
        return F.coalesce(F.sum(column).over(w.rangeBetween(*span)), F.lit(0)).alias(out)

    refs = tf.select(
        "cls", "term", period, *[over("tf", by_term, sp, f"tf_{s}") for s, sp in spans.items()]
    )
    mass = tf.groupBy("cls", period).agg(F.sum("tf").alias("_m"))
    totals = n.join(mass, ["cls", period], "left").join(vocabulary_size(vocab), "cls", "left")
    totals = totals.select(
        "cls", period, "v_size",
        *[over("n_docs", by_cls, sp, f"n_{s}") for s, sp in spans.items()],
        *[over("_m", by_cls, sp, f"total_{s}") for s, sp in spans.items()],
    )
    return refs, totals


def span_scores(
    docs: DataFrame,
    doc_terms: DataFrame,
    vocab: DataFrame,
    spans: dict[str, tuple[int, int]],
    period: str = "year",
    alpha: float = 1.0,
) -> DataFrame:
    """``kl_<span>`` and ``n_<span>`` for every span; a span without any document
    scores NULL, and documents without a vocabulary term have ``n_terms = 0``."""
    docs = with_text(docs)
    refs, totals = window_references(docs, doc_terms, vocab, spans, period)
    logs = {s: F.log(F.col(f"tf_{s}") + alpha) for s in spans}
    sums = _doc_sums(doc_terms.join(refs, ["cls", "term", period]), logs)
    return _span_columns(docs, sums, totals, spans, period, alpha)


def _span_columns(docs: DataFrame, sums: DataFrame, totals: DataFrame, spans, period: str, alpha: float) -> DataFrame:
    out = docs.drop("body").join(sums, "doc_id", "left").join(totals, ["cls", period], "left")
    keep = [c for c in docs.columns if c != "body"]
    scored = F.col("n_terms") > 0
    cols = []
    for s in spans:
        total = F.col(f"total_{s}") + alpha * F.col("v_size")
        cols += [
            F.when(F.col(f"n_{s}") > 0, _divergence(s, total)).alias(f"kl_{s}"),
            F.when(scored, F.col(f"n_{s}")).otherwise(0).cast("long").alias(f"n_{s}"),
        ]
    tokens = F.coalesce("_t", F.lit(0)).alias("n_tokens")
    return out.select(*keep, F.coalesce("n_terms", F.lit(0)).alias("n_terms"), tokens, *cols)


def vocabulary_rows(n: DataFrame, doc_terms: DataFrame, sums: dict[str, Column], period: str, bounds: Bounds) -> DataFrame:
    """The rows of ``doc_terms`` whose term is in its class's vocabulary, with more columns: ``sums``,
    which are windows over :func:`_of_term`, and ``_first``, 1 in one row of each class and term.  ``n`` has
    the documents ``_n`` of each class (a row a class).

    Document frequencies and references are windows over the rows themselves, so the rows are dealt
    by term once, sorted once, and joined to nothing but a row a class.  ``doc_terms`` has one row a
    document and term.  Frames run from the start of a term, so that a frequent term's rows lie
    in Spark's own buffer, which can spill.
    """
    w = _of_term(period)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = doc_terms.withColumn("_h", F.xxhash64("cls", "term")).select(
        "*", F.count(F.lit(1)).over(whole).alias("_df"), (F.row_number().over(w) == 1).cast("int").alias("_first"),
        *[c.alias(name) for name, c in sums.items()],
    )
    return rows.join(F.broadcast(n), "cls").filter((F.col("_df") >= bounds.min_df) & (F.col("_df") <= F.col("_n") * bounds.max_df)).drop("_h", "_df", "_n")


def _class_sizes(docs: DataFrame) -> DataFrame:
    return docs.groupBy("cls").agg(F.count(F.lit(1)).alias("_n"))


def _of_term(*order: str | Column):
    # the hash comes first: comparing it settles nearly every comparison of the sort
    return Window.partitionBy("_h", "cls", "term").orderBy(*order)


def _span_sums(spans: dict[str, tuple[int, int]], period: str) -> dict[str, Column]:
    def upto(k: int) -> Column:
        return F.coalesce(F.sum("cnt").over(_of_term(period).rangeBetween(Window.unboundedPreceding, k)), F.lit(0))

    return {f"tf_{s}": upto(hi) - upto(lo - 1) for s, (lo, hi) in spans.items()}


def _span_totals(per: DataFrame, sizes: DataFrame, spans: dict[str, tuple[int, int]], period: str) -> DataFrame:
    """Totals per (class, period) from documents and term mass per (class, period)."""
    by_cls = Window.partitionBy("cls").orderBy(period)
    over = lambda c, sp, out: F.coalesce(F.sum(c).over(by_cls.rangeBetween(*sp)), F.lit(0)).alias(out)
    return per.join(sizes, "cls", "left").select(
        "cls", period, "v_size",
        *[over("n_docs", sp, f"n_{s}") for s, sp in spans.items()], *[over("_m", sp, f"total_{s}") for s, sp in spans.items()],
    )


def corpus_span_scores(
    docs: DataFrame, doc_terms: DataFrame, stage: Stage, spans: dict[str, tuple[int, int]], period: str = "year", alpha: float = 1.0,
    bounds: Bounds = Bounds(),
) -> DataFrame:
    """:func:`span_scores` with the vocabulary of the documents themselves, in one pass over the terms.

    ``doc_id`` is unique.  A document's sums hold its term mass and how many terms of the vocabulary
    are counted with it, which is all that the totals need; ``stage`` keeps them, a row a document.
    """
    rows = vocabulary_rows(_class_sizes(docs), doc_terms, _span_sums(spans, period), period, bounds)
    logs = {s: F.log(F.col(f"tf_{s}") + alpha) for s in spans}
    sums = stage(_doc_sums(rows, logs, extra=[F.sum("_first").alias("_new")]), "term-sums")
    docs = with_text(docs)
    seen = docs.select("doc_id", "cls", period).join(sums.select("doc_id", "_t", "_new"), "doc_id", "left")
    per = seen.groupBy("cls", period).agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("_t"), F.lit(0)).alias("_m"))
    totals = _span_totals(per, seen.groupBy("cls").agg(F.sum("_new").alias("v_size")), spans, period)
    return _span_columns(docs, sums.drop("_new"), totals, spans, period, alpha)


def year_window(
    docs: DataFrame,
    doc_terms: DataFrame,
    vocab: DataFrame,
    window: int = 5,
    alpha: float = 1.0,
) -> DataFrame:
    """Scores against the ``window`` calendar years before and after."""
    spans = {"past": (-window, -1), "future": (1, window)}
    return span_scores(docs, doc_terms, vocab, spans, "year", alpha).drop("n_tokens")


def term_contributions(
    docs: DataFrame, doc_terms: DataFrame, vocab: DataFrame, window: int = 5, alpha: float = 1.0
) -> DataFrame:
    """Per (document, term) share of both scores, before summing over terms."""
    docs = with_text(docs)
    spans = {"past": (-window, -1), "future": (1, window)}
    refs, totals = window_references(docs, doc_terms, vocab, spans)
    joined = doc_terms.join(refs, ["cls", "term", "year"])
    size = F.sum("cnt").over(Window.partitionBy("doc_id"))
    return _contributions(joined.withColumn("_p", F.col("cnt") / size).join(totals, ["cls", "year"]), alpha)


def corpus_term_contributions(
    docs: DataFrame, doc_terms: DataFrame, stage: Stage, window: int = 5, alpha: float = 1.0, bounds: Bounds = Bounds()
) -> DataFrame:
    """:func:`term_contributions` with the vocabulary of the documents themselves: ``stage`` keeps the
    rows of the vocabulary with their references, which then go to their documents once."""
    spans = {"past": (-window, -1), "future": (1, window)}
    rows = vocabulary_rows(_class_sizes(docs), doc_terms, _span_sums(spans, "year"), "year", bounds)
    rows = stage(rows.select("doc_id", "cls", "year", "term", "cnt", "tf_past", "tf_future", "_first"), "vocabulary-rows")
    drop_shuffles(rows)
    mass = rows.groupBy("cls", "year").agg(F.sum("cnt").alias("_m"))
    per = with_text(docs).groupBy("cls", "year").agg(F.count(F.lit(1)).alias("n_docs")).join(mass, ["cls", "year"], "left")
    totals = _span_totals(per, rows.groupBy("cls").agg(F.sum("_first").alias("v_size")), spans, "year")
    size = F.sum("cnt").over(Window.partitionBy("doc_id"))
    # the totals, a row a class and year, come after the rows have moved
    rows = rows.drop("_first").withColumn("_p", F.col("cnt") / size).join(F.broadcast(totals), ["cls", "year"])
    return _contributions(rows, alpha)


def _contributions(joined: DataFrame, alpha: float) -> DataFrame:
    cols = []
    for s in SIDES:
        q = (F.col(f"tf_{s}") + alpha) / (F.col(f"total_{s}") + alpha * F.col("v_size"))
        part = F.col("_p") * (F.log("_p") - F.log(q))
        cols.append(F.when(F.col(f"n_{s}") > 0, part).alias(f"part_{s}"))
    return joined.select("doc_id", "cls", "year", "term", "cnt", *cols)


def top_contributions(parts: DataFrame, k: int = 5, places: int = 9) -> DataFrame:
    """Largest ``k`` contributions per document and side, ties by term."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.round(f"part_{s}", places).alias("part")) for s in SIDES])
    w = Window.partitionBy("doc_id", "side").orderBy(F.col("part").desc(), "term")
    rows = parts.select("doc_id", "term", F.inline(sides)).filter(F.col("part").isNotNull())
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("doc_id", "side", "rank", "term", "part")


def _decay_sums(
    df: DataFrame, over: Sequence[str], value: str, rate: float, side: str
) -> Column:
    """Decayed sum of strictly earlier (later) days by a prefix sum.

    ``sum x e^(-rate (d - t)) = e^(-rate d) * sum x e^(rate t)``; the future side
    runs over descending days so that the frame stays a cheap running one.
    """
    t = F.col("_t_years")
    sign = 1.0 if side == "past" else -1.0
    w = Window.partitionBy(*over).orderBy(F.col("day") if side == "past" else F.col("day").desc())
    w = w.rowsBetween(Window.unboundedPreceding, -1)
    grown = F.sum(F.col(value) * F.exp(F.lit(sign * rate) * t)).over(w)
    return F.coalesce(grown * F.exp(F.lit(-sign * rate) * t), F.lit(0.0))


BLOCK = 300.0  # exponents stay far from the double range


def _with_decay_sums(
    df: DataFrame, over: Sequence[str], items: Sequence[tuple[str, str, float, str]], span_years: float
) -> DataFrame:
    """Adds ``(out, value, rate, side)`` decayed sums.

    One prefix sum is enough while the weights over the whole span fit a double.  With a
    shorter half-life time is cut into blocks of weight ``e^-BLOCK``: prefix sums run inside
    a block, and the totals of the two blocks before (after) it are carried in by a join.
    What lies further back weighs less than ``e^-600`` and counts as nothing.
    """
    for out, value, rate, side in items:
        if rate * span_years <= BLOCK:
            df = df.withColumn(out, _decay_sums(df, over, value, rate, side))
            continue
        sign = 1.0 if side == "past" else -1.0
        place = F.col("_t_years") * rate
        df = df.withColumn("_block", F.floor(place / BLOCK)).withColumn("_at", place - F.col("_block") * BLOCK)
        df = df.withColumn("_grown", F.col(value) * F.exp(F.lit(sign) * F.col("_at")))
        w = Window.partitionBy(*over, "_block").orderBy(F.col("day") if side == "past" else F.col("day").desc())
        inner = F.coalesce(F.sum("_grown").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        df = df.withColumn("_inner", inner)
        totals = df.groupBy(*over, "_block").agg(F.sum("_grown").alias("_whole"))
        for step in (1, 2):
            moved = totals.withColumn("_block", F.col("_block") + int(sign) * step).withColumnRenamed("_whole", f"_c{step}")
            df = df.join(moved, [*over, "_block"], "left")
        carried = sum(F.coalesce(f"_c{s}", F.lit(0.0)) * math.exp(-BLOCK * s) for s in (1, 2))
        df = df.withColumn(out, (F.col("_inner") + carried) * F.exp(F.lit(-sign) * F.col("_at")))
        df = df.drop("_block", "_at", "_grown", "_inner", "_c1", "_c2")
    return df


def decay(
    docs: DataFrame,
    doc_terms: DataFrame,
    vocab: DataFrame,
    halflife_past: float = 2.0,
    halflife_future: float = 2.0,
    alpha: float = 1.0,
) -> DataFrame:
    """Scores against an exponentially decayed reference, weight 2^(-age/H).

    Documents of the same day are in neither reference.  Also returns the Kish
    effective size ``(sum w)^2 / sum w^2`` of each reference.
    """
    docs = with_text(docs).withColumn("day", F.unix_date("filed"))
    terms = doc_terms.withColumn("day", F.unix_date("filed"))
    terms = terms.join(vocab.select("cls", "term"), ["cls", "term"], "left_semi")
    origin = docs.groupBy("cls").agg(F.min("day").alias("_d0"))
    rates = {"past": math.log(2) / halflife_past, "future": math.log(2) / halflife_future}
    first, last = docs.agg(F.min("day"), F.max("day")).first()
    span = (last - first) / DAYS_PER_YEAR if last is not None else 0.0

    tf, n = period_totals(docs, terms, "day")
    tf = tf.join(origin, "cls").withColumn(
        "_t_years", (F.col("day") - F.col("_d0")) / F.lit(DAYS_PER_YEAR)
    )
    refs = _with_decay_sums(tf, ["cls", "term"], [(f"tf_{s}", "tf", rates[s], s) for s in SIDES], span)
    refs = refs.select("cls", "term", "day", *[f"tf_{s}" for s in SIDES])
    mass = tf.groupBy("cls", "day").agg(F.sum("tf").alias("_m"))
    logs = {s: F.log(F.col(f"tf_{s}") + alpha) for s in SIDES}
    sums = _doc_sums(terms.join(refs, ["cls", "term", "day"]), logs)
    return _decay_columns(docs, sums, n.join(mass, ["cls", "day"], "left"), vocabulary_size(vocab), origin, rates, span, alpha)


def _decay_columns(
    docs: DataFrame, sums: DataFrame, per: DataFrame, sizes: DataFrame, origin: DataFrame, rates: dict[str, float], span: float, alpha: float
) -> DataFrame:
    days = (
        per.join(origin, "cls")
        .join(sizes, "cls", "left")
        .withColumn("_t_years", (F.col("day") - F.col("_d0")) / F.lit(DAYS_PER_YEAR))
        .withColumn("_m", F.coalesce("_m", F.lit(0)))
    )
    cols = ["cls", "day", "v_size"]
    for s in SIDES:
        items = [(f"total_{s}", "_m", rates[s], s), (f"w_{s}", "n_docs", rates[s], s), (f"w2_{s}", "n_docs", 2 * rates[s], s)]
        days = _with_decay_sums(days, ["cls"], items, span)
        cols += [f"total_{s}", f"w_{s}", f"w2_{s}"]
    out = docs.drop("body").join(sums, "doc_id", "left")
    out = out.join(days.select(*cols), ["cls", "day"], "left")
    for s in SIDES:
        total = F.col(f"total_{s}") + alpha * F.col("v_size")
        ok = (F.col(f"w_{s}") > 0) & (F.col("n_terms") > 0)
        out = out.withColumn(f"kl_{s}", F.when(ok, _divergence(s, total))).withColumn(
            f"n_eff_{s}", F.when(ok, ratio(F.pow(f"w_{s}", F.lit(2)), F.col(f"w2_{s}")))
        )
    keep = [c for c in docs.columns if c not in ("body", "day")]
    return out.withColumn("n_terms", F.coalesce("n_terms", F.lit(0))).select(
        *keep, "n_terms", "kl_past", "n_eff_past", "kl_future", "n_eff_future"
    )


def corpus_decay(
    docs: DataFrame, doc_terms: DataFrame, stage: Stage, halflives: Sequence[float], alpha: float = 1.0, bounds: Bounds = Bounds()
) -> list[DataFrame] | None:
    """:func:`decay` with the vocabulary of the documents themselves, one table a half-life, all
    in one pass over the terms.  None if the weights over the whole span leave the double range."""
    sizes_of, docs = _class_sizes(docs), with_text(docs).withColumn("day", F.unix_date("filed"))
    first, last = docs.agg(F.min("day"), F.max("day")).first()
    span = (last - first) / DAYS_PER_YEAR if last is not None else 0.0
    rates = [math.log(2) / h for h in halflives]
    if max(rates) * span > BLOCK:
        return None
    origin = docs.groupBy("cls").agg(F.min("day").alias("_d0"))
    t = F.col("_t_years")
    columns, logs = {}, {}
    for i, rate in enumerate(rates):
        for s, sign, order in (("past", 1.0, F.col("day")), ("future", -1.0, F.col("day").desc())):
            before = _of_term(order).rangeBetween(Window.unboundedPreceding, -1)
            grown = F.sum(F.col("cnt") * F.exp(F.lit(sign * rate) * t)).over(before)
            columns[f"tf_{s}{i}"] = F.coalesce(grown * F.exp(F.lit(-sign * rate) * t), F.lit(0.0))
            logs[f"{s}{i}"] = F.log(F.col(f"tf_{s}{i}") + alpha)
    terms = doc_terms.withColumn("day", F.unix_date("filed")).join(F.broadcast(origin), "cls")  # a row a class
    terms = terms.withColumn("_t_years", (F.col("day") - F.col("_d0")) / F.lit(DAYS_PER_YEAR)).drop("_d0")
    rows = vocabulary_rows(sizes_of, terms, columns, "day", bounds)
    sums = stage(_doc_sums(rows, logs, extra=[F.sum("_first").alias("_new")]), "term-sums")
    seen = docs.select("doc_id", "cls", "day").join(sums.select("doc_id", "_t", "_new"), "doc_id", "left")
    per = seen.groupBy("cls", "day").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("_t").alias("_m"))
    sizes = seen.groupBy("cls").agg(F.sum("_new").alias("v_size"))
    out = []
    for i, rate in enumerate(rates):
        own = sums.select("doc_id", "n_terms", "_t", "_self", *[F.col(f"_{s}{i}").alias(f"_{s}") for s in SIDES])
        out.append(_decay_columns(docs, own, per, sizes, origin, {s: rate for s in SIDES}, span, alpha))
    return out


def monthly_freshness(
    docs: DataFrame,
    doc_terms: DataFrame,
    vocab: DataFrame,
    near: tuple[int, int] = (-12, -1),
    far: tuple[int, int] = (-24, -13),
    alpha: float = 1.0,
    min_tokens: int = 3,
) -> DataFrame:
    """Past surprise against a near and a far month window; freshness = far - near.

    Scored from ``-far[0]`` months after the class's first month on.
    """
    docs, terms, spans = _monthly(docs), _monthly(doc_terms), {"near": near, "far": far}
    return _freshness(docs, span_scores(docs, terms, vocab, spans, "month", alpha), far, min_tokens)


def corpus_monthly_freshness(
    docs: DataFrame, doc_terms: DataFrame, stage: Stage, near: tuple[int, int] = (-12, -1), far: tuple[int, int] = (-24, -13),
    alpha: float = 1.0, min_tokens: int = 3, bounds: Bounds = Bounds(),
) -> DataFrame:
    """:func:`monthly_freshness` with the vocabulary of the documents themselves."""
    docs, terms, spans = _monthly(docs), _monthly(doc_terms), {"near": near, "far": far}
    return _freshness(docs, corpus_span_scores(docs, terms, stage, spans, "month", alpha, bounds), far, min_tokens)


def _monthly(rows: DataFrame) -> DataFrame:
    return rows.withColumn("month", F.year("filed") * 12 + F.month("filed") - 1)


def _freshness(docs: DataFrame, out: DataFrame, far: tuple[int, int], min_tokens: int) -> DataFrame:
    first = with_text(docs).groupBy("cls").agg(F.min("month").alias("_first"))
    late = F.col("month") - F.col("_first") >= -far[0]
    out = out.join(first, "cls").filter((F.col("n_tokens") >= min_tokens) & late)
    return out.select(
        "doc_id",
        "cls",
        "n_terms",
        "kl_near",
        "kl_far",
        (F.col("kl_far") - F.col("kl_near")).alias("freshness"),
    )


def borrowed_novelty(
    docs: DataFrame, doc_terms: DataFrame, vocab: DataFrame, window: int = 5, alpha: float = 1.0
) -> DataFrame:
    """Past surprise within the class and across all classes in one vocabulary.

    ``vocab`` is class-free.  A side whose window has no term mass is NULL.
    """
    docs = with_text(docs)
    tf = doc_terms.join(vocab.select("term"), "term", "left_semi")
    tf = tf.groupBy("cls", "term", "year").agg(F.sum("cnt").alias("tf"))
    pooled = tf.groupBy("term", "year").agg(F.sum("tf").alias("tf"))
    frame = lambda keys: Window.partitionBy(*keys).orderBy("year").rangeBetween(-window, -1)
    zero = F.lit(0)
    own = tf.select(
        "cls", "term", "year",
        F.coalesce(F.sum("tf").over(frame(["cls", "term"])), zero).alias("tf_within"),
    )
    cross = pooled.select(
        "term", "year",
        F.coalesce(F.sum("tf").over(frame(["term"])), zero).alias("tf_cross"),
    )
    refs = own.join(cross, ["term", "year"])
    by_year = pooled.groupBy("year").agg(F.sum("tf").alias("_m"))
    by_year = by_year.select(
        "year", F.sum("_m").over(Window.partitionBy(F.lit(0)).orderBy("year")
                                .rangeBetween(-window, -1)).alias("total_cross"),
    )
    by_cls = tf.groupBy("cls", "year").agg(F.sum("tf").alias("_m"))
    by_cls = by_cls.select("cls", "year", F.sum("_m").over(frame(["cls"])).alias("total_within"))
    logs = {s: F.log(F.col(f"tf_{s}") + alpha) for s in ("within", "cross")}
    sums = _doc_sums(doc_terms.join(refs, ["cls", "term", "year"]), logs)
    return _borrowed_columns(docs.drop("body").join(sums, "doc_id"), by_cls, by_year, vocab.agg(F.count(F.lit(1))).scalar(), alpha)


def _borrowed_columns(out: DataFrame, by_cls: DataFrame, by_year: DataFrame, size: Column, alpha: float) -> DataFrame:
    out = out.join(by_cls, ["cls", "year"], "left").join(by_year, "year", "left").withColumn("v_size", size)
    for s in ("within", "cross"):
        total = F.col(f"total_{s}") + alpha * F.col("v_size")
        out = out.withColumn(
            f"kl_{s}", F.when(F.col(f"total_{s}") > 0, _divergence(s, total))
        )
    return out.select(
        "doc_id", "cls", "year", "owner", "n_terms", "kl_within", "kl_cross",
        (F.col("kl_within") - F.col("kl_cross")).alias("gap"),
    )


def corpus_borrowed_novelty(
    docs: DataFrame, doc_terms: DataFrame, stage: Stage, window: int = 5, alpha: float = 1.0, bounds: Bounds = Bounds()
) -> DataFrame:
    """:func:`borrowed_novelty` with the vocabulary of all documents, in one pass over the terms."""
    n, docs = docs.agg(F.count(F.lit(1)).alias("_n")), with_text(docs)

    def before(*keys: str) -> Column:
        w = Window.partitionBy("_h", "term", *keys).orderBy("year")
        upto = lambda k: F.coalesce(F.sum("cnt").over(w.rangeBetween(Window.unboundedPreceding, k)), F.lit(0))
        return upto(-1) - upto(-window - 1)

    w = Window.partitionBy("_h", "term").orderBy("year")
    df = F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = doc_terms.withColumn("_h", F.xxhash64("term")).select(
        "*", df.alias("_df"), (F.row_number().over(w) == 1).cast("int").alias("_first"), before().alias("tf_cross")
    )
    kept = rows.crossJoin(F.broadcast(n)).filter((F.col("_df") >= bounds.min_df) & (F.col("_df") <= F.col("_n") * bounds.max_df))  # one row
    kept = kept.withColumn("tf_within", before("cls"))
    logs = {s: F.log(F.col(f"tf_{s}") + alpha) for s in ("within", "cross")}
    sums = stage(_doc_sums(kept, logs, extra=[F.sum("_first").alias("_new")]), "term-sums")
    found = docs.drop("body").join(sums, "doc_id")
    mass = found.groupBy("cls", "year").agg(F.sum("_t").alias("_m"))
    frame = lambda *keys: Window.partitionBy(*keys).orderBy("year").rangeBetween(-window, -1)
    by_cls = mass.select("cls", "year", F.sum("_m").over(frame("cls")).alias("total_within"))
    # a row a year
    by_year = mass.groupBy("year").agg(F.sum("_m").alias("_m")).select("year", F.sum("_m").over(frame(F.lit(0))).alias("total_cross"))
    return _borrowed_columns(found.drop("_new"), by_cls, by_year, sums.agg(F.sum("_new")).scalar(), alpha)


def axes(scores: DataFrame, past: str = "kl_past", future: str = "kl_future") -> DataFrame:
    """Level (mean of both sides), lead (past minus future) and its magnitude."""
    p, f = F.col(past), F.col(future)
    return (
        scores.withColumn("level", (p + f) / 2)
        .withColumn("lead", p - f)
        .withColumn("abs_lead", F.abs(p - f))
    )


def clean(
    scores: DataFrame, min_past: int = 1000, min_future: int = 1000, min_terms: int = 3
) -> DataFrame:
    """Rows with two thick references, enough terms and both scores."""
    return scores.filter(clean_condition(min_past, min_future, min_terms))


def clean_clauses(min_past: int, min_future: int, min_terms: int) -> dict[str, Column]:
    return {
        "past": F.col("n_past") >= min_past,
        "future": F.col("n_future") >= min_future,
        "terms": F.col("n_terms") >= min_terms,
        "scored": F.col("kl_past").isNotNull() & F.col("kl_future").isNotNull(),
    }


def clean_condition(min_past: int = 1000, min_future: int = 1000, min_terms: int = 3) -> Column:
    cond = F.lit(True)
    for c in clean_clauses(min_past, min_future, min_terms).values():
        cond = cond & c
    return cond


def clean_audit(scores: DataFrame, min_past: int, min_future: int, min_terms: int) -> DataFrame:
    """Rows kept by each clause alone, cumulatively and with it left out."""
    clauses = clean_clauses(min_past, min_future, min_terms)
    names = list(clauses)
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for i, name in enumerate(names):
        together, without = F.lit(True), F.lit(True)
        for j, other in enumerate(names):
            together = together & clauses[other] if j <= i else together
            without = without & clauses[other] if j != i else without
        aggs += [
            F.count_if(clauses[name]).alias(f"{name}_alone"),
            F.count_if(together).alias(f"{name}_cumulative"),
            F.count_if(without).alias(f"{name}_left_out"),
        ]
    wide = scores.agg(*aggs)
    rows = ", ".join(
        f"'{n}', {n}_alone, {n}_cumulative, {n}_left_out" for n in names
    )
    return wide.selectExpr(
        "n_rows", f"stack({len(names)}, {rows}) as (clause, alone, cumulative, left_out)"
    )


def turnover(docs: DataFrame, doc_terms: DataFrame, window: int = 5) -> DataFrame:
    """Share of a class-year's term types unseen in the prior ``window`` years,
    and growth of volume over the mean of those years."""
    types = doc_terms.select("cls", "term", "year").distinct()
    w = Window.partitionBy("cls", "term").orderBy("year")
    prev = F.lag("year").over(w)
    fresh = prev.isNull() | (F.col("year") - prev > window)
    t = types.withColumn("_new", fresh).groupBy("cls", "year").agg(
        F.count(F.lit(1)).alias("n_types"), F.avg(F.col("_new").cast("double")).alias("turnover")
    )
    n = with_text(docs).groupBy("cls", "year").agg(F.count(F.lit(1)).alias("n_docs"))
    back = Window.partitionBy("cls").orderBy("year").rangeBetween(-window, -1)
    prior = F.coalesce(F.sum("n_docs").over(back), F.lit(0))
    n = n.withColumn("growth", F.log1p("n_docs") - F.log1p(prior / F.lit(window)))
    return n.join(t, ["cls", "year"], "left")


def burnin_end(
    scores: DataFrame, stable: tuple[int, int], floor: float = 0.02, run: int = 3,
    min_docs: int = 200, min_stable: int = 6,
) -> DataFrame:
    """First year from which ``run`` consecutive yearly mean leads stay within
    ``max(floor, 3 sd)`` of the median of the stable years."""
    lead = F.col("kl_past") - F.col("kl_future")
    yearly = scores.groupBy("cls", "year").agg(
        F.count(F.lit(1)).alias("n"), F.avg(lead).alias("m")
    ).filter(F.col("n") >= min_docs)
    inside = F.when(F.col("year").between(*stable), F.col("m"))
    # one row per class and year: a class holds a few dozen rows at most
    band = yearly.groupBy("cls").agg(
        F.median(inside).alias("ref_level"),
        F.greatest(F.lit(floor), 3 * F.stddev_pop(inside)).alias("band"),
        F.count(inside).alias("_k"),
        F.min("year").alias("first_year"),
    ).filter(F.col("_k") >= min_stable)
    w = Window.partitionBy("cls").orderBy("year")
    ok = F.abs(F.col("m") - F.col("ref_level")) <= F.col("band")
    j = yearly.join(band, "cls").withColumn("_ok", ok)
    good = F.col("_ok")
    for k in range(1, run):
        good = good & F.coalesce(
            F.lead("_ok", k).over(w) & (F.lead("year", k).over(w) == F.col("year") + k),
            F.lit(False),
        )
    j = j.withColumn("_run", good)
    return j.groupBy("cls", "first_year", "ref_level", "band").agg(
        F.min(F.when(F.col("_run"), F.col("year"))).alias("burnin_end")
    )


def forward_coverage(counts: DataFrame, years: int = 5) -> DataFrame:
    """Observed share of each class-year's forward window, weighted by volume.

    ``counts``: (cls, year, n).  Years after the last complete one run at its
    rate; the last year is partial when it has under half of the year before.
    """
    edge = counts.groupBy("cls").agg(
        F.max("year").alias("_y1"), F.max_by("n", "year").alias("_n1")
    )
    before = counts.select("cls", (F.col("year") + 1).alias("_y1"), F.col("n").alias("_n0"))
    edge = edge.join(before, ["cls", "_y1"], "left")
    partial = F.col("_n1") < 0.5 * F.col("_n0")
    edge = edge.select(
        "cls",
        F.when(partial, F.col("_y1") - 1).otherwise(F.col("_y1")).alias("_last"),
        F.when(partial, F.col("_n0")).otherwise(F.col("_n1")).alias("_rate"),
    )
    ahead = counts.select("cls", "year", F.explode(F.sequence(F.lit(1), F.lit(years))).alias("_j"))
    seen = counts.select("cls", (F.col("year")).alias("_yj"), F.col("n").alias("_nj"))
    j = ahead.withColumn("_yj", F.col("year") + F.col("_j")).join(seen, ["cls", "_yj"], "left")
    j = j.join(edge, "cls")
    full = F.when(F.col("_yj") <= F.col("_last"), F.coalesce("_nj", F.col("_rate")))
    return j.groupBy("cls", "year").agg(
        (F.sum(F.coalesce("_nj", F.lit(0))) / F.sum(full.otherwise(F.col("_rate")))).alias(
            "coverage"
        )
    )


def novel_share(doc_terms: DataFrame, vocab: DataFrame, recent: int = 3) -> DataFrame:
    """Share of a document's term mass whose term first appeared in the class
    within the last ``recent`` years."""
    kept = doc_terms.join(vocab.select("cls", "term"), ["cls", "term"], "left_semi")
    first = kept.groupBy("cls", "term").agg(F.min("year").alias("_y0"))
    j = kept.join(first, ["cls", "term"])
    fresh = F.when(F.col("_y0") >= F.col("year") - recent, F.col("cnt")).otherwise(0)
    return j.groupBy("doc_id").agg(
        F.sum("cnt").alias("n_tokens"), (F.sum(fresh) / F.sum("cnt")).alias("novel_share")
    )
