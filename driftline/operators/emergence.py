"""How new terms arrive, spread and pay off."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as tx
from ..functions.scalars import ladder, ratio, share
from . import ranking


def overlap_counts(df: DataFrame, member: str, pool: str) -> DataFrame:
    """Shared members of every pair of pools.

    Pools are few labels: each member carries the array of its pools and emits
    pairs of labels, so no member group is joined with itself.
    """
    pools = df.groupBy(member).agg(F.array_sort(F.collect_set(pool)).alias("_p"))
    pairs = F.flatten(
        F.transform(
            "_p",
            lambda a: F.transform(
                F.filter("_p", lambda z: z > a), lambda z: F.struct(a.alias("a"), z.alias("b"))
            ),
        )
    )
    out = pools.select(F.explode(pairs).alias("_x")).groupBy("_x.a", "_x.b")
    return out.agg(F.count(F.lit(1)).alias("n_shared"))


def new_terms(
    counts: DataFrame, burn: tuple[int, int], study: tuple[int, int], min_uses: int = 200,
    min_years: int = 5, horizon: int = 10, origin_years: int = 2,
) -> DataFrame:
    """Terms absent from the burn-in years and used enough in the study years.

    ``counts``: (cls, year, term, n).  Gives first year, class of origin (most
    uses in the first years), origin uses in five years, uses in y1..y<horizon>,
    and total and HHI of the other classes.
    """
    y, n = F.col("year"), F.col("n")
    in_study = y.between(*study)
    flat = counts.filter(y.between(*burn) | in_study)
    terms = flat.groupBy("term").agg(
        F.sum(F.when(y.between(*burn), n).otherwise(0)).alias("_burn"),
        F.sum(F.when(in_study, n).otherwise(0)).alias("total"),
        F.countDistinct(F.when(in_study, y)).alias("n_years"),
        F.min(F.when(in_study, y)).alias("first_year"),
    )
    terms = terms.filter(
        (F.col("_burn") == 0) & (F.col("total") >= min_uses) & (F.col("n_years") >= min_years)
    )
    used = counts.filter(in_study).join(terms.select("term", "first_year"), "term")
    age = y - F.col("first_year")
    # one row per (term, class): every later figure is a sum over these
    cells = used.groupBy("term", "cls").agg(
        F.sum(F.when(age < origin_years, n).otherwise(0)).alias("_early"),
        F.sum(F.when(age < 5, n).otherwise(0)).alias("_five"),
        F.sum("n").alias("_all"),
        *[F.sum(F.when(age == i, n).otherwise(0)).alias(f"_y{i + 1}") for i in range(horizon)],
    )
    origin = cells.filter(F.col("_early") > 0).groupBy("term").agg(
        F.min(F.struct((-F.col("_early")).alias("m"), F.col("cls").alias("c"))).alias("_o")
    ).select("term", F.col("_o.c").alias("origin"))
    j = cells.join(origin, "term")
    home = F.col("cls") == F.col("origin")
    other = F.when(~home, F.col("_all")).otherwise(0)
    out = j.groupBy("term", "origin").agg(
        F.sum(F.when(home, F.col("_five")).otherwise(0)).alias("origin_5y"),
        *[F.sum(f"_y{i + 1}").alias(f"y{i + 1}") for i in range(horizon)],
        F.sum(other).alias("other_total"),
        F.sum(other.cast("double") * other).alias("_sq"),
    )
    hhi = F.coalesce(
        ratio(F.col("_sq"), F.col("other_total") * F.col("other_total")), F.lit(0.0)
    )
    return out.join(terms.drop("_burn"), "term").withColumn("other_hhi", hhi).drop("_sq")


def emergence(
    doc_terms: DataFrame, outcome: DataFrame, emerge_min: int = 50, prior_max: int = 25,
    cohorts: dict[str, tuple[int, int]] | None = None, floor: int = 20,
) -> DataFrame:
    """Per (class, term): first year with ``emerge_min`` documents after fewer than
    ``prior_max`` before, and the outcome of early, middle and late adopters.

    ``outcome``: (doc_id, good).  Counts are per year, so a term's window is short.
    """
    yearly = doc_terms.join(outcome, "doc_id").groupBy("cls", "term", "year").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good")
    )
    return _emergence(yearly, emerge_min, prior_max, cohorts, floor)


def corpus_emergence(
    docs: DataFrame, doc_terms: DataFrame, emerge_min: int = 50, prior_max: int = 25,
    cohorts: dict[str, tuple[int, int]] | None = None, floor: int = 20, min_df: int = 5, max_df: float = 0.5,
) -> DataFrame:
    """:func:`emergence` over the vocabulary of the documents themselves, whose keys are unique.

    ``doc_terms`` is ``(cls, year, term, _m, _g)``, a row a document and term, dealt by term: the
    document's number of outcomes and of good ones.  Everything is counted where these rows lie, so
    they move once.
    """
    n = docs.groupBy("cls").agg(F.count(F.lit(1)).alias("_n"))
    yearly = doc_terms.groupBy("cls", "term", "year").agg(F.count(F.lit(1)).alias("_docs"), F.sum("_m").alias("n"), F.sum("_g").alias("good"))
    yearly = yearly.withColumn("_df", F.sum("_docs").over(Window.partitionBy("cls", "term"))).join(F.broadcast(n), "cls")
    known = yearly.filter((F.col("_df") >= min_df) & (F.col("_df") <= F.col("_n") * max_df))
    return _emergence(known.select("cls", "term", "year", "n", "good"), emerge_min, prior_max, cohorts, floor)


def _emergence(yearly: DataFrame, emerge_min: int, prior_max: int, cohorts: dict[str, tuple[int, int]] | None, floor: int) -> DataFrame:
    cohorts = cohorts or {"early": (0, 1), "mid": (2, 4), "late": (5, 9)}
    w = Window.partitionBy("cls", "term").orderBy("year")
    prior = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    yearly = yearly.withColumn("_prior", prior)
    hit = F.when(F.col("n") >= emerge_min, F.struct(F.col("year").alias("y"), F.col("_prior").alias("p")))
    whole = Window.partitionBy("cls", "term")
    start = yearly.withColumn("_e", F.min(hit).over(whole)).withColumn("n_total", F.sum("n").over(whole))
    start = start.filter(F.col("_e").isNotNull() & (F.col("_e.p") < prior_max)).select(
        "cls", "term", "year", "n", "good", "n_total",
        F.col("_e.y").alias("emergence_year"), F.col("_e.p").alias("prior_docs"),
    )
    age = F.col("year") - F.col("emergence_year")
    aggs = []
    for name, (lo, hi) in cohorts.items():
        for c in ("n", "good"):
            aggs.append(F.sum(F.when(age.between(lo, hi), F.col(c)).otherwise(0)).alias(f"_{c}_{name}"))
    keys = ["cls", "term", "n_total", "emergence_year", "prior_docs"]
    out = start.groupBy(*keys).agg(*aggs)
    first, last = list(cohorts)[0], list(cohorts)[-1]
    out = out.filter((F.col(f"_n_{first}") >= floor) & (F.col(f"_n_{last}") >= floor))
    for name in cohorts:
        out = out.withColumnRenamed(f"_n_{name}", f"n_{name}")
        out = out.withColumn(f"rate_{name}", ratio(F.col(f"_good_{name}"), F.col(f"n_{name}")))
        out = out.drop(f"_good_{name}")
    return out.withColumn("late_minus_early", F.col(f"rate_{last}") - F.col(f"rate_{first}"))


def absent_then_popular(
    doc_terms: DataFrame, early: tuple[int, int], floor: int, k: int = 100
) -> DataFrame:
    """Most common terms without any document in the early years."""
    y = F.col("year")
    out = doc_terms.groupBy("term").agg(
        F.count(F.lit(1)).alias("doc_freq"),
        F.count_if(y.between(*early)).alias("_early"),
        F.min("year").alias("first_year"),
    )
    out = out.filter((F.col("_early") == 0) & (F.col("doc_freq") >= floor)).drop("_early")
    return out.orderBy(F.desc("doc_freq"), "term").limit(k)


RANK_EDGES = [(10, "1-10"), (50, "11-50"), (100, "51-100"), (500, "101-500"),
              (1000, "501-1k"), (5000, "1k-5k")]


def adopters(docs: DataFrame, phrase: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """First document with the phrase per owner, ranked by adoption date."""
    hits = docs.filter(tx.has_phrase("body", phrase) & F.col("owner").isNotNull())
    first = F.min(F.struct("filed", "doc_id", *extra)).alias("_f")
    per = hits.groupBy("owner").agg(first, F.count(F.lit(1)).alias("n_docs"))
    per = per.select(
        "owner", "n_docs", F.col("_f.filed").alias("adopted"), F.col("_f.doc_id").alias("first_doc"),
        *[F.col(f"_f.{e}").alias(e) for e in extra],
    )
    return ranking.sequence_number(per, ["adopted", "owner"], out="rank")


def ladder_outcomes(ranked: DataFrame, outcome: Column) -> DataFrame:
    b = ranked.withColumn("rung", ladder(F.col("rank"), RANK_EDGES, "5k+"))
    return b.groupBy("rung").agg(
        F.count(F.lit(1)).alias("n_owners"), share(outcome).alias("rate"),
        F.min("adopted").alias("first_adopted"),
    )


def phrase_pools(docs: DataFrame, phrases: dict[str, str], k: int = 1000) -> DataFrame:
    """First ``k`` adopters of each phrase: one pass over the text for all phrases."""
    labels = F.array_compact(
        F.array(*[F.when(tx.has_phrase("body", p), F.lit(n)) for n, p in phrases.items()])
    )
    hits = docs.select("owner", "filed", F.explode(labels).alias("phrase"))
    firsts = hits.groupBy("phrase", "owner").agg(F.min("filed").alias("adopted"))
    w = Window.partitionBy("phrase").orderBy("adopted", "owner")
    return firsts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def sustained(doc_terms: DataFrame, need: int) -> DataFrame:
    """First date of a term and the date its document count reaches ``need``."""
    daily = doc_terms.groupBy("term", "filed").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("term").orderBy("filed").rowsBetween(Window.unboundedPreceding, 0)
    run = daily.withColumn("_c", F.sum("_n").over(w))
    return run.groupBy("term").agg(
        F.min("filed").alias("first_seen"),
        F.min(F.when(F.col("_c") >= need, F.col("filed"))).alias("sustained_from"),
    )


def enrichment(
    docs: DataFrame, score: str, outcome: str, stage: Callable[[DataFrame, str], DataFrame], min_docs: int, max_share: float = 0.2,
    k: int = 25,
) -> DataFrame:
    """Words over-represented in the lowest, middle and highest lead stratum.

    ``stage`` keeps a document's score and distinct words, which quantiles, sizes and counts
    read; the texts are read once.
    """
    docs = stage(docs.select(score, outcome, tx.word_set("body").alias("_words")), "words")
    names = ["_p10", "_p40", "_p60", "_p90"]
    d = ranking.with_quantiles(docs, score, [0.1, 0.4, 0.6, 0.9], names)
    s = F.col(score)
    stratum = (
        F.when(s <= F.col("_p10"), "low")
        .when(s.between(F.col("_p40"), F.col("_p60")), "neutral")
        .when(s >= F.col("_p90"), "high")
    )
    d = d.withColumn("stratum", stratum)
    strata = ("low", "neutral", "high")
    sizes = d.agg(F.count(F.lit(1)).alias("_all"), *[F.count_if(F.col("stratum") == x).alias(f"_{x}") for x in strata])
    words = d.select("stratum", outcome, F.explode("_words").alias("word"))
    per = words.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_docs"),
        share(F.col(outcome)).alias("rate"),
        *[F.count_if(F.col("stratum") == x).alias(f"n_{x}") for x in strata],
    ).filter(F.col("n_docs") >= min_docs)
    per = per.crossJoin(F.broadcast(sizes))  # one row
    per = per.withColumn("p_all", F.col("n_docs") / F.col("_all")).filter(F.col("p_all") <= max_share)
    cells = ", ".join(f"'{x}', n_{x} / _{x}" for x in strata)
    long = per.selectExpr("word", "n_docs", "rate", "p_all", f"stack(3, {cells}) as (stratum, p_stratum)")
    long = long.withColumn("lift", F.round(F.col("p_stratum") / F.col("p_all"), 9))
    w = Window.partitionBy("stratum").orderBy(F.desc("lift"), "word")
    return long.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def token_cohorts(docs: DataFrame, tokens: list[str], outcome: Column) -> DataFrame:
    """Outcome by year of the owners' first documents that contain each token."""
    first = ranking.with_stats(docs, ["owner"], _d=F.min("filed"))
    first = first.filter(F.col("filed") == F.col("_d"))
    labels = F.array_compact(
        F.array(*[F.when(tx.has_phrase("body", t), F.lit(t)) for t in tokens])
    )
    hits = first.withColumn("_y", outcome).select("year", "_y", F.explode(labels).alias("token"))
    return hits.groupBy("token", "year").agg(
        F.count(F.lit(1)).alias("n"), share(F.col("_y")).alias("rate")
    )


def vocabulary_recurrence(docs: DataFrame, doc_terms: DataFrame, owner: str = "owner") -> DataFrame:
    """Per document in owner order: share of terms new to the owner and Jaccard
    with everything the owner wrote before.

    No state machine: a term is new where the owner's first position of it is
    the document's own, and the size of the earlier vocabulary is the running
    total of new terms.  If ``doc_terms`` has the owner (and ``doc_id`` is unique), first
    positions are found where the terms lie, and no row of them is joined to anything.
    """
    pos = ranking.sequence_number(docs.select("doc_id", owner, "filed"), ["filed", "doc_id"], [owner])
    if owner in doc_terms.columns:
        # the hash comes first: comparing it settles nearly every comparison of the sort
        w = Window.partitionBy("_h", owner, "term").orderBy("filed", "doc_id")
        t = doc_terms.select("doc_id", owner, "filed", "term").filter(F.col(owner).isNotNull()).withColumn("_h", F.xxhash64(owner, "term"))
        marked = t.select("doc_id", (F.row_number().over(w) == 1).alias("_is_new"))
    else:
        t = doc_terms.select("doc_id", "term").join(pos.select("doc_id", owner, "seq"), "doc_id")
        first = t.groupBy(owner, "term").agg(F.min("seq").alias("_first"))
        marked = t.join(first, [owner, "term"]).select("doc_id", (F.col("seq") == F.col("_first")).alias("_is_new"))
    per = marked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_unique"), F.count_if("_is_new").alias("_new"))
    j = pos.join(per, "doc_id", "left").na.fill(0, ["n_unique", "_new"])
    j = ranking.running_total(j, ["seq"], F.col("_new"), [owner], "_prior")
    ok = (F.col("seq") > 1) & (F.col("n_unique") > 0)
    return j.select(
        "doc_id", owner, "seq", "n_unique",
        F.when(ok, F.col("_new") / F.col("n_unique")).alias("share_new"),
        F.when(
            ok, (F.col("n_unique") - F.col("_new")) / (F.col("_prior") + F.col("_new"))
        ).alias("jaccard_prior"),
    )
