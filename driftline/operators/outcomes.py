"""Lifecycle outcomes from status codes and dated event logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import ratio, share, two_rate_se, years_between
from . import ranking

# Status codes of the two maintenance gates.
GATE_ONE_LOST, GATE_TWO_LOST = "686", "688"
# Status codes read as gate passed and gate failed.
PASS_CODES = ("701", "702", "703", "704", "705")
FAIL_CODES = ("710",)


def status_buckets(
    cases: DataFrame,
    today_year: int,
    live: str = "6",
    abandoned: str = "7",
    cancelled: str = "8",
    lost_one: str = GATE_ONE_LOST,
    lost_two: str = GATE_TWO_LOST,
) -> DataFrame:
    """Eight booleans from the status code and the age of the case."""
    bucket, code = F.substring("status", 1, 1), F.col("status")
    age = F.lit(today_year) - F.col("year")
    reached = bucket.isin(live, cancelled)
    five = reached & (age >= 5) & (code != lost_one)
    return cases.select(
        "*",
        (bucket == live).alias("currently_live"),
        (bucket == abandoned).alias("abandoned_at_exam"),
        (bucket == cancelled).alias("cancelled_postreg"),
        (code == lost_one).alias("cancelled_gate_one"),
        (code == lost_two).alias("cancelled_gate_two"),
        reached.alias("reached_registration"),
        five.alias("survived_5y"),
        (five & (age >= 10) & (code != lost_two)).alias("survived_10y"),
    )


def gate_status(
    cases: DataFrame, passed: Sequence[str] = PASS_CODES, failed: Sequence[str] = FAIL_CODES
) -> DataFrame:
    """``passed`` flag for cases whose status resolves the gate; others drop out."""
    code = F.col("status")
    return cases.filter(code.isin(*passed, *failed)).withColumn("passed", code.isin(*passed))


def earliest_event(events: DataFrame, codes: Sequence[str], out: str = "event_d") -> DataFrame:
    picked = events.filter(F.col("code").isin(*codes) & F.col("happened").isNotNull())
    return picked.groupBy("case_id").agg(F.min("happened").alias(out))


def gate_by_first_event(
    cases: DataFrame, events: DataFrame, codes: Sequence[str], lo: float, hi: float,
    start: str = "filed",
) -> DataFrame:
    """Failed when the *earliest* event falls ``lo <= age < hi``; none = passed."""
    age = years_between("event_d", start)
    return cases.join(earliest_event(events, codes), "case_id", "left").select(
        *cases.columns,
        age.alias("event_age"),
        F.coalesce((age >= lo) & (age < hi), F.lit(False)).alias("failed"),
    )


def gate_by_any_event(
    cases: DataFrame, events: DataFrame, codes: Sequence[str], lo: float, hi: float,
    start: str = "filed",
) -> DataFrame:
    """Failed when *any* event falls in the window (an early one masks nothing)."""
    picked = events.filter(F.col("code").isin(*codes)).select("case_id", "happened")
    age = years_between("happened", start)
    hits = (
        cases.select("case_id", start)
        .join(picked, "case_id")
        .groupBy("case_id")
        .agg(F.bool_or((age >= lo) & (age < hi)).alias("_hit"))
    )
    return cases.join(hits, "case_id", "left").select(
        *cases.columns, F.coalesce("_hit", F.lit(False)).alias("failed")
    )


def second_gate(
    cases: DataFrame, renewed: Sequence[str], died: Sequence[str], failed: str = "failed"
) -> DataFrame:
    """Survivors of the first gate with a resolved status: died at the second?"""
    code = F.col("status")
    kept = cases.filter(~F.col(failed) & code.isin(*renewed, *died))
    return kept.withColumn("failed_two", code.isin(*died))


def lift_by(
    df: DataFrame, score: str, outcome: str, by: Sequence[str] = (), k: int = 5, floor: int = 0
) -> DataFrame:
    """Base rate and top-minus-bottom contrast over quantile bins cut per group."""
    rows = df.filter(F.col(score).isNotNull())
    if floor:
        sized = ranking.with_stats(rows, by, _size=F.count(F.lit(1)))
        rows = sized.filter(F.col("_size") >= floor).drop("_size")
    binned = ranking.quantile_bin(rows, score, k, by, "_b")
    y, b = F.col(outcome).cast("double"), F.col("_b")
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.avg(y).alias("rate"),
        F.count_if(b == 1).alias("n_low"),
        F.avg(F.when(b == 1, y)).alias("rate_low"),
        F.count_if(b == k).alias("n_high"),
        F.avg(F.when(b == k, y)).alias("rate_high"),
    ]
    out = binned.groupBy(*by).agg(*aggs) if by else binned.agg(*aggs)
    return out.withColumn("lift", F.col("rate_high") - F.col("rate_low")).withColumn(
        "lift_se",
        two_rate_se(F.col("rate_low"), F.col("n_low"), F.col("rate_high"), F.col("n_high")),
    )


def in_strata(df: DataFrame, strata: dict[str, Column]) -> DataFrame:
    """Repeat each row once per stratum it belongs to."""
    labels = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in strata.items()]))
    return df.withColumn("stratum", F.explode(labels))


def response_latency(
    events: DataFrame, triggers: Sequence[str], responses: Sequence[str]
) -> DataFrame:
    """Mean over triggers of the shortest positive gap to a response."""
    trig = events.filter(F.col("code").isin(*triggers)).select(
        "case_id", F.col("happened").alias("asked")
    )
    resp = events.filter(F.col("code").isin(*responses)).select(
        "case_id", F.col("happened").alias("answered")
    )
    gaps = trig.join(resp, "case_id").filter(F.col("answered") > F.col("asked"))
    per = gaps.groupBy("case_id", "asked").agg(
        F.min(F.datediff("answered", "asked")).alias("latency")
    )
    return per.groupBy("case_id").agg(
        F.avg("latency").alias("mean_latency"), F.count(F.lit(1)).alias("n_answered")
    )


def event_counts(events: DataFrame, codes: Sequence[str]) -> DataFrame:
    picked = events.filter(F.col("code").isin(*codes))
    return picked.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_events"))


def death_stage(
    cases: DataFrame, events: DataFrame, early: Sequence[str], late: Sequence[str]
) -> DataFrame:
    """Stage and age at death; an early-stage event takes precedence.

    Both minima come from one pass over the event log.
    """
    code = F.col("code")
    picked = events.filter(code.isin(*early, *late))
    firsts = picked.groupBy("case_id").agg(
        F.min(F.when(code.isin(*early), F.col("happened"))).alias("_early"),
        F.min(F.when(code.isin(*late), F.col("happened"))).alias("_late"),
    )
    stage = (
        F.when(F.col("_early").isNotNull(), "prosecution")
        .when(F.col("_late").isNotNull(), "gate")
        .otherwise("alive_or_other")
    )
    death = F.coalesce("_early", "_late")
    return cases.join(firsts, "case_id", "left").select(
        *cases.columns,
        stage.alias("stage"),
        death.alias("died"),
        years_between(death, "filed").alias("age_at_death"),
    )


def hazard_by_age(
    lives: DataFrame,
    snapshot: str,
    by: Sequence[str] = (),
    max_age: int = 15,
    min_at_risk: int = 500,
) -> DataFrame:
    """Discrete yearly hazard with right censoring at the snapshot date.

    All ages are counted in one pass; no row is expanded.
    """
    age = F.col("age_at_death")
    seen = F.datediff(F.lit(snapshot).cast("date"), F.col("filed")) / F.lit(365.25)
    aggs = []
    for a in range(max_age):
        aggs += [
            F.count_if((age.isNull() | (age >= a)) & (seen >= a)).alias(f"_r{a}"),
            F.count_if((age >= a) & (age < a + 1)).alias(f"_d{a}"),
        ]
    wide = lives.groupBy(*by).agg(*aggs) if by else lives.agg(*aggs)
    cells = ", ".join(f"{a}, _r{a}, _d{a}" for a in range(max_age))
    out = wide.selectExpr(*by, f"stack({max_age}, {cells}) as (age, at_risk, deaths)")
    enough = F.col("at_risk") > min_at_risk
    return out.withColumn("hazard", F.when(enough, F.col("deaths") / F.col("at_risk")))


def hazard_spike(
    hazards: DataFrame, by: Sequence[str], base: tuple[int, int] = (2, 3),
    spike: tuple[int, int] = (5, 6),
) -> DataFrame:
    h = F.col("hazard")
    return hazards.groupBy(*by).agg(
        F.avg(F.when(F.col("age").between(*base), h)).alias("base_hazard"),
        F.avg(F.when(F.col("age").between(*spike), h)).alias("gate_hazard"),
    ).withColumn("spike_ratio", ratio(F.col("gate_hazard"), F.col("base_hazard")))


def code_dictionary(events: DataFrame, description: str) -> DataFrame:
    """Most common description per code, ties by the smaller text."""
    counts = events.groupBy("code", description).agg(F.count(F.lit(1)).alias("_n"))
    best = counts.groupBy("code").agg(
        F.min(F.struct((-F.col("_n")).alias("m"), F.col(description).alias("d"))).alias("_b"),
        F.sum("_n").alias("n_events"),
    )
    return best.select("code", F.col("_b.d").alias("description"), "n_events")


def failure_modes(cases: DataFrame, modes: dict[str, Sequence[str]]) -> DataFrame:
    """Shares of the unregistered cases by code set, the rest as ``other``."""
    lost = cases.filter(~F.col("registered"))
    code = F.col("status")
    known = [c for codes in modes.values() for c in codes]
    out = lost.agg(
        F.count(F.lit(1)).alias("n_lost"),
        *[share(code.isin(*codes)).alias(m) for m, codes in modes.items()],
        share(~code.isin(*known)).alias("other"),
    )
    return out


def censoring(
    gated: DataFrame, edge: Column, narrow: tuple[float, float], wide: tuple[float, float],
    start: str = "filed",
) -> DataFrame:
    """Exposure of two age windows against the last observed date."""
    age = F.col("event_age")

    def inside(win):
        return F.coalesce((age >= win[0]) & (age < win[1]), F.lit(False))

    observable = F.datediff(edge, F.col(start)) / F.lit(365.25)
    return gated.select(
        *gated.columns,
        (F.date_add(start, int(narrow[1] * 365.25)) <= edge).alias("narrow_ok"),
        (F.date_add(start, int(wide[1] * 365.25)) <= edge).alias("wide_ok"),
        inside(narrow).alias("fail_narrow"),
        inside(wide).alias("fail_wide"),
        observable.alias("observable_age"),
        (observable >= narrow[1]).alias("elapsed"),
    )


def inverse_u(
    df: DataFrame, score: str, outcome: str, k: int = 5, by: Sequence[str] = ()
) -> DataFrame:
    """Middle bin against the mean of both end bins, with its standard error."""
    mid = (k + 1) // 2
    binned = ranking.quantile_bin(df.filter(F.col(score).isNotNull()), score, k, by, "_b")
    y, b = F.col(outcome).cast("double"), F.col("_b")
    aggs = []
    for name, i in (("low", 1), ("mid", mid), ("high", k)):
        aggs += [F.avg(F.when(b == i, y)).alias(f"rate_{name}"), F.count_if(b == i).alias(f"n_{name}")]
    out = binned.groupBy(*by).agg(*aggs) if by else binned.agg(*aggs)
    ends = (F.col("rate_low") + F.col("rate_high")) / 2
    n_ends = (F.col("n_low") + F.col("n_high")) / 2
    p = F.col("rate_mid")
    return out.withColumn("depth", p - ends).withColumn(
        "depth_se", F.sqrt(p * (1 - p) / F.col("n_mid") + ends * (1 - ends) / (2 * n_ends))
    )
