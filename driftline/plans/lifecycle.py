"""Outcome and event-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import correlation, share
from ..operators import outcomes, ranking
from . import bindings as b
from .registry import R, query, r, rounded, view

GATE, LO, HI = ["RF", "RO"], 0.0, 2.0


def qbin_sql(source: str, value: str, k: int, by: str = "", out: str = "bin") -> str:
    """Quantile bins in SQL: one plus the number of cuts strictly below."""
    probs = "[" + ", ".join(repr(i / k) for i in range(1, k)) + "]"
    above = " + ".join(f"CAST({value} > cc[{i}] AS INTEGER)" for i in range(1, k))
    if by:
        return f"""SELECT s.* EXCLUDE (cc), 1 + {above} AS {out} FROM (SELECT a.*, q.cc FROM {source} a JOIN
        (SELECT {by}, quantile_cont(CAST({value} AS DOUBLE), {probs}) AS cc FROM {source} GROUP BY {by}) q USING ({by})) s"""
    return f"""SELECT s.* EXCLUDE (cc), 1 + {above} AS {out} FROM (SELECT a.*, q.cc FROM {source} a,
    (SELECT quantile_cont(CAST({value} AS DOUBLE), {probs}) AS cc FROM {source}) q) s"""


def lift_sql(binned: str, outcome: str, by: str = "", k: int = 5) -> str:
    y = f"CAST({outcome} AS DOUBLE)"
    g = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return f"""SELECT {g}n, {R('rate')} AS rate, n_low, {R('rl')} AS rate_low, n_high, {R('rh')} AS rate_high,
    {R('rh - rl')} AS lift, {R('sqrt(rl*(1-rl)/greatest(n_low,1) + rh*(1-rh)/greatest(n_high,1))')} AS lift_se
    FROM (SELECT {g}count(*) AS n, avg({y}) AS rate, count(*) FILTER (WHERE bin = 1) AS n_low,
      avg({y}) FILTER (WHERE bin = 1) AS rl, count(*) FILTER (WHERE bin = {k}) AS n_high,
      avg({y}) FILTER (WHERE bin = {k}) AS rh FROM ({binned}) {grp})"""


def lift_out(df):
    return rounded(df, "rate", "rate_low", "rate_high", "lift", "lift_se")


def gated(spark, d):
    return outcomes.gate_by_first_event(
        b.scored_cases(spark, d), b.case_events(spark, d), GATE, LO, HI
    )


view(
    "v_gated",
    """SELECT s.*, date_diff('day', s.filed, e.d) / 365.25 AS event_age,
    coalesce(date_diff('day', s.filed, e.d) / 365.25 >= 0 AND date_diff('day', s.filed, e.d) / 365.25 < 2, false) AS failed
    FROM v_scored s LEFT JOIN (SELECT case_id, min(happened) AS d FROM v_events WHERE code IN ('RF','RO') GROUP BY 1) e
    USING (case_id)""",
)


@query(
    "outcome_status_buckets",
    """SELECT case_id, kl_past, kl_future, lead, false AS currently_live, status LIKE '7%' AS abandoned_at_exam,
    status LIKE '8%' AS cancelled_postreg, status = '710' AS cancelled_gate_one, status = '800' AS cancelled_gate_two,
    status LIKE '8%' AS reached_registration, status LIKE '8%' AND 2003 - year >= 5 AS survived_5y,
    false AS survived_10y FROM v_cases LEFT JOIN (SELECT case_id, kl_past, kl_future, lead FROM v_scored) USING (case_id)""",
)
def outcome_status_buckets(spark, d):
    out = outcomes.status_buckets(b.cases(spark, d), 2003, lost_one="710", lost_two="800")
    s = b.scored_cases(spark, d).select("case_id", "kl_past", "kl_future", "lead")
    return out.drop("cls", "owner", "filed", "year", "status", "registered", "amount").join(
        s, "case_id", "left"
    )


@query(
    "outcome_passed_5y",
    """SELECT cls, count(*) AS n, count(*) FILTER (WHERE status = '800') AS passed FROM v_cases
    WHERE 2003 - year >= 5 GROUP BY cls""",
)
def outcome_passed_5y(spark, d):
    # reached and still live; at test scale status 8.. plays "live"
    o = outcomes.status_buckets(b.cases(spark, d), 2003, live="8", cancelled="9")
    aged = o.filter(F.lit(2003) - F.col("year") >= 5)
    passed = F.col("reached_registration") & F.col("currently_live")
    return aged.groupBy("cls").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(passed).alias("passed")
    )


@query("gate_status_codes", "SELECT case_id, status = '700' AS passed FROM v_cases WHERE status IN ('700','710')")
def gate_status_codes(spark, d):
    return outcomes.gate_status(b.cases(spark, d), ["700"], ["710"]).select("case_id", "passed")


@query("gate_event_window", f"SELECT case_id, {R('event_age')} AS event_age, failed FROM v_gated")
def gate_event_window(spark, d):
    return gated(spark, d).select("case_id", r("event_age").alias("event_age"), "failed")


@query(
    "gate_event_window_any",
    """SELECT c.case_id, coalesce(bool_or(date_diff('day', c.filed, e.happened) / 365.25 >= 0
      AND date_diff('day', c.filed, e.happened) / 365.25 < 2), false) AS failed
    FROM v_cases c LEFT JOIN v_events e ON e.case_id = c.case_id AND e.code IN ('RF', 'RO') GROUP BY 1""",
)
def gate_event_window_any(spark, d):
    out = outcomes.gate_by_any_event(b.cases(spark, d), b.case_events(spark, d), GATE, LO, HI)
    return out.select("case_id", "failed")


@query(
    "gate_second",
    "SELECT case_id, status = '710' AS failed_two FROM v_gated WHERE NOT failed AND status IN ('800', '710')",
)
def gate_second(spark, d):
    return outcomes.second_gate(gated(spark, d), ["800"], ["710"]).select("case_id", "failed_two")


@query("gate_cohort_curve", lift_sql(qbin_sql("v_gated", "lead", 5, "year"), "failed", "year"))
def gate_cohort_curve(spark, d):
    return lift_out(outcomes.lift_by(gated(spark, d), "lead", "failed", ["year"], floor=20))


view(
    "v_strata",
    """SELECT *, 'registered' AS stratum FROM v_gated WHERE registered UNION ALL
    SELECT *, 'pending' FROM v_gated WHERE NOT registered UNION ALL
    SELECT *, 'large' FROM v_gated WHERE amount > 250000""",
)


@query("gate_strata", lift_sql(qbin_sql("v_strata", "lead", 5, "stratum"), "failed", "stratum"))
def gate_strata(spark, d):
    flags = {"registered": F.col("registered"), "pending": ~F.col("registered"),
             "large": F.col("amount") > 250000}
    rows = outcomes.in_strata(gated(spark, d), flags)
    return lift_out(outcomes.lift_by(rows, "lead", "failed", ["stratum"]))


@query(
    "gate_class_forest",
    f"""WITH f AS ({lift_sql(qbin_sql('v_gated', 'lead', 5, 'cls'), 'failed', 'cls')})
    SELECT f.*, (SELECT count(*) FROM f WHERE lift > 0) AS n_positive FROM f""",
)
def gate_class_forest(spark, d):
    out = lift_out(outcomes.lift_by(gated(spark, d), "lead", "failed", ["cls"]))
    return ranking.with_stats(out, [], n_positive=F.count_if(F.col("lift") > 0)).orderBy("lift")


@query(
    "gate_censoring",
    f"""WITH g AS (SELECT *, (SELECT max(happened) FROM v_events) AS edge FROM v_gated)
    SELECT year, count(*) AS n, count(*) FILTER (WHERE filed + 730 <= edge) AS n_narrow_ok,
    count(*) FILTER (WHERE filed + 1461 <= edge) AS n_wide_ok,
    {R("avg(CAST(coalesce(event_age >= 0 AND event_age < 2, false) AS DOUBLE))")} AS fail_narrow,
    {R("avg(CAST(coalesce(event_age >= 0 AND event_age < 4, false) AS DOUBLE))")} AS fail_wide,
    {R("avg(date_diff('day', filed, edge) / 365.25)")} AS mean_observable,
    {R("avg(CAST(date_diff('day', filed, edge) / 365.25 >= 2 AS DOUBLE))")} AS share_elapsed FROM g GROUP BY year""",
)
def gate_censoring(spark, d):
    edge = b.case_events(spark, d).agg(F.max("happened")).scalar()
    g = gated(spark, d).withColumn("_edge", edge)
    c = outcomes.censoring(g, F.col("_edge"), (0.0, 2.0), (0.0, 4.0))
    out = c.groupBy("year").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("narrow_ok").alias("n_narrow_ok"),
        F.count_if("wide_ok").alias("n_wide_ok"),
        share(F.col("fail_narrow")).alias("fail_narrow"),
        share(F.col("fail_wide")).alias("fail_wide"),
        F.avg("observable_age").alias("mean_observable"),
        share(F.col("elapsed")).alias("share_elapsed"),
    )
    return rounded(out, "fail_narrow", "fail_wide", "mean_observable", "share_elapsed")


view(
    "v_latency",
    """SELECT case_id, avg(latency) AS mean_latency, count(*) AS n_answered FROM (
    SELECT t.case_id, t.happened, min(date_diff('day', t.happened, a.happened)) AS latency
    FROM v_events t JOIN v_events a ON a.case_id = t.case_id AND a.happened > t.happened
    WHERE t.code IN ('AF', 'AO') AND a.code IN ('NF', 'NO') GROUP BY 1, 2) GROUP BY 1""",
)


@query("event_response_latency", f"SELECT case_id, {R('mean_latency')} AS mean_latency, n_answered FROM v_latency")
def event_response_latency(spark, d):
    out = outcomes.response_latency(b.case_events(spark, d), ["AF", "AO"], ["NF", "NO"])
    return rounded(out, "mean_latency")


@query("event_counts", "SELECT case_id, count(*) AS n_events FROM v_events WHERE code IN ('AF','AO') GROUP BY 1")
def event_counts(spark, d):
    return outcomes.event_counts(b.case_events(spark, d), ["AF", "AO"])


view(
    "v_deaths",
    """SELECT s.*, CASE WHEN e.e1 IS NOT NULL THEN 'prosecution' WHEN e.e2 IS NOT NULL THEN 'gate' ELSE 'alive_or_other' END AS stage,
    coalesce(e.e1, e.e2) AS died, date_diff('day', s.filed, coalesce(e.e1, e.e2)) / 365.25 AS age_at_death
    FROM v_scored s LEFT JOIN (SELECT case_id, min(happened) FILTER (WHERE code = 'AF') AS e1,
      min(happened) FILTER (WHERE code = 'RF') AS e2 FROM v_events WHERE code IN ('AF', 'RF') GROUP BY 1) e USING (case_id)""",
)


def deaths(spark, d):
    return outcomes.death_stage(b.scored_cases(spark, d), b.case_events(spark, d), ["AF"], ["RF"])


@query(
    "death_stage",
    f"""SELECT cls, count(*) AS n_deaths, {R("avg(CAST(stage = 'prosecution' AS DOUBLE))")} AS share_prosecution,
    {R("avg(CAST(stage = 'gate' AS DOUBLE))")} AS share_gate, {R('median(age_at_death)')} AS median_age
    FROM v_deaths WHERE died IS NOT NULL GROUP BY cls""",
)
def death_stage(spark, d):
    dead = deaths(spark, d).filter(F.col("died").isNotNull())
    comp = dead.groupBy("cls").agg(
        F.count(F.lit(1)).alias("n_deaths"),
        r(share(F.col("stage") == "prosecution")).alias("share_prosecution"),
        r(share(F.col("stage") == "gate")).alias("share_gate"),
    )
    med = ranking.quantiles(dead, "age_at_death", [0.5], ["cls"], ["median_age"])
    return comp.join(rounded(med, "median_age"), "cls")


HAZARD_VIEW = f"""WITH t AS ({qbin_sql('v_deaths', 'lead', 3, '', 'tercile')}), ages AS (SELECT unnest(range(0, 8)) AS age)
SELECT t.tercile, CAST(a.age AS INTEGER) AS age,
count(*) FILTER (WHERE (age_at_death IS NULL OR age_at_death >= a.age) AND date_diff('day', filed, DATE '2003-12-31') / 365.25 >= a.age) AS at_risk,
count(*) FILTER (WHERE age_at_death >= a.age AND age_at_death < a.age + 1) AS deaths
FROM t, ages a GROUP BY 1, 2"""
view("v_hazard", HAZARD_VIEW)


def hazards(spark, d):
    t = ranking.quantile_bin(deaths(spark, d), "lead", 3, out="tercile")
    return outcomes.hazard_by_age(t, "2003-12-31", ["tercile"], 8, 20)


@query(
    "hazard_by_age",
    f"SELECT tercile, age, at_risk, deaths, CASE WHEN at_risk > 20 THEN {R('CAST(deaths AS DOUBLE) / at_risk')} END AS hazard FROM v_hazard",
)
def hazard_by_age(spark, d):
    return rounded(hazards(spark, d), "hazard")


@query(
    "hazard_spike",
    f"""WITH h AS (SELECT tercile, avg(h) FILTER (WHERE age BETWEEN 2 AND 3) AS b, avg(h) FILTER (WHERE age BETWEEN 5 AND 6) AS g
    FROM (SELECT tercile, age, CASE WHEN at_risk > 20 THEN CAST(deaths AS DOUBLE) / at_risk END AS h FROM v_hazard) GROUP BY 1)
    SELECT tercile, {R('b')} AS base_hazard, {R('g')} AS gate_hazard, {R('g / nullif(b, 0)')} AS spike_ratio FROM h""",
)
def hazard_spike(spark, d):
    out = outcomes.hazard_spike(hazards(spark, d), ["tercile"])
    return rounded(out, "base_hazard", "gate_hazard", "spike_ratio")


@query(
    "event_code_dict",
    """SELECT code, description, n_events FROM (SELECT code, description, CAST(sum(n) OVER (PARTITION BY code) AS BIGINT) AS n_events,
      row_number() OVER (PARTITION BY code ORDER BY n DESC, description) AS rn FROM (
      SELECT l_returnflag || l_linestatus AS code, 'line ' || l_linenumber AS description, count(*) AS n FROM lineitem GROUP BY 1, 2))
    WHERE rn = 1""",
)
def event_code_dict(spark, d):
    ev = b.case_events(spark, d).withColumn("description", F.concat(F.lit("line "), "seq"))
    return outcomes.code_dictionary(ev, "description")


@query(
    "case_flags",
    """SELECT case_id, length(max(owner_name)) > 0 AS has_owner, max(flag) = 'T' AS flagged, max(cls) = '1-URGENT' AS urgent FROM (
    SELECT case_id, coalesce(c.c_name, '') AS owner_name, CASE WHEN registered THEN 'T' ELSE 'F' END AS flag, cls
    FROM v_cases LEFT JOIN customer c ON c.c_custkey = owner) GROUP BY case_id""",
)
def case_flags(spark, d):
    cust = b.table(spark, d, "customer").select(F.col("c_custkey").alias("owner"), "c_name")
    raw = b.cases(spark, d).join(cust, "owner", "left").select(
        "case_id",
        "cls",
        F.coalesce("c_name", F.lit("")).alias("owner_name"),
        F.when(F.col("registered"), "T").otherwise("F").alias("flag"),
    )
    first = raw.groupBy("case_id").agg(F.min(F.struct("cls", "owner_name", "flag")).alias("f"))
    return first.select(
        "case_id",
        (F.length("f.owner_name") > 0).alias("has_owner"),
        (F.col("f.flag") == "T").alias("flagged"),
        (F.col("f.cls") == "1-URGENT").alias("urgent"),
    )


@query(
    "failure_modes",
    f"""SELECT count(*) AS n_lost, {R("avg(CAST(amount > 400000 AS DOUBLE))")} AS express,
    {R("avg(CAST(amount <= 100000 AS DOUBLE))")} AS no_response, {R("avg(CAST(amount > 100000 AND amount <= 400000 AS DOUBLE))")} AS other
    FROM v_cases WHERE NOT registered""",
)
def failure_modes(spark, d):
    code = F.when(F.col("amount") > 400000, "601").when(F.col("amount") <= 100000, "602")
    lost = b.cases(spark, d).withColumn("status", code.otherwise("603"))
    out = outcomes.failure_modes(lost, {"express": ["601"], "no_response": ["602"]})
    return rounded(out, "express", "no_response", "other")


def obin_sql(source: str, value: str, key: str, k: int, by: str = "", out: str = "bin") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"""SELECT *, CAST(floor((row_number() OVER ({part}ORDER BY {value}, {key}) - 1) * {k}
    / (count(*) OVER ({part.strip()}))) AS INTEGER) AS {out} FROM {source}"""


@query(
    "registration_shape",
    " UNION ALL ".join(
        f"""SELECT '{axis}' AS axis, {k} AS k, bin, count(*) AS n, {R('avg(CAST(registered AS DOUBLE))')} AS rate
        FROM ({obin_sql('v_scored', axis, 'case_id', k)}) GROUP BY bin"""
        for axis in ("lead", "level") for k in (5, 10, 20)
    )
    + f""" UNION ALL SELECT 'lead in level ' || aq, 10, bin, count(*), {R('avg(CAST(registered AS DOUBLE))')}
    FROM ({obin_sql('(' + obin_sql('v_scored', 'level', 'case_id', 5, '', 'aq') + ')', 'lead', 'case_id', 10, 'aq')})
    GROUP BY aq, bin
    UNION ALL SELECT 'ties in lead', 0, NULL, count(*), {R('avg(CAST(k > 1 AS DOUBLE))')} FROM (SELECT count(*) OVER (PARTITION BY lead) AS k FROM v_scored)
    UNION ALL SELECT 'corr of abs lead and level', 0, NULL, count(*), {R('corr(abs(lead), level)')} FROM v_scored""",
)
def registration_shape(spark, d):
    """Rates by bins of both axes at three grains and of lead within level, the share of rows
    that tie in lead, and the correlation of its size with the level."""
    s = b.stage(b.scored_cases(spark, d), "shape")
    ties = s.groupBy("lead").agg(F.count(F.lit(1)).alias("k"))
    ties = ties.agg(F.sum("k").alias("n"), (F.sum(F.when(F.col("k") > 1, F.col("k")).otherwise(0)) / F.sum("k")).alias("rate"))
    both = s.agg(F.count(F.lit(1)).alias("n"), correlation(F.abs("lead"), F.col("level")).alias("rate"))
    out = None
    for name, df in (("ties in lead", ties), ("corr of abs lead and level", both)):
        part = df.select(F.lit(name).alias("axis"), F.lit(0).alias("k"), F.lit(None).cast("int").alias("bin"), "n", r("rate").alias("rate"))
        out = part if out is None else out.unionByName(part)
    for axis in ("lead", "level"):
        for k in (5, 10, 20):
            part = _rates(ranking.ordinal_bin(s, axis, "case_id", k), ["bin"]).select(
                F.lit(axis).alias("axis"), F.lit(k).alias("k"), "bin", "n", "rate"
            )
            out = part if out is None else out.unionByName(part)
    nested = ranking.ordinal_bin(s, "level", "case_id", 5, out="aq")
    nested = ranking.ordinal_bin(nested, "lead", "case_id", 10, ["aq"])
    label = F.concat(F.lit("lead in level "), F.col("aq"))
    return out.unionByName(
        _rates(nested, ["aq", "bin"]).select(
            label.alias("axis"), F.lit(10).alias("k"), "bin", "n", "rate"
        )
    )


def _rates(df, by):
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), r(share(F.col("registered"))).alias("rate")
    )


@query(
    "unconditional_composite",
    f"""WITH c AS (SELECT *, registered AND NOT failed AS composite FROM v_gated),
    reached AS (SELECT * FROM c WHERE registered)
    SELECT scope, {', '.join(f"{R(x)} AS rate_{n}, n_{n}" for x, n in (('rl', 'low'), ('rm', 'mid'), ('rh', 'high')))},
    {R('rm - (rl + rh) / 2')} AS depth,
    {R('sqrt(rm*(1-rm)/n_mid + ((rl+rh)/2)*(1-(rl+rh)/2)/(n_low+n_high))')} AS depth_se FROM (
    {' UNION ALL '.join(f'''SELECT '{s}' AS scope, avg(CAST(composite AS DOUBLE)) FILTER (WHERE bin=1) AS rl, count(*) FILTER (WHERE bin=1) AS n_low,
      avg(CAST(composite AS DOUBLE)) FILTER (WHERE bin=3) AS rm, count(*) FILTER (WHERE bin=3) AS n_mid,
      avg(CAST(composite AS DOUBLE)) FILTER (WHERE bin=5) AS rh, count(*) FILTER (WHERE bin=5) AS n_high FROM ({qbin_sql(t, 'lead', 5)})'''
      for s, t in (('all', 'c'), ('reached', 'reached')))})""",
)
def unconditional_composite(spark, d):
    g = gated(spark, d).withColumn("composite", F.col("registered") & ~F.col("failed"))
    every = outcomes.inverse_u(g, "lead", "composite").withColumn("scope", F.lit("all"))
    reached = outcomes.inverse_u(g.filter("registered"), "lead", "composite")
    out = every.unionByName(reached.withColumn("scope", F.lit("reached")))
    return rounded(out, "rate_low", "rate_mid", "rate_high", "depth", "depth_se")
