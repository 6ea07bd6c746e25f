"""Join, aggregation and window queries."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions.scalars import correlation, ladder, ratio, two_rate_se, wilson_bounds
from ..operators import aggregates, ranking
from . import bindings as b
from .lifecycle import obin_sql
from .registry import R, query, r, rounded, view
from .texts import wilson_sql


def N():
    return F.count(F.lit(1))


def owner_year(spark, d):
    return b.cases(spark, d).groupBy("owner", "year").agg(
        N().alias("n"), F.round(F.sum("amount"), 2).alias("total"),
        F.round(F.max("amount"), 2).alias("peak"),
    )


view(
    "v_oy",
    """SELECT owner, year, count(*) AS n, round(sum(amount), 2) AS total, round(max(amount), 2) AS peak
    FROM v_cases GROUP BY 1, 2""",
)

# --- joins -----------------------------------------------------------------


@query(
    "join_inner",
    "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey",
)
def join_inner(spark, d):
    lines = b.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    orders = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return lines.join(orders, "l_orderkey")


@query(
    "join_left_fill",
    """SELECT case_id, coalesce(e.n, 0) AS n_events, coalesce(e.late, false) AS late FROM v_cases c LEFT JOIN
    (SELECT case_id, count(*) AS n, bool_or(code = 'RF') AS late FROM v_events GROUP BY 1) e USING (case_id)""",
)
def join_left_fill(spark, d):
    ev = b.case_events(spark, d).groupBy("case_id").agg(
        N().alias("n"), F.bool_or(F.col("code") == "RF").alias("late")
    )
    return b.cases(spark, d).select("case_id").join(ev, "case_id", "left").select(
        "case_id", F.coalesce("n", F.lit(0)).alias("n_events"),
        F.coalesce("late", F.lit(False)).alias("late"),
    )


@query(
    "join_left_on_right_on",
    "SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
)
def join_left_on_right_on(spark, d):
    o, c = b.table(spark, d, "orders"), b.table(spark, d, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        "o_orderkey", "c_mktsegment"
    )


@query(
    "join_semi",
    "SELECT case_id FROM v_cases WHERE case_id IN (SELECT case_id FROM v_events WHERE code = 'RF') AND cls IN ('1-URGENT', '2-HIGH')",
)
def join_semi(spark, d):
    ev = b.case_events(spark, d).filter(F.col("code") == "RF")
    kept = b.cases(spark, d).filter(F.col("cls").isin("1-URGENT", "2-HIGH"))
    return kept.join(ev, "case_id", "left_semi").select("case_id")


@query(
    "join_anti",
    "SELECT case_id FROM v_cases WHERE NOT EXISTS (SELECT 1 FROM v_events e WHERE e.case_id = v_cases.case_id AND code = 'RF') AND cls NOT IN ('5-LOW')",
)
def join_anti(spark, d):
    ev = b.case_events(spark, d).filter(F.col("code") == "RF")
    kept = b.cases(spark, d).filter(~F.col("cls").isin("5-LOW"))
    return kept.join(ev, "case_id", "left_anti").select("case_id")


@query(
    "join_theta_after",
    """SELECT c.case_id, min(date_diff('day', c.filed, e.happened)) AS gap FROM v_cases c
    JOIN v_events e ON e.case_id = c.case_id AND e.happened > c.filed GROUP BY 1""",
)
def join_theta_after(spark, d):
    ev = b.case_events(spark, d).select("case_id", "happened")
    j = b.cases(spark, d).join(ev, "case_id").filter(F.col("happened") > F.col("filed"))
    gap = F.min(F.datediff("happened", "filed").cast("long"))
    return j.groupBy("case_id").agg(gap.alias("gap"))


@query(
    "join_event_expand",
    """WITH ev AS (SELECT owner, min(year) AS y0 FROM v_oy WHERE n >= 2 GROUP BY 1),
    x AS (SELECT owner, y0, unnest(range(-2, 4)) AS rel FROM ev)
    SELECT x.owner, CAST(x.rel AS INTEGER) AS rel, p.n, p.total FROM x JOIN v_oy p ON p.owner = x.owner AND p.year = x.y0 + x.rel""",
)
def join_event_expand(spark, d):
    from ..operators.panels import expand_events

    panel = owner_year(spark, d)
    ev = panel.filter(F.col("n") >= 2).groupBy("owner").agg(F.min("year").alias("event_year"))
    return expand_events(ev, panel, "owner", -2, 3).select("owner", "rel", "n", "total")


@query(
    "join_lagged_panel",
    """SELECT a.owner, a.year, a.n, c.n AS n_lag1 FROM v_oy a JOIN v_oy c ON c.owner = a.owner AND c.year + 1 = a.year""",
)
def join_lagged_panel(spark, d):
    from ..operators.panels import lagged

    p = owner_year(spark, d).select("owner", "year", "n")
    return lagged(p, "owner", ["n"], 1)


@query(
    "join_dict_lookup",
    "SELECT s_suppkey, coalesce(n_name, 'unknown') AS nation FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey",
)
def join_dict_lookup(spark, d):
    nation = b.table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    s = b.table(spark, d, "supplier").join(nation, "s_nationkey", "left")
    return s.select("s_suppkey", F.coalesce("n_name", F.lit("unknown")).alias("nation"))


@query(
    "join_debut_equal",
    "SELECT case_id, owner, filed FROM (SELECT *, min(filed) OVER (PARTITION BY owner) AS f0 FROM v_cases) WHERE filed = f0",
)
def join_debut_equal(spark, d):
    c = ranking.with_stats(b.cases(spark, d), ["owner"], first=F.min("filed"))
    return c.filter(F.col("filed") == F.col("first")).select("case_id", "owner", "filed")


@query(
    "join_three_scores",
    f"""SELECT case_id, {R('a.amount')} AS w3, {R('q')} AS w5, {R('p')} AS w7 FROM v_cases a
    JOIN (SELECT l_orderkey AS case_id, avg(l_quantity) AS q FROM lineitem GROUP BY 1) USING (case_id)
    JOIN (SELECT l_orderkey AS case_id, max(l_extendedprice) AS p FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) USING (case_id)""",
)
def join_three_scores(spark, d):
    lines = b.table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "case_id")
    five = lines.groupBy("case_id").agg(r(F.avg("l_quantity")).alias("w5"))
    seven = lines.filter(F.col("l_returnflag") == "A").groupBy("case_id").agg(
        r(F.max("l_extendedprice")).alias("w7")
    )
    three = b.cases(spark, d).select("case_id", r("amount").alias("w3"))
    return three.join(five, "case_id").join(seven, "case_id")


# --- aggregations ----------------------------------------------------------


@query(
    "firm_year",
    f"""WITH s AS (SELECT *, kl_past - kl_future AS ld, n_past >= 20 AND n_future >= 20 AND n_terms >= 3
      AND kl_past IS NOT NULL AND kl_future IS NOT NULL AS ok FROM v_scores)
    SELECT mark AS owner, year, count(*) AS n_filings, count(*) FILTER (WHERE ok) AS n_clean,
    {R('avg(ld) FILTER (WHERE ok)')} AS mean_lead, {R('max(ld) FILTER (WHERE ok)')} AS max_lead,
    {R('list_sort(list(ld) FILTER (WHERE ok))[1 + CAST(round(0.9 * (count(*) FILTER (WHERE ok) - 1)) AS BIGINT)]')} AS p90_lead,
    count(*) FILTER (WHERE ok AND ld >= 0.05) AS n_high, {R('avg(kl_past) FILTER (WHERE ok)')} AS mean_past,
    {R('avg(kl_future) FILTER (WHERE ok)')} AS mean_future, CAST(coalesce(sum(n_terms) FILTER (WHERE ok), 0) AS BIGINT) AS n_terms_total,
    {R('(count(*) FILTER (WHERE ok AND ld >= 0.05)) / CAST(nullif(count(*) FILTER (WHERE ok), 0) AS DOUBLE)')} AS share_high
    FROM s GROUP BY 1, 2""",
)
def firm_year(spark, d):
    # staged, because the ranks count the largest group before they choose a plan
    s = b.stage(b.scores(spark, d).drop("owner").withColumnRenamed("mark", "owner"), "firm-scores")
    out = aggregates.owner_year(s, high=0.05, **b.CLEAN)
    return rounded(out, "mean_lead", "max_lead", "p90_lead", "mean_past", "mean_future", "share_high")


@query(
    "agg_conditional",
    f"""SELECT cls, {R('avg(amount) FILTER (WHERE registered)', 3)} AS mean_registered, max(amount) FILTER (WHERE NOT registered) AS max_pending,
    count(*) FILTER (WHERE amount > 400000) AS n_large FROM v_cases GROUP BY cls""",
)
def agg_conditional(spark, d):
    return b.cases(spark, d).groupBy("cls").agg(
        r(F.expr("avg(amount) FILTER (WHERE registered)"), 3).alias("mean_registered"),
        F.expr("max(amount) FILTER (WHERE NOT registered)").alias("max_pending"),
        F.expr("count(*) FILTER (WHERE amount > 400000)").alias("n_large"),
    )


@query(
    "agg_basic",
    f"""SELECT cls, count(*) AS n, {R('sum(amount)', 2)} AS total, {R('avg(amount)', 3)} AS mean, min(amount) AS lo, max(amount) AS hi,
    {R('median(amount)', 3)} AS med, {R('stddev_samp(amount)', 3)} AS sd, count(DISTINCT owner) AS n_owners FROM v_cases GROUP BY cls""",
)
def agg_basic(spark, d):
    c = b.cases(spark, d)
    out = c.groupBy("cls").agg(
        N().alias("n"), r(F.sum("amount"), 2).alias("total"), r(F.avg("amount"), 3).alias("mean"),
        F.min("amount").alias("lo"), F.max("amount").alias("hi"),
        r(F.stddev_samp("amount"), 3).alias("sd"), F.countDistinct("owner").alias("n_owners"),
    )
    med = ranking.quantiles(c, "amount", [0.5], ["cls"], ["med"])
    return out.join(rounded(med, "med", digits=3), "cls")


@query(
    "agg_first_ordered",
    """SELECT owner, case_id AS first_case, cls AS first_cls FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY filed, case_id) AS rn
    FROM v_cases) WHERE rn = 1""",
)
def agg_first_ordered(spark, d):
    first = F.min_by(F.struct("case_id", "cls"), F.struct("filed", "case_id"))
    g = b.cases(spark, d).groupBy("owner").agg(first.alias("f"))
    return g.select("owner", F.col("f.case_id").alias("first_case"), F.col("f.cls").alias("first_cls"))


@query(
    "agg_argmax_category",
    """SELECT owner, cls, n FROM (SELECT owner, cls, count(*) AS n, row_number() OVER (PARTITION BY owner ORDER BY count(*) DESC, cls) AS rn
    FROM v_cases GROUP BY owner, cls) WHERE rn = 1""",
)
def agg_argmax_category(spark, d):
    return aggregates.dominant_category(b.cases(spark, d), "owner", "cls")


@query(
    "agg_weighted_mean",
    f"SELECT owner, {R('sum(kl_past * n_terms) / sum(n_terms)')} AS wmean, CAST(sum(n_terms) AS BIGINT) AS weight FROM v_scored GROUP BY owner",
)
def agg_weighted_mean(spark, d):
    w = F.sum("n_terms")
    return b.scored_cases(spark, d).groupBy("owner").agg(
        r(F.sum(F.col("kl_past") * F.col("n_terms")) / w).alias("wmean"), w.alias("weight")
    )


def conc_sql(source: str, entity: str, by: str, k: int, floor: int) -> str:
    return f"""WITH p AS (SELECT {by}, {entity}, count(*) AS c, row_number() OVER (PARTITION BY {by} ORDER BY count(*) DESC, {entity}) AS rn
      FROM {source} GROUP BY {by}, {entity})
    SELECT {by}, CAST(sum(c) AS BIGINT) AS n, count(*) AS n_entities, CAST(sum(c) FILTER (WHERE rn <= {k}) AS BIGINT) AS n_top,
    {R(f'sum(c) FILTER (WHERE rn <= {k}) / CAST(sum(c) AS DOUBLE)')} AS top_share,
    {R('sum(CAST(c AS DOUBLE) * c) / sum(c) / sum(c) * 10000', 4)} AS hhi FROM p GROUP BY {by} HAVING sum(c) >= {floor}"""


@query("agg_hhi_topn", conc_sql("v_cases", "owner", "cls, year", 10, 0))
def agg_hhi_topn(spark, d):
    out = aggregates.concentration(b.cases(spark, d), "owner", ["cls", "year"], 10)
    return rounded(rounded(out, "top_share"), "hhi", digits=4)


@query("agg_hhi_topk_share", conc_sql("v_events", "code", "seq", 2, 500))
def agg_hhi_topk_share(spark, d):
    out = aggregates.concentration(b.case_events(spark, d), "code", ["seq"], 2, 500)
    return rounded(rounded(out, "top_share"), "hhi", digits=4)


@query(
    "agg_entropy_concentration",
    f"""WITH c AS (SELECT year, cls, count(*) AS k, avg(lead) AS m FROM v_scored GROUP BY 1, 2),
    s AS (SELECT *, k / CAST(sum(k) OVER (PARTITION BY year) AS DOUBLE) AS s FROM c)
    SELECT year, CAST(sum(k) AS BIGINT) AS n, {R('max(s)')} AS max_share, {R('1 + sum(s * ln(s)) / ln(5)')} AS concentration,
    {R('sum(m * k) / sum(k)')} AS weighted_mean FROM s GROUP BY year HAVING sum(k) >= 100""",
)
def agg_entropy_concentration(spark, d):
    out = aggregates.entropy_concentration(b.scored_cases(spark, d), "cls", ["year"], 5, "lead", 100)
    return rounded(out, "max_share", "concentration", "weighted_mean")


@query(
    "agg_pivot",
    f"""SELECT owner, {R("sum(amount) FILTER (WHERE year = 1995)", 2)} AS y1995, {R("sum(amount) FILTER (WHERE year = 1996)", 2)} AS y1996,
    {R("sum(amount) FILTER (WHERE year = 1997)", 2)} AS y1997 FROM v_cases WHERE year IN (1995, 1996, 1997) GROUP BY owner""",
)
def agg_pivot(spark, d):
    years = [1995, 1996, 1997]
    c = b.cases(spark, d).filter(F.col("year").isin(years))
    wide = c.groupBy("owner").pivot("year", years).agg(F.sum("amount"))
    return wide.select("owner", *[r(F.col(str(y)), 2).alias(f"y{y}") for y in years])


@query(
    "agg_wide_months",
    f"""SELECT owner, {R('sum(amount)', 2)} AS total FROM v_cases GROUP BY owner HAVING count(DISTINCT month(filed)) = 12""",
)
def agg_wide_months(spark, d):
    from ..operators.panels import sum_if_complete

    months = list(range(1, 13))
    c = b.cases(spark, d).withColumn("m", F.month("filed"))
    wide = c.groupBy("owner").pivot("m", months).agg(F.sum("amount"))
    out = sum_if_complete(wide, [str(m) for m in months], "total")
    return out.filter(F.col("total").isNotNull()).select("owner", r("total", 2).alias("total"))


@query(
    "agg_coalesce_tags",
    f"""WITH t AS (SELECT owner, year, max(amount) FILTER (WHERE cls = '1-URGENT') AS a, max(amount) FILTER (WHERE cls = '2-HIGH') AS b,
      max(amount) FILTER (WHERE cls = '5-LOW') AS c FROM v_cases GROUP BY 1, 2), u AS (SELECT *, coalesce(a, b) AS rev FROM t)
    SELECT owner, year, rev AS revenue, c AS cogs, {R('rev - c', 2)} AS gross_profit, {R('(rev - c) / rev')} AS gross_margin FROM u
    WHERE rev IS NOT NULL""",
)
def agg_coalesce_tags(spark, d):
    from ..operators.panels import derive_margin

    tags = ["1-URGENT", "2-HIGH", "5-LOW"]
    wide = b.cases(spark, d).groupBy("owner", "year").pivot("cls", tags).agg(F.max("amount"))
    out = derive_margin(wide, revenue=tags[:2], cost=tags[2:], profit=[])
    out = rounded(rounded(out, "gross_profit", digits=2), "gross_margin")
    return out.select("owner", "year", "revenue", "cogs", "gross_profit", "gross_margin")


@query(
    "agg_corr_pearson",
    f"""SELECT cls, count(*) AS n, {R('corr(kl_past, kl_future)')} AS rho FROM v_scored GROUP BY cls
    UNION ALL SELECT 'all', count(*), {R('corr(kl_past, kl_future)')} FROM v_scored""",
)
def agg_corr_pearson(spark, d):
    s = b.scored_cases(spark, d)
    aggs = [N().alias("n"), r(correlation("kl_past", "kl_future")).alias("rho")]
    pooled = s.agg(*aggs).select(F.lit("all").alias("cls"), "n", "rho")
    return s.groupBy("cls").agg(*aggs).unionByName(pooled)


def mid_rank_sql(col: str, part: str = "") -> str:
    p = f"PARTITION BY {part} " if part else ""
    q = f"PARTITION BY {part}, {col}" if part else f"PARTITION BY {col}"
    return f"(rank() OVER ({p}ORDER BY {col}) + (count(*) OVER ({q}) - 1) / 2.0)"


@query(
    "agg_corr_spearman",
    f"""SELECT cls, count(*) AS n, {R('corr(rx, ry)')} AS rho FROM (SELECT cls, CAST({mid_rank_sql('kl_past', 'cls')} AS DOUBLE) AS rx,
    CAST({mid_rank_sql('n_terms', 'cls')} AS DOUBLE) AS ry FROM v_scored) GROUP BY cls""",
)
def agg_corr_spearman(spark, d):
    return rounded(ranking.spearman(b.scored_cases(spark, d), "kl_past", "n_terms", ["cls"]), "rho")


@query(
    "agg_group_slope",
    f"SELECT cls, {R('regr_slope(m, year)', 4)} AS slope, count(*) AS n_years FROM (SELECT cls, year, avg(lead) AS m FROM v_scored GROUP BY 1, 2) GROUP BY cls",
)
def agg_group_slope(spark, d):
    g = b.scored_cases(spark, d).groupBy("cls", "year").agg(F.avg("lead").alias("m"))
    slope = F.regr_slope("m", F.col("year").cast("double"))
    return g.groupBy("cls").agg(r(slope, 4).alias("slope"), N().alias("n_years"))


@query("agg_distinct_two_level", "SELECT owner, min(filed) AS first, count(DISTINCT cls) AS n_cls FROM v_cases GROUP BY owner")
def agg_distinct_two_level(spark, d):
    per = b.cases(spark, d).groupBy("owner", "cls").agg(F.min("filed").alias("f"))
    return per.groupBy("owner").agg(F.min("f").alias("first"), N().alias("n_cls"))


@query(
    "agg_cohort_label",
    """SELECT owner, count(*) AS n, count(*) FILTER (WHERE registered) AS n_good, CASE WHEN bool_and(registered) THEN 'all'
    WHEN bool_or(registered) THEN 'mixed' ELSE 'none' END AS cohort FROM v_cases GROUP BY owner HAVING count(*) >= 3""",
)
def agg_cohort_label(spark, d):
    return aggregates.outcome_cohorts(b.cases(spark, d), "owner", F.col("registered"))


@query(
    "agg_tier_shares",
    f"""WITH p AS (SELECT year, owner, count(*) AS c, row_number() OVER (PARTITION BY year ORDER BY count(*) DESC, owner) AS rn FROM v_cases GROUP BY 1, 2)
    SELECT year, CAST(sum(c) AS BIGINT) AS n, {R('coalesce(sum(c) FILTER (WHERE c = 1), 0) / CAST(sum(c) AS DOUBLE)')} AS single_share,
    {R('coalesce(sum(c) FILTER (WHERE c BETWEEN 2 AND 9), 0) / CAST(sum(c) AS DOUBLE)')} AS mid_share,
    {R('coalesce(sum(c) FILTER (WHERE c >= 10), 0) / CAST(sum(c) AS DOUBLE)')} AS heavy_share,
    {R('sum(c) FILTER (WHERE rn <= 10) / CAST(sum(c) AS DOUBLE)')} AS top_share FROM p GROUP BY year""",
)
def agg_tier_shares(spark, d):
    out = aggregates.tier_shares(b.cases(spark, d), "owner", ["year"])
    return rounded(out, "single_share", "mid_share", "heavy_share", "top_share")


_SIZE = """CASE WHEN c <= 1 THEN '1' WHEN c <= 2 THEN '2' WHEN c <= 5 THEN '3-5' WHEN c <= 10 THEN '6-10' WHEN c <= 20 THEN '11-20'
    WHEN c <= 50 THEN '21-50' ELSE '50+' END"""


@query(
    "agg_firm_outcome_by_size",
    f"""WITH p AS (SELECT owner, count(*) AS c, count(*) FILTER (WHERE registered) AS h FROM v_cases GROUP BY 1),
    g AS (SELECT {_SIZE} AS size, count(*) AS n_entities, CAST(sum(c) AS BIGINT) AS n, avg(h / CAST(c AS DOUBLE)) AS er,
      sum(h) / CAST(sum(c) AS DOUBLE) AS rr FROM p GROUP BY 1)
    SELECT size, n_entities, n, {R('er')} AS entity_rate, {R('rr')} AS rate, {R(wilson_sql('rr', 'n', '-'))} AS lo, {R(wilson_sql('rr', 'n', '+'))} AS hi FROM g""",
)
def agg_firm_outcome_by_size(spark, d):
    out = aggregates.outcome_by_size(b.cases(spark, d), "owner", F.col("registered"))
    return rounded(out, "entity_rate", "rate", "lo", "hi")


@query(
    "agg_wilson_ci",
    f"""SELECT cls, n, {R(wilson_sql('p', 'n', '-'))} AS lo, {R(wilson_sql('p', 'n', '+'))} AS hi FROM (
    SELECT cls, count(*) AS n, avg(CAST(registered AS DOUBLE)) AS p FROM v_cases GROUP BY cls)""",
)
def agg_wilson_ci(spark, d):
    g = b.cases(spark, d).groupBy("cls").agg(
        N().alias("n"), F.avg(F.col("registered").cast("double")).alias("p")
    )
    lo, hi = wilson_bounds(F.col("p"), F.col("n"))
    return g.select("cls", "n", r(lo).alias("lo"), r(hi).alias("hi"))


@query(
    "agg_two_prop_se",
    f"""SELECT year, {R('p1 - p0')} AS diff, {R('sqrt(p1*(1-p1)/greatest(n1,1) + p0*(1-p0)/greatest(n0,1))')} AS se FROM (
    SELECT year, avg(CAST(hit AS DOUBLE)) FILTER (WHERE registered) AS p1, count(*) FILTER (WHERE registered) AS n1,
    avg(CAST(hit AS DOUBLE)) FILTER (WHERE NOT registered) AS p0, count(*) FILTER (WHERE NOT registered) AS n0 FROM v_scored GROUP BY year)""",
)
def agg_two_prop_se(spark, d):
    y, g = F.col("hit").cast("double"), F.col("registered")
    a = b.scored_cases(spark, d).groupBy("year").agg(
        F.avg(F.when(g, y)).alias("p1"), F.count_if(g).alias("n1"),
        F.avg(F.when(~g, y)).alias("p0"), F.count_if(~g).alias("n0"),
    )
    se = two_rate_se(F.col("p1"), F.col("n1"), F.col("p0"), F.col("n0"))
    return a.select("year", r(F.col("p1") - F.col("p0")).alias("diff"), r(se).alias("se"))


# --- windows ---------------------------------------------------------------


@query(
    "win_count_over",
    "SELECT case_id, owner, n_owner FROM (SELECT case_id, owner, count(*) OVER (PARTITION BY owner) AS n_owner FROM v_cases) WHERE n_owner >= 8",
)
def win_count_over(spark, d):
    c = ranking.with_stats(b.cases(spark, d).select("case_id", "owner"), ["owner"], n_owner=N())
    return c.filter(F.col("n_owner") >= 8)


@query(
    "win_zscore",
    f"SELECT case_id, {R('(lead - avg(lead) OVER w) / nullif(stddev_samp(lead) OVER w, 0)', 5)} AS z FROM v_scored WINDOW w AS (PARTITION BY cls, year)",
)
def win_zscore(spark, d):
    s = ranking.with_stats(
        b.scored_cases(spark, d), ["cls", "year"], m=F.avg("lead"), sd=F.stddev_samp("lead")
    )
    return s.select("case_id", r(ratio(F.col("lead") - F.col("m"), F.col("sd")), 5).alias("z"))


@query(
    "win_ordinal_bin",
    f"""SELECT o.case_id, o.bin, CAST(floor((rank() OVER (PARTITION BY cls, year ORDER BY lead) - 1) * 5 / (count(*) OVER (PARTITION BY cls, year))) AS INTEGER) AS bin_min
    FROM ({obin_sql('v_scored', 'lead', 'case_id', 5, 'cls, year')}) o""",
)
def win_ordinal_bin(spark, d):
    s = b.scored_cases(spark, d).select("case_id", "cls", "year", "lead")
    o = ranking.ordinal_bin(s, "lead", "case_id", 5, ["cls", "year"])
    o = ranking.ordinal_bin(o, "lead", "case_id", 5, ["cls", "year"], "bin_min", ties="min")
    return o.select("case_id", "bin", "bin_min")


@query(
    "win_pct_rank_bin",
    """SELECT case_id, CAST(least(greatest(floor(row_number() OVER (ORDER BY lead, case_id) * 5 / (count(*) OVER ())), 0), 4) AS INTEGER) AS bin FROM v_scored""",
)
def win_pct_rank_bin(spark, d):
    s = b.scored_cases(spark, d).select("case_id", "lead")
    return ranking.percent_bin(s, "lead", "case_id", 5).select("case_id", "bin")


@query(
    "win_shift",
    """SELECT owner, year, n, CASE WHEN lag(year) OVER w = year - 1 THEN lag(n) OVER w END AS n_prev,
    CASE WHEN lead(year) OVER w = year + 1 THEN lead(n) OVER w END AS n_next FROM v_oy WINDOW w AS (PARTITION BY owner ORDER BY year)""",
)
def win_shift(spark, d):
    from ..operators.panels import consecutive_shift

    p = owner_year(spark, d).select("owner", "year", "n")
    return consecutive_shift(p, "owner", "n", lags=(1,), leads=(1,), names=("n_prev", "n_next"))


@query(
    "win_diff",
    """SELECT owner, year, n - lag(n) OVER w AS d1, lag(n) OVER w - lag(n, 2) OVER w AS d1_lag FROM v_oy
    WINDOW w AS (PARTITION BY owner ORDER BY year)""",
)
def win_diff(spark, d):
    w = W.partitionBy("owner").orderBy("year")
    lag1, lag2 = F.lag("n").over(w), F.lag("n", 2).over(w)
    return owner_year(spark, d).select(
        "owner", "year", (F.col("n") - lag1).alias("d1"), (lag1 - lag2).alias("d1_lag")
    )


@query(
    "win_cumsum",
    f"SELECT owner, year, CAST(sum(n) OVER w AS BIGINT) AS n_cum, {R('sum(total) OVER w', 2)} AS total_cum FROM v_oy WINDOW w AS (PARTITION BY owner ORDER BY year)",
)
def win_cumsum(spark, d):
    w = W.partitionBy("owner").orderBy("year").rowsBetween(W.unboundedPreceding, 0)
    return owner_year(spark, d).select(
        "owner", "year", F.sum("n").over(w).alias("n_cum"), r(F.sum("total").over(w), 2).alias("total_cum")
    )


@query(
    "win_trailing_3",
    f"SELECT owner, year, {R('avg(total) OVER (PARTITION BY owner ORDER BY year RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)', 3)} AS mean3 FROM v_oy",
)
def win_trailing_3(spark, d):
    from ..operators.panels import trailing_mean

    out = trailing_mean(owner_year(spark, d), "owner", "total", 3, "mean3")
    return rounded(out, "mean3", digits=3).select("owner", "year", "mean3")


@query(
    "win_cumcount",
    f"""SELECT case_id, row_number() OVER (PARTITION BY owner ORDER BY filed, case_id) - 1 AS seq,
    {R('year - avg(year) OVER (PARTITION BY owner)')} AS year_c FROM v_cases""",
)
def win_cumcount(spark, d):
    c = b.cases(spark, d).select("case_id", "owner", "filed", "year")
    c = ranking.running_total(c, ["filed", "case_id"], None, ["owner"], "seq")
    c = ranking.with_stats(c, ["owner"], m=F.avg("year"))
    return c.select("case_id", "seq", r(F.col("year") - F.col("m")).alias("year_c"))


@query(
    "win_autocorr",
    f"""SELECT owner, count(*) AS n_pairs, {R('corr(lead, prev)')} AS ar1 FROM (SELECT owner, lead, lag(lead) OVER (PARTITION BY owner ORDER BY filed, case_id) AS prev
    FROM v_scored) WHERE prev IS NOT NULL GROUP BY owner HAVING count(*) >= 4""",
)
def win_autocorr(spark, d):
    s = b.scored_cases(spark, d).select("case_id", "owner", "filed", "lead")
    n = ranking.neighbours(s, ["owner"], ["filed", "case_id"], ["lead"])
    n = n.filter(F.col("prev_lead").isNotNull())
    out = n.groupBy("owner").agg(N().alias("n_pairs"), r(correlation("lead", "prev_lead")).alias("ar1"))
    return out.filter(F.col("n_pairs") >= 4)


@query(
    "win_chain_returns",
    f"""SELECT owner, year, {R('exp(sum(ln(1 + ret)) OVER (PARTITION BY owner ORDER BY year)) - 1', 5)} AS cum FROM (
    SELECT owner, year, total / lag(total) OVER (PARTITION BY owner ORDER BY year) - 1 AS ret FROM v_oy) WHERE ret IS NOT NULL""",
)
def win_chain_returns(spark, d):
    from ..operators.panels import chain_returns

    w = W.partitionBy("owner").orderBy("year")
    p = owner_year(spark, d).withColumn("ret", F.col("total") / F.lag("total").over(w) - 1)
    p = p.filter(F.col("ret").isNotNull())
    return rounded(chain_returns(p, "owner", "ret", "cum"), "cum", digits=5).select("owner", "year", "cum")


view(
    "v_price",
    """SELECT owner, year, amount AS price FROM (SELECT *, row_number() OVER (PARTITION BY owner, year ORDER BY filed DESC, case_id DESC) AS rn
    FROM v_cases) WHERE rn = 1""",
)


@query(
    "win_year_end",
    f"""SELECT a.owner, a.year AS base_year, {R('c.price / a.price - 1', 5)} AS ret_1y, {R('e.price / a.price - 1', 5)} AS ret_2y
    FROM v_price a LEFT JOIN v_price c ON c.owner = a.owner AND c.year = a.year + 1 LEFT JOIN v_price e ON e.owner = a.owner AND e.year = a.year + 2""",
)
def win_year_end(spark, d):
    from ..operators.panels import forward_returns, year_end

    prices = year_end(b.cases(spark, d), "owner", "amount", ["filed", "case_id"])
    return rounded(forward_returns(prices, "owner", (1, 2)), "ret_1y", "ret_2y", digits=5)


@query(
    "win_topn_per_group",
    "SELECT cls, case_id, amount, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY amount DESC, case_id) AS rank FROM v_cases) WHERE rank <= 5",
)
def win_topn_per_group(spark, d):
    w = W.partitionBy("cls").orderBy(F.desc("amount"), "case_id")
    c = b.cases(spark, d).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= 5)
    return c.select("cls", "case_id", "amount", "rank")


@query(
    "win_row_index",
    "SELECT owner, row_number() OVER (ORDER BY first, owner) AS rank FROM (SELECT owner, min(filed) AS first FROM v_cases GROUP BY owner)",
)
def win_row_index(spark, d):
    firsts = b.cases(spark, d).groupBy("owner").agg(F.min("filed").alias("first"))
    return ranking.sequence_number(firsts, ["first", "owner"], out="rank").select("owner", "rank")
