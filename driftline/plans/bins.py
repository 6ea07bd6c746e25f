"""Binning, ordering, set and scalar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import clip, parse_compact_date, ratio
from ..operators import binning, outcomes, ranking
from . import bindings as b
from .lifecycle import lift_out, lift_sql, obin_sql, qbin_sql
from .registry import R, query, r, rounded, view
from .texts import wilson_sql


def n_rows():
    return F.count(F.lit(1))


@query("bin_quantile", lift_sql(qbin_sql("v_scored", "lead", 5), "hit"))
def bin_quantile(spark, d):
    return lift_out(outcomes.lift_by(b.scored_cases(spark, d), "lead", "hit"))


def curve_sql(source: str, score: str, outcome: str, k: int, by: str = "") -> str:
    g = f"{by}, " if by else ""
    return f"""SELECT {g}bin, n, {R('rate')} AS rate, {R('mid')} AS mid, {R(wilson_sql('rate', 'n', '-'))} AS lo,
    {R(wilson_sql('rate', 'n', '+'))} AS hi FROM (SELECT {g}bin, count(*) AS n, avg(CAST({outcome} AS DOUBLE)) AS rate, avg({score}) AS mid
    FROM ({qbin_sql(source, score, k, by)}) GROUP BY {g}bin)"""


def curve_out(df):
    return rounded(df, "rate", "mid", "lo", "hi")


@query("bin_quantile_curve", curve_sql("v_scored", "level", "hit", 20))
def bin_quantile_curve(spark, d):
    return curve_out(binning.quantile_curve(b.scored_cases(spark, d), "level", "hit", 20))


@query(
    "bin_fixed_edges",
    f"""SELECT bin, count(*) AS n, {R('avg(lead)')} AS mean FROM (SELECT lead, CAST(CASE WHEN amount >= 0 AND amount < 50000 THEN 0
    WHEN amount >= 50000 AND amount < 150000 THEN 1 WHEN amount >= 150000 AND amount < 300000 THEN 2 END AS INTEGER) AS bin FROM v_scored)
    WHERE bin IS NOT NULL GROUP BY bin HAVING count(*) >= 50""",
)
def bin_fixed_edges(spark, d):
    s = binning.fixed_edges(b.scored_cases(spark, d), "amount", [0, 50000, 150000, 300000])
    s = s.filter(F.col("bin").isNotNull())
    return binning.bin_means(s, "lead", ["bin"], 50).select("bin", "n", r("mean").alias("mean"))


def linear_sql(source: str, x: str, k: int, by: str = "", extra: str = "") -> str:
    g, j = (f"{by}, ", f"USING ({by})") if by else ("", "ON true")
    grp = f"GROUP BY {by}" if by else ""
    return f"""SELECT *, lo + (bin + 0.5) * ((hi - lo) / {k}) AS centre FROM (SELECT s.*, q.lo, q.hi,
    CAST(least(floor(({x} - q.lo) / ((q.hi - q.lo) / {k})), {k} - 1) AS INTEGER) AS bin FROM {source} s JOIN
    (SELECT {g}quantile_cont({x}, 0.02) AS lo, quantile_cont({x}, 0.98) AS hi FROM {source} {grp}) q {j}
    WHERE {x} >= q.lo AND {x} < q.hi)"""


@query(
    "bin_linear_range",
    f"""SELECT bin, {R('max(centre)')} AS centre, count(*) AS n, {R('avg(lead)')} AS mean FROM ({linear_sql('v_scored', 'level', 10)})
    GROUP BY bin HAVING count(*) >= 30""",
)
def bin_linear_range(spark, d):
    s = binning.linear_bin(b.scored_cases(spark, d), "level", 10)
    # the bootstrap interval is checked in the tests; the oracle has no such hash
    out = binning.bin_means(s, "lead", ["bin", "centre"], 30)
    return rounded(out, "centre", "mean")


view(
    "v_bins15",
    f"""SELECT cls, bin, max(centre) AS x, avg(CAST(hit AS DOUBLE)) AS y FROM ({linear_sql('v_scored', 'level', 15, 'cls')})
    GROUP BY cls, bin HAVING count(*) >= 10""",
)


@query(
    "bin_shape_metrics",
    f"""WITH p AS (SELECT cls, x AS px FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY y DESC, x) AS rn FROM v_bins15) WHERE rn = 1),
    m AS (SELECT cls, avg(x) AS mx, min(x) AS x0, max(x) AS x1 FROM v_bins15 GROUP BY cls),
    j AS (SELECT b.*, p.px, m.x0, m.x1, b.x - m.mx AS c FROM v_bins15 b JOIN p USING (cls) JOIN m USING (cls)),
    s AS (SELECT cls, count(*) AS n, sum(c) AS s1, sum(c*c) AS s2, sum(c*c*c) AS s3, sum(c*c*c*c) AS s4, sum(y) AS t0, sum(c*y) AS t1, sum(c*c*y) AS t2,
      max(y) AS y_max, max(px) AS argmax, max((px - x0) / (x1 - x0)) AS argmax_pos, arg_min(y, x) AS yl, arg_max(y, x) AS yh,
      coalesce(regr_slope(y, x) FILTER (WHERE x <= px), 0) AS sl, coalesce(regr_slope(y, x) FILTER (WHERE x >= px), 0) AS sr, regr_slope(y, x) AS so
      FROM j GROUP BY cls)
    SELECT cls, n AS n_bins, {R('y_max')} AS y_max, {R('argmax')} AS argmax, {R('argmax_pos')} AS argmax_pos, {R('yl')} AS y_at_low, {R('yh')} AS y_at_high,
    {R('sl', 5)} AS slope_left, {R('sr', 5)} AS slope_right, {R('so', 5)} AS overall_slope,
    {R('(n*(s2*t2-s3*t1) - s1*(s1*t2-s3*t0) + s2*(s1*t1-s2*t0)) / (n*(s2*s4-s3*s3) - s1*(s1*s4-s3*s2) + s2*(s1*s3-s2*s2))', 4)} AS curvature
    FROM s WHERE n >= 5""",
)
def bin_shape_metrics(spark, d):
    s = binning.linear_bin(b.scored_cases(spark, d), "level", 15, by=["cls"], centre="x")
    bins = s.groupBy("cls", "x").agg(n_rows().alias("n"), F.avg(F.col("hit").cast("double")).alias("y"))
    out = binning.curve_shape(bins.filter(F.col("n") >= 10), "x", "y", ["cls"])
    out = rounded(out, "y_max", "argmax", "argmax_pos", "y_at_low", "y_at_high")
    out = rounded(out, "slope_left", "slope_right", "overall_slope", digits=5)
    return rounded(out, "curvature", digits=4)


@query(
    "bin_2d_grid",
    f"""WITH q AS (SELECT quantile_cont(kl_past, 0.02) AS x0, quantile_cont(kl_past, 0.98) AS x1, quantile_cont(kl_future, 0.02) AS y0,
      quantile_cont(kl_future, 0.98) AS y1 FROM v_scored)
    SELECT gx, gy, count(*) AS n, {R('avg(CAST(hit AS DOUBLE))')} AS mean FROM (
    SELECT CAST(least(floor((kl_past - x0) / (x1 - x0) * 36), 35) AS INTEGER) AS gx, CAST(least(floor((kl_future - y0) / (y1 - y0) * 36), 35) AS INTEGER) AS gy, hit
    FROM v_scored, q WHERE kl_past BETWEEN x0 AND x1 AND kl_future BETWEEN y0 AND y1) GROUP BY 1, 2""",
)
def bin_2d_grid(spark, d):
    out = binning.grid(b.scored_cases(spark, d), "kl_past", "kl_future", "hit", 36)
    return rounded(out, "mean")


_ABS = "(SELECT *, abs(lead) AS abs_lead FROM v_scored)"


@query(
    "bin_cross_quintile",
    f"""SELECT bl, bm, count(*) AS n, {R('avg(CAST(hit AS DOUBLE))')} AS rate
    FROM ({qbin_sql('(' + qbin_sql(_ABS, 'level', 5, '', 'bl') + ')', 'abs_lead', 5, '', 'bm')}) GROUP BY 1, 2""",
)
def bin_cross_quintile(spark, d):
    s = b.scored_cases(spark, d).withColumn("abs_lead", F.abs("lead"))
    s = ranking.quantile_bin(s, "level", 5, out="bl")
    s = ranking.quantile_bin(s, "abs_lead", 5, out="bm")
    return s.groupBy("bl", "bm").agg(
        n_rows().alias("n"), r(F.avg(F.col("hit").cast("double"))).alias("rate")
    )


@query(
    "corner_penalty",
    f"""WITH q AS (SELECT quantile_cont(kl_past, 0.25) AS x25, quantile_cont(kl_future, 0.25) AS y25, quantile_cont(kl_past, 0.1) AS x10,
      quantile_cont(kl_future, 0.1) AS y10 FROM v_scored),
    f AS (SELECT CAST(hit AS DOUBLE) AS y, kl_past < x25 AND kl_future < y25 AS c25, kl_past < x10 AND kl_future < y10 AS c10 FROM v_scored, q),
    a AS (SELECT count(*) AS n, avg(y) FILTER (WHERE NOT c25) AS rest, count(*) FILTER (WHERE c25) AS n_25, avg(y) FILTER (WHERE c25) AS r25,
      count(*) FILTER (WHERE c10) AS n_10, avg(y) FILTER (WHERE c10) AS r10 FROM f)
    SELECT n, {R('rest')} AS rest, n_25, {R('r25')} AS rate_25, n_10, {R('r10')} AS rate_10, {R('rest - r25')} AS penalty_25, {R('rest - r10')} AS penalty_10 FROM a""",
)
def corner_penalty(spark, d):
    out = binning.corner_penalty(b.scored_cases(spark, d), "kl_past", "kl_future", "hit")
    return rounded(out, "rest", "rate_25", "rate_10", "penalty_25", "penalty_10")


@query("sort_multi", "SELECT cls, year, count(*) AS n FROM v_cases GROUP BY 1, 2")
def sort_multi(spark, d):
    g = b.cases(spark, d).groupBy("cls", "year").agg(n_rows().alias("n"))
    return g.orderBy("cls", F.desc("n"), "year")


@query(
    "limit_topk",
    f"SELECT owner, {R('sum(amount)', 2)} AS total FROM v_cases GROUP BY owner ORDER BY sum(amount) DESC, owner LIMIT 20",
)
def limit_topk(spark, d):
    g = b.cases(spark, d).groupBy("owner").agg(r(F.sum("amount"), 2).alias("total"))
    return g.orderBy(F.desc("total"), "owner").limit(20)


@query(
    "set_union",
    "SELECT c_custkey AS k, c_name AS name, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier",
)
def set_union(spark, d):
    c = b.table(spark, d, "customer").select(
        F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.lit("customer").alias("kind")
    )
    s = b.table(spark, d, "supplier").select(
        F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")
    )
    return c.unionByName(s)


@query(
    "set_distinct_keyed",
    """SELECT case_id, code, happened FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY code, happened, seq) AS rn FROM v_events)
    WHERE rn = 1""",
)
def set_distinct_keyed(spark, d):
    first = F.min(F.struct("code", "happened", "seq")).alias("f")
    g = b.case_events(spark, d).groupBy("case_id").agg(first)
    return g.select("case_id", "f.code", "f.happened")


@query(
    "set_difference",
    "SELECT DISTINCT term FROM v_short_terms WHERE cls = 'Brand#1' EXCEPT SELECT term FROM v_short_terms WHERE cls = 'Brand#2'",
)
def set_difference(spark, d):
    t = b.doc_terms(spark, d, b.short_corpus(spark, d))
    one, two = (t.filter(F.col("cls") == c).select("term") for c in ("Brand#1", "Brand#2"))
    return one.distinct().join(two, "term", "left_anti")


@query(
    "set_intersection_counts",
    """WITH o AS (SELECT DISTINCT cls, owner FROM v_cases) SELECT a.cls AS a, c.cls AS b, count(*) AS n_shared
    FROM o a JOIN o c ON a.owner = c.owner AND a.cls < c.cls GROUP BY 1, 2""",
)
def set_intersection_counts(spark, d):
    from ..operators.emergence import overlap_counts

    return overlap_counts(b.cases(spark, d), "owner", "cls")


@query(
    "dedup_factor",
    f"""WITH b AS ({qbin_sql('v_scored', 'lead', 5)}),
    s AS (SELECT avg(CAST(hit AS DOUBLE)) FILTER (WHERE bin = 5) AS ph, avg(CAST(hit AS DOUBLE)) FILTER (WHERE bin = 1) AS pl,
      count(*) FILTER (WHERE bin = 5) AS nh, count(*) FILTER (WHERE bin = 1) AS nl FROM b),
    i AS (SELECT owner, sum(CASE WHEN bin = 5 THEN (CAST(hit AS DOUBLE) - ph) / nh WHEN bin = 1 THEN -(CAST(hit AS DOUBLE) - pl) / nl ELSE 0 END) AS s,
      count(*) AS m FROM b, s GROUP BY owner)
    SELECT CAST(sum(m) AS BIGINT) AS n_rows, count(*) AS n_keys, {R('(SELECT ph - pl FROM s)')} AS lift, {R('sqrt(sum(s * s))')} AS cluster_se FROM i""",
)
def dedup_factor(spark, d):
    out = binning.clustered_contrast(b.scored_cases(spark, d), "lead", "hit", "owner")
    return rounded(out, "lift", "cluster_se")


# --- scalars ---------------------------------------------------------------


@query(
    "scalar_string",
    """SELECT c_custkey, upper(c_name) AS up, lower(c_name) AS low, CAST(length(c_name) AS INTEGER) AS len, substr(c_name, 1, 4) AS head,
    lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS z, starts_with(c_name, 'Cust') AS st, regexp_matches(c_name, '7$') AS ends7,
    regexp_replace(c_name, '[0#]+', '-', 'g') AS rep, c_mktsegment || '_' || c_nationkey AS cell FROM customer""",
)
def scalar_string(spark, d):
    n = F.col("c_name")
    return b.table(spark, d, "customer").select(
        "c_custkey", F.upper(n).alias("up"), F.lower(n).alias("low"), F.length(n).alias("len"),
        F.substring(n, 1, 4).alias("head"),
        F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("z"),
        n.startswith("Cust").alias("st"), n.rlike("7$").alias("ends7"),
        F.regexp_replace(n, "[0#]+", "-").alias("rep"),
        F.format_string("%s_%s", "c_mktsegment", "c_nationkey").alias("cell"),
    )


@query(
    "scalar_date",
    """SELECT case_id, CAST(try_strptime(CASE WHEN case_id % 7 = 0 THEN '19951399' ELSE strftime(filed, '%Y%m%d') END, '%Y%m%d') AS DATE) AS parsed,
    year, CAST(month(filed) AS INTEGER) AS month, CAST(date_diff('day', DATE '1995-01-01', filed) AS INTEGER) AS age, CAST(filed + 90 AS DATE) AS later,
    strftime(filed, '%Y') AS prefix FROM v_cases""",
)
def scalar_date(spark, d):
    compact = F.when(F.col("case_id") % 7 == 0, "19951399").otherwise(F.date_format("filed", "yyyyMMdd"))
    return b.cases(spark, d).select(
        "case_id", parse_compact_date(compact).alias("parsed"), "year",
        F.month("filed").alias("month"),
        F.datediff("filed", F.lit("1995-01-01").cast("date")).alias("age"),
        F.date_add("filed", 90).alias("later"),
        F.substring(F.date_format("filed", "yyyyMMdd"), 1, 4).alias("prefix"),
    )


@query(
    "scalar_math",
    f"""SELECT case_id, {R('ln(amount)')} AS a, {R('ln(1 + amount)')} AS b, {R('log10(amount)')} AS c, {R('exp(-lead)')} AS e, abs(lead) + CAST(0 AS DOUBLE) AS f,
    CAST(sign(lead) AS INTEGER) AS g, {R('pow(lead, 2)')} AS h, greatest(CAST(-0.5 AS DOUBLE), least(CAST(0.5 AS DOUBLE), lead)) AS i, CAST(case_id // 7 AS BIGINT) AS j FROM v_scored""",
)
def scalar_math(spark, d):
    x = F.col("lead")
    return b.scored_cases(spark, d).select(
        "case_id", r(F.ln("amount")).alias("a"), r(F.log1p("amount")).alias("b"),
        r(F.log10("amount")).alias("c"), r(F.exp(-x)).alias("e"), F.abs(x).alias("f"),
        F.signum(x).cast("int").alias("g"), r(F.pow(x, F.lit(2))).alias("h"),
        clip(x, -0.5, 0.5).alias("i"), F.expr("case_id div 7").alias("j"),
    )


@query(
    "scalar_conditional",
    """SELECT case_id, CASE WHEN amount > 400000 THEN 'large' WHEN amount > 100000 THEN 'mid' ELSE 'small' END AS size,
    coalesce(nullif(cls, '3-MEDIUM'), 'none') AS cls2, status IN ('700', '800') AS inset, amount BETWEEN 1000 AND 200000 AS btw,
    TRY_CAST(substr(cls, 1, 1) AS INTEGER) AS num, TRY_CAST(cls AS INTEGER) IS NOT NULL AS finite FROM v_cases""",
)
def scalar_conditional(spark, d):
    a, c = F.col("amount"), F.col("cls")
    return b.cases(spark, d).select(
        "case_id",
        F.when(a > 400000, "large").when(a > 100000, "mid").otherwise("small").alias("size"),
        F.coalesce(F.nullif(c, F.lit("3-MEDIUM")), F.lit("none")).alias("cls2"),
        F.col("status").isin("700", "800").alias("inset"), a.between(1000, 200000).alias("btw"),
        F.substring(c, 1, 1).try_cast("int").alias("num"),
        c.try_cast("int").isNotNull().alias("finite"),
    )


@query(
    "scalar_array",
    """SELECT owner, array_to_string(list_sort(list_distinct(list(cls))), '|') AS classes, CAST(len(list_distinct(list(cls))) AS INTEGER) AS n_classes,
    list_contains(list(cls), '1-URGENT') AS has_urgent FROM v_cases GROUP BY owner""",
)
def scalar_array(spark, d):
    # distinct inside the aggregate: the array holds one entry per class
    g = b.cases(spark, d).groupBy("owner").agg(F.collect_set("cls").alias("c"))
    arr = F.array_sort(F.array_distinct("c"))
    return g.select(
        "owner", F.array_join(arr, "|").alias("classes"), F.size(arr).alias("n_classes"),
        F.array_contains("c", "1-URGENT").alias("has_urgent"),
    )


@query(
    "scalar_winsorise",
    f"""SELECT case_id, {R('greatest(lo, least(hi, lead))', 9)} AS lead_w FROM v_scored,
    (SELECT quantile_cont(lead, 0.01) AS lo, quantile_cont(lead, 0.99) AS hi FROM v_scored)""",
)
def scalar_winsorise(spark, d):
    out = binning.winsorise(b.scored_cases(spark, d), "lead", out="lead_w")
    return out.select("case_id", r("lead_w", 9).alias("lead_w"))


@query(
    "scalar_ratio_guards",
    f"SELECT l_orderkey, l_linenumber, {R('l_extendedprice / nullif(l_discount * 100, 0)', 6)} AS ratio FROM lineitem WHERE l_extendedprice / nullif(l_discount * 100, 0) BETWEEN 1 AND 20000",
)
def scalar_ratio_guards(spark, d):
    x = ratio(F.col("l_extendedprice"), F.col("l_discount") * 100)
    lines = b.table(spark, d, "lineitem").filter(x.between(1, 20000))
    return lines.select("l_orderkey", "l_linenumber", r(x, 6).alias("ratio"))
