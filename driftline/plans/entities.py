"""Entity resolution, panel and external-comparison queries."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import names
from ..functions.scalars import correlation, share, wilson_bounds
from ..operators import binning, entities, firms, inference, outcomes, panels, ranking
from . import bindings as b
from .bins import curve_out, curve_sql, linear_sql, n_rows
from .lifecycle import gated, lift_out, lift_sql, qbin_sql
from .registry import R, query, r, rounded, view
from .relational import mid_rank_sql, owner_year
from .texts import SUFFIX_SQL, owner_names, strong_sql, wilson_sql


def owners(spark, d):
    rows = b.cases(spark, d).join(owner_names(spark, d).withColumnRenamed("k", "owner"), "owner")
    return entities.owner_universe(rows)


view(
    "v_owners",
    f"""SELECT name, count(DISTINCT case_id) AS n_filings, min(year) AS first_year, max(year) AS last_year, {strong_sql('name')} AS norm
    FROM v_cases JOIN v_names ON k = owner GROUP BY name""",
)


def lookup(spark, d):
    """External names from two sources; some resolve to two ids."""
    c = b.table(spark, d, "customer")
    k = F.col("c_custkey")
    one = c.filter(k % 3 == 0).select(k.alias("cik"), F.concat("c_name", F.lit(" INC")).alias("entity"))
    two = c.filter(k % 2 == 0).select(
        (k + F.when(k % 5 == 0, 1000000).otherwise(0)).alias("cik"), F.concat(F.lit("The "), "c_name", F.lit(", Ltd.")).alias("entity")
    )
    return one.unionByName(two).withColumn("norm", names.strong_key("entity"))


view(
    "v_lookup",
    f"""SELECT cik, entity, {strong_sql('entity')} AS norm FROM (SELECT c_custkey AS cik, c_name || ' INC' AS entity FROM customer WHERE c_custkey % 3 = 0
    UNION ALL SELECT c_custkey + CASE WHEN c_custkey % 5 = 0 THEN 1000000 ELSE 0 END, 'The ' || c_name || ', Ltd.' FROM customer WHERE c_custkey % 2 = 0)""",
)
view(
    "v_xwalk",
    """SELECT o.*, l.cik, l.entity FROM v_owners o JOIN (SELECT norm, min(cik) AS cik, min(entity) AS entity FROM v_lookup WHERE length(norm) >= 3
    GROUP BY norm HAVING count(DISTINCT cik) = 1) l USING (norm) WHERE length(norm) >= 3""",
)


@query("owner_universe", "SELECT * FROM v_owners")
def owner_universe(spark, d):
    return owners(spark, d)


@query("crosswalk_exact", "SELECT name, norm, cik, entity, n_filings, first_year, last_year, 'exact' AS match_type FROM v_xwalk")
def crosswalk_exact(spark, d):
    return entities.crosswalk(owners(spark, d), lookup(spark, d))


@query("crosswalk_unmatched", "SELECT name, n_filings FROM v_owners WHERE name NOT IN (SELECT name FROM v_xwalk) AND n_filings >= 10 AND length(norm) >= 3")
def crosswalk_unmatched(spark, d):
    o = owners(spark, d)
    return entities.unmatched(o, entities.crosswalk(o, lookup(spark, d))).select("name", "n_filings")


@query("crosswalk_fuzzy")
def crosswalk_fuzzy(spark, d):
    """Nearest lookup names of the unmatched owners; buckets are hashes, so no SQL gives them."""
    o, names = owners(spark, d), lookup(spark, d)
    rest = b.stage(entities.unmatched(o, entities.crosswalk(o, names)), "names-unmatched")
    known = b.stage(names.select("norm").distinct(), "names-known")
    near = entities.nearest_fuzzy(rest, known, b.stage)
    return rest.select("name", "norm", "n_filings").join(near, "norm").select("name", "norm", "near", "edits", "rank")


@query(
    "match_rate_by_formality",
    f"""SELECT regexp_matches(upper(name), '{SUFFIX_SQL}') AS formal, count(*) AS n_owners, {R('avg(CAST(name IN (SELECT name FROM v_xwalk) AS DOUBLE))')} AS match_rate
    FROM v_owners GROUP BY 1""",
)
def match_rate_by_formality(spark, d):
    o = owners(spark, d)
    return rounded(entities.match_rate_by_formality(o, entities.crosswalk(o, lookup(spark, d))), "match_rate")


@query(
    "crosswalk_coverage",
    """SELECT count(*) AS n_owners, count(DISTINCT cik) AS n_ids, CAST(sum(n_filings) AS BIGINT) AS n_rows,
    count(*) FILTER (WHERE regexp_matches(entity, '(?i)^the .*1, ltd')) AS n_spot FROM v_xwalk""",
)
def crosswalk_coverage(spark, d):
    x = entities.crosswalk(owners(spark, d), lookup(spark, d))
    return x.agg(
        n_rows().alias("n_owners"), F.countDistinct("cik").alias("n_ids"), F.sum("n_filings").alias("n_rows"),
        F.count_if(F.col("entity").rlike("(?i)^the .*1, ltd")).alias("n_spot"),
    )


def offerings(spark, d):
    o = b.cases(spark, d)
    return o.select(
        F.col("case_id").alias("accession"), F.col("owner").alias("cik"),
        F.concat(F.lit("ISSUER "), (F.col("owner") % 120).cast("string"), F.when(F.col("owner") % 4 == 0, F.concat(F.lit("-"), F.col("owner"))).otherwise("")).alias("norm"),
        (F.col("cls") == "5-LOW").alias("is_pooled"), F.col("registered").alias("is_primary"),
        (F.col("cls") == "4-NOT SPECIFIED").alias("is_amend"), F.col("filed").alias("round_date"), F.col("amount").alias("total_sold"),
    )


view(
    "v_issuers",
    """WITH o AS (SELECT case_id, owner AS cik, 'ISSUER ' || (owner % 120) || CASE WHEN owner % 4 = 0 THEN '-' || owner ELSE '' END AS norm, cls, filed, amount FROM v_cases WHERE registered AND cls <> '5-LOW'),
    a AS (SELECT norm FROM o GROUP BY 1 HAVING count(DISTINCT cik) > 1)
    SELECT norm, arg_min(cik, (filed, case_id)) AS cik, min(filed) AS first_round, arg_min(amount, (filed, case_id)) AS first_amount, count(*) AS n_rounds
    FROM o WHERE cls <> '4-NOT SPECIFIED' AND norm NOT IN (SELECT norm FROM a) GROUP BY norm""",
)


@query("offering_operating_issuers", "SELECT * FROM v_issuers")
def offering_operating_issuers(spark, d):
    return entities.operating_issuers(offerings(spark, d))


def matched(spark, d):
    o = firms.debuts(b.cases(spark, d)).select(
        "owner", F.col("filed").alias("debut"),
        F.concat(F.lit("ISSUER "), (F.col("owner") % 120).cast("string"), F.lit("-"), F.col("owner")).alias("norm"),
    )
    xw = b.table(spark, d, "customer").filter(F.col("c_custkey") % 3 == 0).select(F.col("c_custkey").alias("owner"))
    ids = b.table(spark, d, "supplier").select(F.col("s_suppkey").alias("cik"))
    listed = b.case_events(spark, d).filter(F.col("code") == "RF").join(b.cases(spark, d).select("case_id", "owner"), "case_id")
    listed = listed.select(F.col("owner").alias("cik"), F.col("happened").alias("listed_on"))
    m = entities.funding_match(o, entities.operating_issuers(offerings(spark, d)), xw, ids, listed)
    return entities.require_unique(b.stage(m, "funding"), "owner")


view(
    "v_funding",
    """WITH o AS (SELECT owner, min(filed) AS debut, 'ISSUER ' || (owner % 120) || '-' || owner AS norm FROM v_cases GROUP BY owner),
    l AS (SELECT c.owner AS cik, min(happened) AS l FROM v_events e JOIN v_cases c USING (case_id) WHERE code = 'RF' GROUP BY 1),
    m AS (SELECT o.*, i.cik, i.first_round, i.first_amount, i.n_rounds, o.owner % 3 = 0 AND o.owner IN (SELECT c_custkey FROM customer) AS in_crosswalk, i.cik IN (SELECT s_suppkey FROM supplier) AS in_panel FROM o JOIN v_issuers i USING (norm))
    SELECT m.*, CASE WHEN in_crosswalk OR in_panel THEN l.l END AS listed_on, (in_crosswalk OR in_panel) AND l.l IS NOT NULL AS is_listed FROM m LEFT JOIN l USING (cik)""",
)


@query("funding_match", "SELECT * FROM v_funding")
def funding_match(spark, d):
    return matched(spark, d)


@query(
    "funding_lags",
    f"""SELECT CAST(year(debut) AS INTEGER) AS debut_year, count(*) AS n, {R("median(date_diff('day', debut, first_round) / 365.25)")} AS med_to_round,
    {R("median(date_diff('day', first_round, listed_on) / 365.25)")} AS med_to_listing FROM v_funding GROUP BY 1""",
)
def funding_lags(spark, d):
    m = entities.funding_lags(matched(spark, d)).withColumn("debut_year", F.year("debut"))
    out = m.groupBy("debut_year").agg(n_rows().alias("n"))
    for c in ("to_round", "to_listing"):
        q = ranking.quantiles(m, c, [0.5], ["debut_year"], [f"med_{c}"])
        out = out.join(rounded(q, f"med_{c}"), "debut_year", "left")
    return out


@query(
    "financial_firm_year",
    f"""WITH t AS (SELECT owner, year, arg_max(amount, (filed, case_id)) FILTER (WHERE cls = '1-URGENT') AS rev, arg_max(amount, (filed, case_id)) FILTER (WHERE cls = '5-LOW') AS cogs
      FROM v_cases WHERE registered GROUP BY 1, 2)
    SELECT owner, year, rev AS revenue, cogs, {R('rev - cogs', 2)} AS gross_profit, {R('(rev - cogs) / rev')} AS gross_margin FROM t WHERE rev IS NOT NULL""",
)
def financial_firm_year(spark, d):
    annual = b.cases(spark, d).filter("registered").groupBy("owner", "year", "cls").agg(
        F.max_by("amount", F.struct("filed", "case_id")).alias("v")
    )
    wide = annual.groupBy("owner", "year").pivot("cls", ["1-URGENT", "5-LOW"]).agg(F.max("v"))
    out = panels.derive_margin(wide, ["1-URGENT"], ["5-LOW"], [])
    out = rounded(rounded(out, "gross_profit", digits=2), "gross_margin")
    return out.select("owner", "year", "revenue", "cogs", "gross_profit", "gross_margin")


view("v_debut", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY filed, case_id) AS rn FROM v_scored) WHERE rn = 1")


@query("owner_debut", "SELECT owner, case_id, filed, cls FROM v_debut")
def owner_debut(spark, d):
    return firms.debuts(b.scored_cases(spark, d)).select("owner", "case_id", "filed", "cls")


@query(
    "first_doc_per_owner",
    "SELECT owner, case_id FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY filed, case_id) AS rn FROM v_scored WHERE n_terms >= 3) WHERE rn = 1",
)
def first_doc_per_owner(spark, d):
    return firms.debuts(b.scored_cases(spark, d).filter(F.col("n_terms") >= 3)).select("owner", "case_id")


@query("debut_counts", "SELECT CAST(year(filed) AS INTEGER) AS year, cls, count(*) AS n FROM v_debut GROUP BY 1, 2 UNION ALL SELECT CAST(year(filed) AS INTEGER), 'all', count(*) FROM v_debut GROUP BY 1")
def debut_counts(spark, d):
    x = firms.debuts(b.scored_cases(spark, d)).withColumn("year", F.year("filed"))
    per = x.groupBy("year", "cls").agg(n_rows().alias("n"))
    return per.unionByName(per.groupBy("year").agg(F.sum("n").alias("n")).withColumn("cls", F.lit("all")))


view("v_debut_flags", "SELECT *, filed = min(filed) OVER (PARTITION BY owner) AS is_debut FROM v_cases")


@query(
    "debut_share",
    f"""SELECT cls, year, count(*) AS n, {R('avg(CAST(is_debut AS DOUBLE))')} AS debut_share FROM v_debut_flags GROUP BY 1, 2
    UNION ALL SELECT 'all', year, count(*), {R('avg(CAST(is_debut AS DOUBLE))')} FROM v_debut_flags GROUP BY 2""",
)
def debut_share(spark, d):
    c = firms.debut_flags(b.cases(spark, d))
    aggs = [n_rows().alias("n"), r(share(F.col("is_debut"))).alias("debut_share")]
    pooled = c.groupBy("year").agg(*aggs).withColumn("cls", F.lit("all"))
    return c.groupBy("cls", "year").agg(*aggs).unionByName(pooled)


@query(
    "share_shift_decomposition",
    f"""WITH c AS (SELECT cls, year, count(*) AS n, count(*) FILTER (WHERE is_debut) / CAST(count(*) AS DOUBLE) AS s, count(*) / CAST(sum(count(*)) OVER (PARTITION BY year) AS DOUBLE) AS w FROM v_debut_flags GROUP BY 1, 2),
    l AS (SELECT cls, lag(w) OVER o * (s - lag(s) OVER o) AS i, lag(s) OVER o * (w - lag(w) OVER o) AS m FROM c WINDOW o AS (PARTITION BY cls ORDER BY year))
    SELECT cls, {R('sum(i)')} AS within, {R('sum(m)')} AS composition, {R('sum(i + m)')} AS total FROM l GROUP BY cls""",
)
def share_shift_decomposition(spark, d):
    c = firms.debut_flags(b.cases(spark, d)).groupBy("cls", "year").agg(n_rows().alias("n"), F.count_if("is_debut").alias("hits"))
    return rounded(firms.share_shift(c), "within", "composition", "total")


view("v_series", "SELECT year, count(*) AS n FROM v_cases GROUP BY 1")
view("v_ext", "SELECT CAST(year(happened) AS INTEGER) AS year, count(*) AS ext FROM v_events GROUP BY 1")


@query(
    "coverage_ratio",
    f"""WITH j AS (SELECT year, n, ext FROM v_series JOIN v_ext USING (year)), g AS (SELECT *, n - lag(n) OVER (ORDER BY year) AS dn, ext - lag(ext) OVER (ORDER BY year) AS de FROM j)
    SELECT year, n, ext, {R('n / CAST(ext AS DOUBLE)')} AS ratio, {R('(SELECT corr(n, ext) FROM g)')} AS corr_level, {R('(SELECT corr(dn, de) FROM g)')} AS corr_growth FROM j""",
)
def coverage_ratio(spark, d):
    own = b.cases(spark, d).groupBy("year").agg(n_rows().alias("n"))
    ext = b.case_events(spark, d).groupBy(F.year("happened").alias("year")).agg(n_rows().alias("ext"))
    s = firms.series_coverage(own, ext)
    c = firms.level_and_growth_corr(s)
    for x in ("corr_level", "corr_growth"):
        s = s.withColumn(x, c.select(x).scalar())
    return rounded(s, "ratio", "corr_level", "corr_growth")


@query(
    "stock_flow_series",
    f"""SELECT year, count(DISTINCT owner) AS active, count(DISTINCT owner) FILTER (WHERE is_debut) AS entrants,
    {R('count(DISTINCT owner) FILTER (WHERE is_debut) / CAST(count(DISTINCT owner) AS DOUBLE)')} AS entry_rate FROM v_debut_flags GROUP BY year""",
)
def stock_flow_series(spark, d):
    c = firms.debut_flags(b.cases(spark, d)).groupBy("year", "owner").agg(F.bool_or("is_debut").alias("new"))
    g = c.groupBy("year").agg(n_rows().alias("active"), F.count_if("new").alias("entrants"))
    return g.withColumn("entry_rate", r(F.col("entrants") / F.col("active")))


@query(
    "owner_scale_strata",
    f"""WITH s AS (SELECT *, count(*) OVER (PARTITION BY owner) AS k, (SELECT median(level) FROM v_scored) AS med FROM v_scored)
    SELECT CASE WHEN k <= 8 THEN 'small' ELSE 'large' END AS size, CASE WHEN level > med THEN 'high' ELSE 'low' END AS band, count(*) AS n,
    {R('avg(lead)')} AS mean_lead, {R('avg(CAST(hit AS DOUBLE))')} AS rate FROM s WHERE k <= 8 OR k >= 12 GROUP BY 1, 2""",
)
def owner_scale_strata(spark, d):
    out = firms.scale_strata(b.scored_cases(spark, d), 8, 12, F.col("hit"))
    return rounded(out, "mean_lead", "rate")


view(
    "v_div",
    """SELECT *, CASE WHEN n_classes = 1 THEN 'single' WHEN n_classes <= 3 THEN '2-3' ELSE '4+' END AS tier FROM (
    SELECT owner, count(*) AS n, count(DISTINCT cls) AS n_classes, arg_min(cls, (filed, case_id)) AS debut_cls, avg(lead) AS mean_lead, stddev_samp(lead) AS sd_lead,
    avg(CAST(hit AS DOUBLE)) AS rate FROM v_scored GROUP BY owner)""",
)


@query("diversification", f"SELECT owner, n, n_classes, debut_cls, tier, {R('mean_lead')} AS mean_lead, {R('sd_lead')} AS sd_lead FROM v_div")
def diversification(spark, d):
    return rounded(firms.diversification(b.scored_cases(spark, d)), "mean_lead", "sd_lead")


def probabilities(spark, d):
    """P(region | market segment) from the customer table: a name-probability stand-in."""
    nation = b.table(spark, d, "nation").join(
        b.table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey"
    )
    c = b.table(spark, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey").join(nation, "n_nationkey")
    n = c.groupBy(F.col("c_mktsegment").alias("segment"), F.col("r_name").alias("category")).agg(n_rows().alias("_n"))
    tot = n.groupBy("segment").agg(F.sum("_n").alias("_t"))
    return n.join(tot, "segment").select("segment", "category", (F.col("_n") / F.col("_t")).alias("p"))


def segmented(spark, d):
    c = b.table(spark, d, "customer").select(F.col("c_custkey").alias("owner"), F.col("c_mktsegment").alias("segment"))
    return b.scored_cases(spark, d).join(c, "owner")


view(
    "v_prob",
    """SELECT c_mktsegment AS segment, r_name AS category, count(*) / CAST(sum(count(*)) OVER (PARTITION BY c_mktsegment) AS DOUBLE) AS p
    FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2""",
)
view("v_seg", "SELECT s.*, c_mktsegment AS segment FROM v_scored s JOIN customer ON c_custkey = owner")


@query(
    "name_category_weights",
    f"""SELECT year, cls, category, {R('sum(p)', 4)} AS weight, {R('sum(p) / sum(sum(p)) OVER (PARTITION BY year, cls)')} AS share FROM v_seg JOIN v_prob USING (segment) GROUP BY 1, 2, 3""",
)
def name_category_weights(spark, d):
    out = entities.category_weights(probabilities(spark, d), segmented(spark, d), "segment", ["year", "cls"])
    return rounded(rounded(out, "weight", digits=4), "share")


@query(
    "category_mix_within",
    f"""WITH t AS (SELECT s.year, category, CASE WHEN amount > 250000 THEN 'large' ELSE 'small' END AS tier, sum(p) AS w FROM v_seg s JOIN v_prob USING (segment) GROUP BY 1, 2, 3)
    SELECT year, category, tier, {R('w / sum(w) OVER (PARTITION BY year, category)')} AS mix FROM t""",
)
def category_mix_within(spark, d):
    s = segmented(spark, d).withColumn("tier", F.when(F.col("amount") > 250000, "large").otherwise("small"))
    w = entities.category_weights(probabilities(spark, d), s, "segment", ["year", "tier"]).drop("share")
    tot = w.groupBy("year", "category").agg(F.sum("weight").alias("_t"))
    return w.join(tot, ["year", "category"]).select("year", "category", "tier", r(F.col("weight") / F.col("_t")).alias("mix"))


@query(
    "category_cell_means",
    f"SELECT cls, category, {R('sum(p)', 4)} AS n_eff, {R('sum(p * lead) / sum(p)')} AS mean FROM v_seg JOIN v_prob USING (segment) GROUP BY 1, 2",
)
def category_cell_means(spark, d):
    out = entities.category_means(probabilities(spark, d), segmented(spark, d), "segment", ["cls"], "lead")
    return rounded(rounded(out, "n_eff", digits=4), "mean")


@query(
    "argmax_category",
    "SELECT segment, CASE WHEN max(p) >= 0.22 THEN arg_max(category, (p, category)) ELSE 'Mixed' END AS category FROM v_prob GROUP BY segment",
)
def argmax_category(spark, d):
    return entities.likeliest_category(probabilities(spark, d), "segment", 0.22)


view(
    "v_items",
    "SELECT l_suppkey AS firm, CAST(year(l_shipdate) AS INTEGER) AS year, count(DISTINCT l_partkey) AS n_items FROM lineitem GROUP BY 1, 2",
)
view(
    "v_firm_panel",
    """SELECT s.owner % (SELECT count(*) FROM supplier) AS firm, s.year, avg(lead) AS lead FROM v_scored s GROUP BY 1, 2""",
)


def item_panel(spark, d):
    lines = b.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("firm"), F.year("l_shipdate").alias("year"), "l_partkey")
    items = firms.distinct_items_per_year(lines, "firm", "l_partkey")
    n = b.table(spark, d, "supplier").agg(n_rows()).scalar()
    s = b.scored_cases(spark, d).withColumn("firm", F.col("owner") % n)
    return s.groupBy("firm", "year").agg(F.avg("lead").alias("lead")).join(items, ["firm", "year"])


@query(
    "patent_firm_year",
    f"""WITH j AS (SELECT * FROM v_firm_panel JOIN v_items USING (firm, year)), f AS (SELECT firm, avg(lead) AS l, avg(n_items) AS n FROM j GROUP BY 1)
    SELECT count(*) AS n, {R('corr(lead, n_items)')} AS corr_raw, {R('corr(lead, ln(1 + n_items))')} AS corr_log, {R('(SELECT corr(l, n) FROM f)')} AS corr_firm FROM j""",
)
def patent_firm_year(spark, d):
    j = item_panel(spark, d)
    f = j.groupBy("firm").agg(F.avg("lead").alias("l"), F.avg("n_items").alias("n"))
    out = j.agg(n_rows().alias("n"), correlation("lead", F.col("n_items").cast("double")).alias("corr_raw"), correlation("lead", F.log1p("n_items")).alias("corr_log"))
    out = out.withColumn("corr_firm", f.agg(correlation("l", "n")).scalar())
    return rounded(out, "corr_raw", "corr_log", "corr_firm")


@query(
    "list_membership_contrast",
    f"""WITH f AS (SELECT owner, avg(lead) AS m, owner IN (SELECT c_custkey FROM customer WHERE c_acctbal > 8000) AS l FROM v_scored GROUP BY 1),
    s AS (SELECT count(*) FILTER (WHERE l) AS n_on, count(*) FILTER (WHERE NOT l) AS n_off, avg(m) FILTER (WHERE l) AS a, avg(m) FILTER (WHERE NOT l) AS z, stddev_samp(m) FILTER (WHERE NOT l) AS sd FROM f)
    SELECT n_on, n_off, {R('a')} AS mean_on, {R('z')} AS mean_off, {R('(a - z) / sd', 5)} AS gap_sd, {R('(a - z) / (sd / sqrt(n_on))', 5)} AS z FROM s""",
)
def list_membership_contrast(spark, d):
    listed = b.table(spark, d, "customer").filter(F.col("c_acctbal") > 8000).select(F.col("c_custkey").alias("owner"), F.lit(True).alias("on"))
    f = b.scored_cases(spark, d).groupBy("owner").agg(F.avg("lead").alias("m")).join(listed, "owner", "left")
    out = firms.membership_contrast(f, "m", F.coalesce("on", F.lit(False)))
    return rounded(rounded(out, "mean_on", "mean_off"), "gap_sd", "z", digits=5)


@query(
    "rank_sum_test",
    f"""WITH k AS (SELECT hit, CAST({mid_rank_sql('n_terms')} AS DOUBLE) AS rk FROM v_scored), t AS (SELECT sum(CAST(c AS DOUBLE) * c * c - c) AS ties FROM (SELECT count(*) AS c FROM v_scored GROUP BY n_terms)),
    s AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE hit) AS DOUBLE) AS a, sum(rk) FILTER (WHERE hit) AS r FROM k)
    SELECT CAST(a AS BIGINT) AS n_a, CAST(n - a AS BIGINT) AS n_b, r - a * (a + 1) / 2 AS u,
    {R('(r - a * (a + 1) / 2 - a * (n - a) / 2) / sqrt(a * (n - a) / 12 * ((n + 1) - ties / (n * (n - 1))))', 5)} AS z FROM s, t""",
)
def rank_sum_test(spark, d):
    return rounded(inference.rank_sum(b.scored_cases(spark, d), "n_terms", "hit"), "z", digits=5)


ENTITIES = {"ones": "1$", "double": "([0-9])0$", "hundred": "Customer#0+1[0-9][0-9]$"}


@query(
    "named_entity_profile",
    "WITH s AS (SELECT v.*, c_name FROM v_scored v JOIN customer ON c_custkey = owner) "
    + " UNION ALL ".join(
        f"""SELECT '{n}' AS entity, count(*) AS n, {R('avg(lead)')} AS mean, arg_min(case_id, (filed, case_id)) AS first_record, {R('avg(lead) - (SELECT median(lead) FROM s)')} AS vs_median
        FROM s WHERE regexp_matches(c_name, '{p}')""" for n, p in ENTITIES.items()
    ),
)
def named_entity_profile(spark, d):
    c = b.table(spark, d, "customer").select(F.col("c_custkey").alias("owner"), "c_name")
    s = b.scored_cases(spark, d).join(c, "owner")
    med = ranking.quantiles(s, "lead", [0.5], (), ["m"]).scalar()
    out = entities.named_profiles(s, "c_name", ENTITIES, "lead", "case_id", ["filed", "case_id"])
    return rounded(out.withColumn("vs_median", F.col("mean") - med), "mean", "vs_median")


@query(
    "class_summary",
    f"""WITH t AS (SELECT cls, string_agg(CAST(owner AS VARCHAR), ',' ORDER BY rn) AS top_owners FROM (SELECT cls, owner, row_number() OVER (PARTITION BY cls ORDER BY count(*) DESC, owner) AS rn FROM v_scored GROUP BY 1, 2) WHERE rn <= 3 GROUP BY 1),
    x AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY lead DESC, case_id) AS hi, row_number() OVER (PARTITION BY cls ORDER BY lead, case_id) AS lo FROM v_scored)
    SELECT s.cls, count(*) AS n, count(DISTINCT s.owner) AS n_owners, min(year) AS first_year, max(year) AS last_year, {R('avg(lead)')} AS mean_lead, {R('avg(level)')} AS mean_level,
    {R('avg(CAST(hit AS DOUBLE))')} AS rate, max(t.top_owners) AS top_owners, string_agg(CAST(case_id AS VARCHAR), ',' ORDER BY hi) FILTER (WHERE hi <= 3) AS highest,
    string_agg(CAST(case_id AS VARCHAR), ',' ORDER BY lo) FILTER (WHERE lo <= 3) AS lowest FROM x s JOIN t ON t.cls = s.cls GROUP BY 1""",
)
def class_summary(spark, d):
    return rounded(firms.class_summary(b.scored_cases(spark, d), F.col("hit")), "mean_lead", "mean_level", "rate")


view("v_cell", "SELECT cls, year, avg(lead) AS m, median(amount) AS f FROM v_scored GROUP BY 1, 2")


@query(
    "class_vs_finance",
    f"""SELECT count(*) AS n, {R('corr(m, f)')} AS pearson, {R('corr(rx, ry)')} AS spearman FROM (SELECT m, f, CAST({mid_rank_sql('m')} AS DOUBLE) AS rx, CAST({mid_rank_sql('f')} AS DOUBLE) AS ry FROM v_cell)""",
)
def class_vs_finance(spark, d):
    s = b.scored_cases(spark, d)
    cell = s.groupBy("cls", "year").agg(F.avg("lead").alias("m"))
    cell = b.stage(cell.join(ranking.quantiles(s, "amount", [0.5], ["cls", "year"], ["f"]), ["cls", "year"]), "cells")
    out = ranking.spearman(cell, "m", "f", out="spearman").withColumn("pearson", cell.agg(correlation("m", "f")).scalar())
    return rounded(out, "pearson", "spearman")


view("v_portfolio", "SELECT owner, log10(count(*)) AS log_n, log10(max(amount)) AS log_value FROM v_scored GROUP BY 1")


@query(
    "portfolio_size_vs_value",
    f"""SELECT bin, count(*) AS n, {R('avg(log_n)')} AS mean_size, {R('(SELECT corr(log_n, log_value) FROM v_portfolio)')} AS rho FROM ({qbin_sql('v_portfolio', 'log_value', 10)}) GROUP BY bin""",
)
def portfolio_size_vs_value(spark, d):
    p = b.scored_cases(spark, d).groupBy("owner").agg(F.log10(n_rows()).alias("log_n"), F.log10(F.max("amount")).alias("log_value"))
    p = b.stage(p, "portfolio")
    g = ranking.quantile_bin(p, "log_value", 10).groupBy("bin").agg(n_rows().alias("n"), r(F.avg("log_n")).alias("mean_size"))
    return g.withColumn("rho", r(p.agg(correlation("log_n", "log_value")).scalar()))


view("v_own_lead", "SELECT owner, avg(lead) AS m, max(amount) > 450000 AS listed FROM v_scored GROUP BY owner HAVING count(*) >= 3")


@query(
    "ever_listed_by_bin",
    f"""SELECT bin, n, {R('p')} AS rate, {R(wilson_sql('p', 'n', '-'))} AS lo, {R(wilson_sql('p', 'n', '+'))} AS hi FROM (SELECT bin, count(*) AS n, avg(CAST(listed AS DOUBLE)) AS p FROM (
    SELECT *, CAST(least(floor(row_number() OVER (ORDER BY m, owner) * 5 / (count(*) OVER ())), 4) AS INTEGER) AS bin FROM v_own_lead) GROUP BY bin)""",
)
def ever_listed_by_bin(spark, d):
    o = b.scored_cases(spark, d).groupBy("owner").agg(n_rows().alias("k"), F.avg("lead").alias("m"), (F.max("amount") > 450000).alias("listed"))
    o = b.stage(o.filter(F.col("k") >= 3), "owner_lead")
    g = ranking.percent_bin(o, "m", "owner", 5).groupBy("bin").agg(n_rows().alias("n"), share(F.col("listed")).alias("rate"))
    lo, hi = wilson_bounds(F.col("rate"), F.col("n"))
    return rounded(g.withColumn("lo", lo).withColumn("hi", hi), "rate", "lo", "hi")


def curves(rows, scores, outs, ks):
    out = None
    for s in scores:
        for o in outs:
            for k in ks:
                c = curve_out(binning.quantile_curve(rows, s, o, k)).select(
                    F.lit(s).alias("score"), F.lit(o).alias("outcome"), F.lit(k).alias("k"), "*"
                )
                out = c if out is None else out.unionByName(c)
    return out


def curves_sql(source, scores, outs, ks):
    return " UNION ALL ".join(
        f"SELECT '{s}' AS score, '{o}' AS outcome, {k} AS k, * FROM ({curve_sql(source, s, o, k)})" for s in scores for o in outs for k in ks
    )


view("v_debut_out", "SELECT *, amount > 300000 AS listed FROM v_debut")


@query("debut_outcome_curves", curves_sql("v_debut_out", ["lead", "level"], ["registered", "listed"], [5, 20]))
def debut_outcome_curves(spark, d):
    x = firms.debuts(b.scored_cases(spark, d)).withColumn("listed", F.col("amount") > 300000)
    return curves(b.stage(x, "debut"), ["lead", "level"], ["registered", "listed"], [5, 20])


view("v_three", "SELECT *, NOT failed AS survived, amount > 300000 AS listed FROM v_gated")


@query("outcome_curves_three", curves_sql("v_three", ["kl_past", "kl_future"], ["registered", "survived", "listed"], [10]))
def outcome_curves_three(spark, d):
    g = gated(spark, d).withColumn("survived", ~F.col("failed")).withColumn("listed", F.col("amount") > 300000)
    return curves(b.stage(g, "three"), ["kl_past", "kl_future"], ["registered", "survived", "listed"], [10])


view("v_own_mean", "SELECT owner, avg(kl_past) AS kl_past, avg(kl_future) AS kl_future, avg(CAST(hit AS DOUBLE)) AS y FROM v_scored GROUP BY 1 HAVING count(*) >= 3")
view("v_row_mean", "SELECT kl_past, kl_future, CAST(hit AS DOUBLE) AS y FROM v_scored")


@query(
    "outcome_by_both_scores",
    " UNION ALL ".join(
        f"""SELECT '{lv}' AS unit, '{s}' AS score, bin, {R('max(centre)')} AS centre, count(*) AS n, {R('avg(y)')} AS mean FROM ({linear_sql(v, s, 10)}) GROUP BY bin HAVING count(*) >= 30"""
        for lv, v in (("row", "v_row_mean"), ("owner", "v_own_mean")) for s in ("kl_past", "kl_future")
    ),
)
def outcome_by_both_scores(spark, d):
    rows = b.stage(b.scored_cases(spark, d).select("owner", "kl_past", "kl_future", F.col("hit").cast("double").alias("y")), "both")
    own = rows.groupBy("owner").agg(n_rows().alias("k"), *[F.avg(c).alias(c) for c in ("kl_past", "kl_future", "y")])
    out = None
    for unit, src in (("row", rows), ("owner", b.stage(own.filter(F.col("k") >= 3), "own"))):
        for s in ("kl_past", "kl_future"):
            m = binning.bin_means(binning.linear_bin(src, s, 10), "y", ["bin", "centre"], 30)
            m = m.select(F.lit(unit).alias("unit"), F.lit(s).alias("score"), "*")
            out = m if out is None else out.unionByName(m)
    return rounded(out, "centre", "mean")


view("v_two_good", "SELECT t.*, quality = 1 AS good FROM v_two t JOIN labels USING (doc_id)")


@query(
    "topic_vs_token_outcomes",
    " UNION ALL ".join(f"SELECT '{n}' AS scoring, * FROM ({lift_sql(qbin_sql('v_two_good', c, 5), 'good')})" for n, c in (("token", "l1"), ("topic", "l2"))),
)
def topic_vs_token_outcomes(spark, d):
    other = b.masked(spark, d).filter(F.col("lead").isNotNull()).select("doc_id", F.col("lead").alias("topic"))
    j = b.clean_scores(spark, d).select("doc_id", F.col("lead").alias("token")).join(other, "doc_id").join(b.quality(spark, d), "doc_id")
    j, out = b.stage(j, "two"), None
    for c in ("token", "topic"):
        m = outcomes.lift_by(j, c, "good").withColumn("scoring", F.lit(c))
        out = m if out is None else out.unionByName(m)
    return lift_out(out)


@query(
    "owner_year_score_panel",
    f"SELECT owner, year, cls, count(*) AS n_rows, count(*) FILTER (WHERE n_terms >= 3) AS n_scored, {R('avg(lead) FILTER (WHERE n_terms >= 3)', 11)} AS mean_lead FROM v_scored GROUP BY 1, 2, 3",
)
def owner_year_score_panel(spark, d):
    ok = F.col("n_terms") >= 3
    return b.scored_cases(spark, d).groupBy("owner", "year", "cls").agg(
        n_rows().alias("n_rows"), F.count_if(ok).alias("n_scored"), r(F.avg(F.when(ok, F.col("lead"))), 11).alias("mean_lead")
    )


@query(
    "firm_finance_rollup",
    f"""SELECT owner, count(*) AS n_years, max(total) AS peak, {R('avg(total)', 5)} AS mean, {R('stddev_samp(peak / total)')} AS sd_margin, {R('median(total)', 5)} AS median FROM v_oy GROUP BY owner HAVING count(*) >= 4""",
)
def firm_finance_rollup(spark, d):
    p = owner_year(spark, d).withColumn("margin", F.col("peak") / F.col("total"))
    out = firms.finance_rollup(p, "owner", "total", "margin", 4)
    return rounded(rounded(out, "mean", "median", digits=5), "sd_margin")


view(
    "v_excess",
    """WITH p AS (SELECT a.owner, a.year, c.price / a.price - 1 AS ret FROM v_price a JOIN v_price c ON c.owner = a.owner AND c.year = a.year + 1)
    SELECT p.*, avg(ret) OVER (PARTITION BY year) AS bench, ret - avg(ret) OVER (PARTITION BY year) AS excess FROM p""",
)


def excess(spark, d):
    """One-year forward returns of owners and their excess over the yearly mean."""
    p = panels.year_end(b.cases(spark, d), "owner", "amount", ["filed", "case_id"])
    f = panels.forward_returns(p, "owner", (1,)).filter(F.col("ret_1y").isNotNull())
    f = f.select("owner", F.col("base_year").alias("year"), F.col("ret_1y").alias("ret"))
    f = ranking.with_stats(f, ["year"], bench=F.avg("ret"))
    return f.withColumn("excess", F.col("ret") - F.col("bench"))


@query(
    "returns_panel",
    f"""SELECT s.owner, s.year, {R('s.lead', 11)} AS lead, {R('e.ret', 5)} AS ret, {R('e.excess', 5)} AS excess, s.year = d.y0 AS debut_year FROM (SELECT owner, year, avg(lead) AS lead FROM v_scored GROUP BY 1, 2) s
    JOIN v_excess e USING (owner, year) JOIN (SELECT owner, min(year) AS y0 FROM v_scored GROUP BY 1) d USING (owner)""",
)
def returns_panel(spark, d):
    s = b.scored_cases(spark, d).groupBy("owner", "year").agg(F.avg("lead").alias("lead"))
    j = ranking.with_stats(s, ["owner"], y0=F.min("year")).join(excess(spark, d), ["owner", "year"])
    return j.select("owner", "year", r("lead", 11).alias("lead"), r("ret", 5).alias("ret"), r("excess", 5).alias("excess"), (F.col("year") == F.col("y0")).alias("debut_year"))


@query(
    "within_between_corr",
    f"""WITH p AS (SELECT firm, year, lead, ln(1 + n_items) AS l FROM v_firm_panel JOIN v_items USING (firm, year)),
    m AS (SELECT avg(lead) AS a, avg(l) AS c FROM p GROUP BY firm),
    w AS (SELECT year, lead - avg(lead) OVER (PARTITION BY firm) AS x, l - avg(l) OVER (PARTITION BY firm) AS y FROM p), z AS (SELECT x - avg(x) OVER (PARTITION BY year) AS x, y - avg(y) OVER (PARTITION BY year) AS y FROM w)
    SELECT (SELECT count(*) FROM m) AS n_entities, {R('(SELECT corr(a, c) FROM m)')} AS between, {R('corr(x, y)')} AS within FROM z""".replace("AS between", 'AS "between"'),
)
def within_between_corr(spark, d):
    p = b.stage(item_panel(spark, d).withColumn("l", F.log1p("n_items")), "items")
    return rounded(firms.within_between(p, "lead", "l", "firm"), "between", "within")


@query(
    "theme_wave_cohort",
    f"""SELECT year, regexp_matches(body, '(?i)\\bring\\b') AS cohort, count(*) AS n, {R("avg(CAST(status = 'F' AS DOUBLE))")} AS rate, {R('avg(length(body))')} AS mean_len FROM v_short GROUP BY 1, 2""",
)
def theme_wave_cohort(spark, d):
    from ..functions.text import has_phrase

    s = b.short_corpus(spark, d).withColumn("cohort", has_phrase("body", "ring"))
    return s.groupBy("year", "cohort").agg(
        n_rows().alias("n"), r(share(F.col("status") == "F")).alias("rate"), r(F.avg(F.length("body"))).alias("mean_len")
    )


view(
    "v_curve",
    f"""WITH q AS ({qbin_sql('v_debut', 'lead', 4, '', 'quartile')}),
    x AS (SELECT e.owner, q.quartile, e.year - q.year AS age, exp(sum(ln(greatest(1 + e.excess, 0.01))) OVER (PARTITION BY e.owner ORDER BY e.year)) - 1 AS cum FROM v_excess e JOIN q USING (owner) WHERE e.year >= q.year)
    SELECT * FROM x""",
)


@query(
    "cohort_return_curve",
    f"SELECT quartile, CAST(age AS INTEGER) AS age, count(*) AS n, {R('avg(cum)', 4)} AS mean, {R('stddev_samp(cum) / sqrt(count(*))', 4)} AS sem FROM v_curve GROUP BY 1, 2",
)
def cohort_return_curve(spark, d):
    q = b.stage(firms.debuts(b.scored_cases(spark, d)).select("owner", "lead", F.col("year").alias("y0")), "quartile")
    q = ranking.quantile_bin(q, "lead", 4, out="quartile").select("owner", "quartile", "y0")
    x = excess(spark, d).join(q, "owner").filter(F.col("year") >= F.col("y0"))
    x = x.withColumn("ret", F.greatest(1 + F.col("excess"), F.lit(0.01)) - 1)
    x = panels.chain_returns(x, "owner", "ret", "cum").withColumn("age", F.col("year") - F.col("y0"))
    return x.groupBy("quartile", "age").agg(
        n_rows().alias("n"), r(F.avg("cum"), 4).alias("mean"), r(F.stddev_samp("cum") / F.sqrt(n_rows()), 4).alias("sem")
    )


@query(
    "returns_with_without_group",
    f"""WITH p AS (SELECT e.year, e.excess, s.lead, c_mktsegment = 'MACHINERY' AS grp FROM v_excess e JOIN (SELECT owner, year, avg(lead) AS lead FROM v_scored GROUP BY 1, 2) s USING (owner, year) JOIN customer ON c_custkey = owner)
    SELECT year, {R('avg(excess) FILTER (WHERE grp)', 4)} AS group_excess, {R('(SELECT regr_slope(excess, lead) FROM p)', 4)} AS slope_all, {R('(SELECT regr_slope(excess, lead) FROM p WHERE NOT grp)', 4)} AS slope_without FROM p GROUP BY year""",
)
def returns_with_without_group(spark, d):
    s = b.scored_cases(spark, d).groupBy("owner", "year").agg(F.avg("lead").alias("lead"))
    c = b.table(spark, d, "customer").select(F.col("c_custkey").alias("owner"), (F.col("c_mktsegment") == "MACHINERY").alias("grp"))
    p = b.stage(excess(spark, d).join(s, ["owner", "year"]).join(c, "owner"), "group")
    out = p.groupBy("year").agg(r(F.avg(F.when(F.col("grp"), F.col("excess"))), 4).alias("group_excess"))
    every = p.agg(F.regr_slope("excess", "lead")).scalar()
    rest = p.filter(~F.col("grp")).agg(F.regr_slope("excess", "lead")).scalar()
    return out.withColumn("slope_all", r(every, 4)).withColumn("slope_without", r(rest, 4))
