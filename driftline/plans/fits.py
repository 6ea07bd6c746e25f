"""Regression and inference queries."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..operators import inference, outcomes, panels, ranking, regression
from . import bindings as b
from .bins import n_rows
from .lifecycle import gated, qbin_sql
from .registry import R, query, r, rounded, view
from .relational import owner_year
from .fit_sql import cell_logits, logit as logit_sql, logits as logits_sql, ols, two_way as two_way_sql


def frame(spark, d):
    """Scored cases with their gate outcome, cell and owner, as a stage table."""
    g = gated(spark, d).withColumn("cell", F.concat_ws("_", "cls", "year"))
    return b.stage(
        g.select(
            "case_id", "owner", "cls", "year", "cell", "amount", "kl_past", "kl_future", "lead", "level",
            "n_terms", F.col("failed").cast("double").alias("failed"),
            F.col("registered").cast("double").alias("reg"), F.col("hit").cast("double").alias("hit"),
            F.log("amount").alias("log_amount"), (F.col("lead") * F.col("lead")).alias("lead2"),
        ),
        "frame",
    )


view(
    "v_frame",
    "SELECT *, cls || '_' || year AS cell, CAST(failed AS DOUBLE) AS y, ln(amount) AS log_amount FROM v_gated",
)


def res(df, digits=5):
    return rounded(df, "b", "se", "t", "r2", digits=digits)


def one_sql(source: str, y: str, x: str, term: str, cell: str = "", cluster: str = "", const: bool = True) -> str:
    """Slope of one regressor with HC1 or clustered errors, in SQL."""
    mean = lambda c: f"avg({c}) OVER (PARTITION BY {cell})" if cell else f"avg({c}) OVER ()"
    k = 2 if const and not cell else 1
    grp = cluster or "rid"
    factor = f"(g / (g - 1.0)) * ((n - 1.0) / (n - {k}))" if cluster else f"n / CAST(n - {k} AS DOUBLE)"
    row = f"""WITH s AS (SELECT row_number() OVER () AS rid, * FROM {source} WHERE {y} IS NOT NULL AND {x} IS NOT NULL),
    c AS (SELECT {grp} AS gid, {x} - {mean(x)} AS xc, {y} - {mean(y)} AS yc FROM s),
    f AS (SELECT sum(xc * yc) / sum(xc * xc) AS b, sum(xc * xc) AS sxx, count(*) AS n, sum(xc * yc) * sum(xc * yc) / sum(xc * xc) / sum(yc * yc) AS r2 FROM c),
    m AS (SELECT sum(q * q) AS meat, count(*) AS g FROM (SELECT gid, sum(xc * (yc - b * xc)) AS q FROM c, f GROUP BY gid)),
    o AS (SELECT b, sqrt({factor} * meat) / sxx AS se, n, g, r2 FROM f, m)
    SELECT '{term}' AS term, {R('b', 5)} AS b, {R('se', 5)} AS se, {R('b / se', 5)} AS t, n, {'g' if cluster else 'CAST(NULL AS BIGINT)'} AS n_clusters, {R('r2', 5)} AS r2 FROM o"""
    return row


def only(df, term):
    return res(df.filter(F.col("term") == term))


OLS_TERMS = {"log_amount": "log_amount", "n_terms": "n_terms", "t": "(year - 1995)", "t2": "(year - 1995) * (year - 1995)"}


@query("reg_ols", ols("v_frame", "lead", OLS_TERMS))
def reg_ols(spark, d):
    """Lead on size and length with a quadratic year control."""
    t = F.col("year") - 1995
    f = frame(spark, d).withColumn("t", t.cast("double")).withColumn("t2", (t * t).cast("double"))
    out = regression.fit(f, "lead", list(OLS_TERMS))
    return res(out.filter(F.col("term") != "intercept"))


@query("reg_fe_lpm", one_sql("v_frame", "y", "lead", "lead", "cell"))
def reg_fe_lpm(spark, d):
    return res(regression.fit(frame(spark, d), "failed", ["lead"], absorb="cell"))


@query("reg_fe_lpm_cluster", one_sql("v_frame", "y", "lead", "lead", "cell", "owner"))
def reg_fe_lpm_cluster(spark, d):
    return res(regression.fit(frame(spark, d), "failed", ["lead"], cluster="owner", absorb="cell"))


def panel(spark, d):
    """Owner-year panel with mean scores, as a stage table."""
    s = b.scored_cases(spark, d)
    p = s.groupBy("owner", "year").agg(
        n_rows().alias("n"), F.avg("lead").alias("lead"), F.avg("level").alias("level"), F.log(F.sum("amount")).alias("log_total")
    )
    return b.stage(p, "panel")


view(
    "v_ownpanel",
    """SELECT owner, year, count(*) AS n, avg(lead) AS lead, avg(level) AS level, ln(sum(amount)) AS log_total FROM v_scored GROUP BY 1, 2""",
)
view(
    "v_leadlag",
    """SELECT p.*, a.lead AS lag1, z.lead AS lead1 FROM v_ownpanel p LEFT JOIN v_ownpanel a ON a.owner = p.owner AND a.year = p.year - 1
    LEFT JOIN v_ownpanel z ON z.owner = p.owner AND z.year = p.year + 1""",
)


@query("reg_twoway_fe", two_way_sql("v_ownpanel", "log_total", {"lead": "lead", "level": "level"}, "owner"))
def reg_twoway_fe(spark, d):
    return res(regression.two_way(panel(spark, d), "log_total", ["lead", "level"], "owner"))


@query("reg_leadlag_fe", two_way_sql("v_leadlag", "log_total", {"lead_lag1": "lag1", "lead": "lead", "lead_lead1": "lead1"}, "owner"))
def reg_leadlag_fe(spark, d):
    p = panels.consecutive_shift(panel(spark, d), "owner", "lead")
    p = b.stage(p, "leadlag")
    return res(regression.two_way(p, "log_total", ["lead_lag1", "lead", "lead_lead1"], "owner"))


view("v_high", "SELECT *, CAST(level > (SELECT median(level) FROM v_ownpanel) AS DOUBLE) AS high FROM v_ownpanel")


@query(
    "reg_interaction_fe",
    " UNION ALL ".join(
        f"SELECT '{name}' AS sample, * FROM ({two_way_sql('v_high', 'log_total', xs, 'owner', where=where)})"
        for name, xs, where in (
            ("interaction", {"lead": "lead", "high": "high", "lead_high": "lead * high"}, "true"),
            ("low half", {"lead": "lead"}, "high = 0"), ("high half", {"lead": "lead"}, "high = 1"),
        )
    ),
)
def reg_interaction_fe(spark, d):
    """The interaction on the whole panel, and the slope in each half by itself."""
    p = panel(spark, d)
    p = ranking.with_quantiles(p, "level", [0.5], ["_m"]).withColumn("high", (F.col("level") > F.col("_m")).cast("double"))
    p = b.stage(regression.interaction(p, "lead", "high", "lead_high"), "halves")
    out = regression.two_way(p, "log_total", ["lead", "high", "lead_high"], "owner").withColumn("sample", F.lit("interaction"))
    for name, v in (("low half", 0), ("high half", 1)):
        one = regression.two_way(p.filter(F.col("high") == v), "log_total", ["lead"], "owner")
        out = out.unionByName(one.withColumn("sample", F.lit(name)))
    return res(out)


def logit_out(df):
    return rounded(df, "b", "se", "t", "pseudo_r2", digits=4)


@query(
    "reg_logit_quadratic",
    " UNION ALL ".join(
        f"SELECT '{split}' AS split, * FROM {cell_logits('(SELECT *, (lead - avg(lead) OVER ()) / stddev_samp(lead) OVER () AS z FROM v_frame)', 'CAST(hit AS DOUBLE)', 'z', cell, 30)}"
        for split, cell in (("cls", "cls"), ("year", "year"), ("cls x year", "cls || ' ' || year"))
    ),
)
def reg_logit_quadratic(spark, d):
    f = ranking.with_stats(frame(spark, d), [], m=F.avg("lead"), sd=F.stddev_samp("lead"))
    f = b.stage(f.withColumn("z", (F.col("lead") - F.col("m")) / F.col("sd")), "z")
    # the cells of all splits move together
    cells = [
        F.struct(F.lit(" x ".join(by)).alias("split"), F.concat_ws(" ", *[F.col(c).cast("string") for c in by]).alias("cell"))
        for by in (["cls"], ["year"], ["cls", "year"])
    ]
    rows = f.select("hit", "z", F.explode(F.array(*cells)).alias("_s")).select("hit", "z", "_s.split", "_s.cell")
    q = regression.quadratic_logits(rows, "hit", "z", ["split", "cell"], 30)
    return q.select("split", "cell", "n", r("b1", 4).alias("b1"), r("b2", 4).alias("b2"), "shape")


_LEADS = {"lead": {"lead": "lead"}, "kl_past+kl_future": {"kl_past": "kl_past", "kl_future": "kl_future"}}


@query(
    "reg_logit_outcomes",
    logits_sql([
        logit_sql("v_frame", y, {**xs, "log_amount": "log_amount"}, f"{name} on {label}")
        for name, y in (("reg", "CAST(registered AS DOUBLE)"), ("hit", "CAST(hit AS DOUBLE)")) for label, xs in _LEADS.items()
    ]),
)
def reg_logit_outcomes(spark, d):
    f, out = frame(spark, d), None
    for y in ("reg", "hit"):
        for xs in (["lead"], ["kl_past", "kl_future"]):
            m = regression.logit(f, y, [*xs, "log_amount"], f"{y} on {'+'.join(xs)}")
            out = m if out is None else out.unionByName(m)
    return logit_out(out)


@query(
    "reg_mediation",
    logits_sql([
        logit_sql("v_frame", "CAST(hit AS DOUBLE)", {"lead": "lead"}, "total"),
        logit_sql("v_frame", "CAST(hit AS DOUBLE)", {"lead": "lead", "n_terms": "n_terms"}, "direct"),
    ]),
)
def reg_mediation(spark, d):
    f = frame(spark, d)
    total = regression.logit(f, "hit", ["lead"], "total")
    return logit_out(total.unionByName(regression.logit(f, "hit", ["lead", "n_terms"], "direct")))


view(
    "v_cuts",
    """SELECT f.*, case_id = min(case_id) OVER (PARTITION BY owner) AS first_case,
    1 + CAST(n_terms > quantile_cont(n_terms, 0.25) OVER () AS INTEGER) + CAST(n_terms > quantile_cont(n_terms, 0.5) OVER () AS INTEGER)
      + CAST(n_terms > quantile_cont(n_terms, 0.75) OVER () AS INTEGER) AS len_q,
    lead BETWEEN quantile_cont(lead, 0.01) OVER () AND quantile_cont(lead, 0.99) OVER () AS inner_lead FROM v_frame f""",
)


@query(
    "reg_alternatives",
    logits_sql([
        logit_sql("v_cuts", "CAST(hit AS DOUBLE)", {"lead": "lead", "lead2": "lead * lead"}, name, where)
        for name, where in (
            ("all", "true"), ("first", "first_case"), ("recurring", "NOT first_case"), ("shortest quartile", "len_q = 1"),
            ("longest quartile", "len_q = 4"), ("trimmed", "inner_lead"),
        )
    ]),
)
def reg_alternatives(spark, d):
    f = ranking.with_quantiles(frame(spark, d), "lead", [0.01, 0.99], ["_lo", "_hi"])
    f = ranking.quantile_bin(f, "n_terms", 4, out="len_q")
    f = ranking.with_stats(f, ["owner"], _first=F.min("case_id"))
    f, out = b.stage(f, "alternatives"), None
    cuts = {
        "all": F.lit(True), "first": F.col("case_id") == F.col("_first"), "recurring": F.col("case_id") != F.col("_first"),
        "shortest quartile": F.col("len_q") == 1, "longest quartile": F.col("len_q") == 4,
        "trimmed": F.col("lead").between(F.col("_lo"), F.col("_hi")),
    }
    for name, cond in cuts.items():
        m = regression.logit(f.filter(cond), "hit", ["lead", "lead2"], name)
        out = m if out is None else out.unionByName(m)
    return logit_out(out)


view(
    "v_trail",
    """SELECT *, avg(lead) OVER (PARTITION BY owner ORDER BY year RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS lead3 FROM (
    SELECT owner, year, avg(lead) AS lead, ln(sum(amount)) AS log_total FROM v_scored GROUP BY 1, 2)""",
)


@query("reg_financial_panel", one_sql("v_trail", "log_total", "lead3", "lead3", "", "owner"))
def reg_financial_panel(spark, d):
    p = panels.trailing_mean(panel(spark, d), "owner", "lead", 3, "lead3")
    return only(regression.fit(p, "log_total", ["lead3"], cluster="owner"), "lead3")


view(
    "v_pull",
    """SELECT cls, year, ln(n) - ln(lag(n) OVER (PARTITION BY cls ORDER BY year)) AS inflow, lag(med) OVER (PARTITION BY cls ORDER BY year) AS med_lag FROM (
    SELECT cls, year, count(*) AS n, median(lead) AS med FROM v_scored GROUP BY 1, 2)""",
)


@query("reg_demand_pull", two_way_sql("v_pull", "inflow", {"med_lag": "med_lag"}, "cls"))
def reg_demand_pull(spark, d):
    s = b.scored_cases(spark, d)
    cy = s.groupBy("cls", "year").agg(n_rows().alias("n"), F.avg("amount").alias("m"))
    med = ranking.quantiles(s, "lead", [0.5], ["cls", "year"], ["med"])
    cy = b.stage(cy.join(med, ["cls", "year"]), "class_year")
    w = W.partitionBy("cls").orderBy("year")
    cy = cy.withColumn("inflow", F.log("n") - F.log(F.lag("n").over(w))).withColumn("med_lag", F.lag("med").over(w))
    return res(regression.two_way(cy, "inflow", ["med_lag"], "cls"))


@query(
    "reg_firm_outcomes_lag",
    " UNION ALL ".join(
        f"SELECT CAST({k} AS INTEGER) AS lag, * FROM ({ols(source, 'log_total', {'lead': 'lead'}, cluster=cluster)})"
        for k, source, cluster in (
            (0, "v_ownpanel", "owner"),
            *((k, f"(SELECT a.owner, a.year, a.log_total, z.lead FROM v_ownpanel a JOIN v_ownpanel z ON z.owner = a.owner AND z.year = a.year - {k})", "owner") for k in (1, 2)),
            (-1, "(SELECT owner, avg(log_total) AS log_total, avg(lead) AS lead FROM v_ownpanel GROUP BY 1)", ""),
        )
    ),
)
def reg_firm_outcomes_lag(spark, d):
    p, out = panel(spark, d), None
    for k in (0, 1, 2):
        j = p if k == 0 else panels.lagged(p.select("owner", "year", "log_total"), "owner", [], k).join(
            p.select("owner", (F.col("year") + k).alias("year"), "lead"), ["owner", "year"]
        )
        m = regression.fit(j, "log_total", ["lead"], cluster="owner").withColumn("lag", F.lit(k))
        out = m if out is None else out.unionByName(m)
    firm = p.groupBy("owner").agg(F.avg("log_total").alias("log_total"), F.avg("lead").alias("lead"))
    cross = regression.fit(firm, "log_total", ["lead"]).withColumn("lag", F.lit(-1))
    return res(out.unionByName(cross).filter(F.col("term") == "lead"))


view(
    "v_funded_cases",
    f"""SELECT f.*, CAST(registered AS DOUBLE) AS reg, CAST(hit AS DOUBLE) AS listed, case_id = min(case_id) OVER (PARTITION BY owner) AS first_case
    FROM ({qbin_sql('v_frame', 'lead', 5, '', 'q')}) f""",
)
# stage or cut -> (outcome, regressor, SQL condition)
FUNDING = {
    "score to funded": ("reg", "lead", "true"),
    "funded to listed": ("listed", "reg", "true"),
    "score to listed, funded": ("listed", "lead", "reg = 1"),
    **{f"score to funded, quintile {i}": ("reg", "lead", f"q = {i}") for i in range(1, 6)},
    "first filings": ("reg", "lead", "first_case"),
    "repeat filings": ("reg", "lead", "NOT first_case"),
    "early years": ("reg", "lead", "year <= 1995"),
    "late years": ("reg", "lead", "year > 1995"),
}


@query(
    "reg_funding_outcomes",
    " UNION ALL ".join(
        f"SELECT '{name}' AS sample, * FROM ({ols('v_funded_cases', y, {x: x}, cell='cell', cluster='owner', where=where)})"
        for name, (y, x, where) in FUNDING.items()
    ),
)
def reg_funding_outcomes(spark, d):
    """Score to funding, funding to listing, the slope in each score quintile and in cuts of the
    sample; cell effects, errors clustered by owner."""
    f = ranking.quantile_bin(frame(spark, d), "lead", 5, out="q")
    f = ranking.with_stats(f, ["owner"], _first=F.min("case_id"))
    f = f.withColumn("first_case", F.col("case_id") == F.col("_first")).withColumn("listed", F.col("hit"))
    f, out = b.stage(f, "funding"), None
    for name, (y, x, where) in FUNDING.items():
        m = regression.fit(f.filter(where), y, [x], cluster="owner", absorb="cell").withColumn("sample", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return res(out)


view(
    "v_study",
    """WITH e AS (SELECT owner, min(year) AS y0 FROM v_oy WHERE n >= 3 GROUP BY 1)
    SELECT p.owner, p.year, CAST(p.year - e.y0 AS INTEGER) AS rel, CAST(p.n AS DOUBLE) AS n FROM e JOIN v_oy p ON p.owner = e.owner AND p.year - e.y0 BETWEEN -3 AND 3""",
)


view(
    "v_groups",
    """WITH g AS (SELECT owner % 40 AS grp, year, CAST(sum(n) AS DOUBLE) AS n FROM v_oy GROUP BY 1, 2),
    e AS (SELECT grp, arg_min(year, (-n, year)) AS y0 FROM g GROUP BY 1)
    SELECT g.*, CAST(g.year - y0 AS INTEGER) AS rel, CAST(g.year > y0 AS DOUBLE) AS post, CAST(least(g.year - y0, 0) AS DOUBLE) AS before,
      CAST(greatest(g.year - y0, 0) AS DOUBLE) AS after FROM g JOIN e USING (grp)""",
)
_NO_FIT = "CAST(NULL AS VARCHAR) AS term, CAST(NULL AS DOUBLE) AS se, CAST(NULL AS BIGINT) AS n_clusters"


@query(
    "reg_event_study",
    f"""SELECT 'mean' AS part, rel, {_NO_FIT}, count(*) AS n, {R('avg(n)', 5)} AS b FROM v_study GROUP BY rel
    UNION ALL SELECT 'post', CAST(NULL AS INTEGER), term, se, n_clusters, n, b FROM ({two_way_sql('v_groups', 'n', {'post': 'post'}, 'grp')})
    UNION ALL SELECT 'slopes', CAST(NULL AS INTEGER), term, se, n_clusters, n, b FROM ({ols('v_groups', 'n', {'before': 'before', 'after': 'after'}, cell='grp', cluster='grp')})""",
)
def reg_event_study(spark, d):
    """Means by year from the event, the effect after it with group and year effects and errors
    clustered by group, and separate slopes before and after."""
    means = study(spark, d).groupBy("rel").agg(n_rows().alias("n"), r(F.avg("n"), 5).alias("b")).select(
        F.lit("mean").alias("part"), "rel", F.lit(None).cast("string").alias("term"), F.lit(None).cast("double").alias("se"),
        F.lit(None).cast("long").alias("n_clusters"), "n", "b",
    )
    g = owner_year(spark, d).groupBy((F.col("owner") % 40).alias("grp"), "year").agg(F.sum("n").cast("double").alias("n"))
    g = b.stage(g, "groups")
    start = g.groupBy("grp").agg(F.min_by("year", F.struct(-F.col("n"), "year")).alias("y0"))
    rel = F.col("year") - F.col("y0")
    g = g.join(start, "grp").withColumn("post", (rel > 0).cast("double")).withColumn(
        "before", F.least(rel, F.lit(0)).cast("double")
    ).withColumn("after", F.greatest(rel, F.lit(0)).cast("double"))
    g, out = b.stage(g, "event-groups"), means
    fits = {
        "post": regression.two_way(g, "n", ["post"], "grp"),
        # together the slopes are the calendar year, so year effects would take their place
        "slopes": regression.fit(g, "n", ["before", "after"], cluster="grp", absorb="grp"),
    }
    for part, m in fits.items():
        out = out.unionByName(res(m).select(
            F.lit(part).alias("part"), F.lit(None).cast("int").alias("rel"), "term", "se", "n_clusters", "n", "b"
        ))
    return out


def study(spark, d):
    p = owner_year(spark, d)
    ev = p.filter(F.col("n") >= 3).groupBy("owner").agg(F.min("year").alias("event_year"))
    return panels.expand_events(ev, p, "owner", -3, 3)


@query("reg_event_study_post", two_way_sql("v_study", "n", {"post": "CAST(rel > 0 AS DOUBLE)"}, "owner"))
def reg_event_study_post(spark, d):
    s = b.stage(study(spark, d).withColumn("post", (F.col("rel") > 0).cast("double")), "study")
    return res(regression.two_way(s, "n", ["post"], "owner"))


view(
    "v_changes",
    """WITH o AS (SELECT cls, year, owner, count(*) AS n FROM v_cases GROUP BY ALL),
    t AS (SELECT cls, year, sum(n) FILTER (WHERE n = 1) AS one, sum(n) FILTER (WHERE n BETWEEN 2 AND 9) AS mid, sum(n) AS n FROM o GROUP BY 1, 2),
    s AS (SELECT cls, year, coalesce(one, 0) / n AS single, coalesce(mid, 0) / n AS middle FROM t),
    e AS (SELECT cls, year, single - lag(single) OVER w AS d_single, middle - lag(middle) OVER w AS d_mid FROM s WINDOW w AS (PARTITION BY cls ORDER BY year))
    SELECT *, lag(d_mid) OVER (PARTITION BY cls ORDER BY year) AS d_mid_lag FROM e""",
)


@query("reg_panel_changes", two_way_sql("v_changes", "d_single", {"d_mid_lag": "d_mid_lag"}, "cls"))
def reg_panel_changes(spark, d):
    from ..operators.aggregates import tier_shares

    t = tier_shares(b.cases(spark, d), "owner", ["cls", "year"])
    w = W.partitionBy("cls").orderBy("year")
    for c in ("single", "mid"):
        t = t.withColumn(f"d_{c}", F.col(f"{c}_share") - F.lag(f"{c}_share").over(w))
    t = t.withColumn("d_mid_lag", F.lag("d_mid").over(w))
    return res(regression.two_way(b.stage(t, "changes"), "d_single", ["d_mid_lag"], "cls"))


FUNNEL = {
    # stage: (condition, outcome, cohort years)
    "reached": ("true", "reg", (1995, 2001)),
    "passed gate": ("registered", "passed", (1995, 1999)),
    "hit after gate": ("registered AND passed = 1", "hit", (1995, 1998)),
    "large": ("registered", "large", (1996, 2001)),
}
view(
    "v_funnel",
    "SELECT *, CAST(registered AS DOUBLE) AS reg, CAST(NOT failed AS DOUBLE) AS passed, CAST(hit AS DOUBLE) AS hit1, CAST(amount > 300000 AS DOUBLE) AS large FROM v_frame",
)


@query(
    "staged_funnel",
    " UNION ALL ".join(
        f"""SELECT '{stage}' AS stage, * FROM ({one_sql(f"(SELECT * FROM v_funnel WHERE {cond} AND year BETWEEN {lo} AND {hi})", 'hit1' if y == 'hit' else y, 'level', 'level', 'cell', 'owner')})"""
        for stage, (cond, y, (lo, hi)) in FUNNEL.items()
    ),
)
def staged_funnel(spark, d):
    f = frame(spark, d).withColumn("registered", F.col("reg") == 1).withColumn("passed", 1 - F.col("failed"))
    f = f.withColumn("large", (F.col("amount") > 300000).cast("double"))
    return res(regression.staged(f, FUNNEL, ["level"], "cell", "owner"))


view(
    "v_sides",
    "SELECT CASE WHEN lead < 0 THEN 'neg' ELSE 'pos' END AS side, abs(lead) AS mag, CAST(hit AS DOUBLE) AS y FROM v_scored WHERE lead <> 0",
)


def tails_sql(k: int) -> str:
    return f"SELECT side, bin, avg(mag) AS x, avg(y) AS y, count(*) AS n FROM ({qbin_sql('v_sides', 'mag', k, 'side')}) GROUP BY 1, 2"


@query(
    "fit_log_linear_tails",
    f"""SELECT side, count(*) AS n_bins, {R('regr_intercept(ln(y + 1e-9), x)', 5)} AS a, {R('regr_slope(ln(y + 1e-9), x)', 5)} AS b,
    {R('regr_r2(ln(y + 1e-9), x)', 5)} AS r2 FROM ({tails_sql(10)}) WHERE n >= 10 GROUP BY side HAVING count(*) >= 4""",
)
def fit_log_linear_tails(spark, d):
    bins = inference.tail_bins(b.scored_cases(spark, d), "lead", "hit", 10)
    return rounded(inference.log_linear_tails(bins, 10), "a", "b", "r2", digits=5)


@query("fit_exp_tails", f"SELECT side, bin, {R('x')} AS x, {R('y')} AS y, n FROM ({tails_sql(20)})")
def fit_exp_tails(spark, d):
    return rounded(inference.tail_bins(b.scored_cases(spark, d), "lead", "hit", 20), "x", "y")


@query(
    "fit_exp_tails_curve",
    f"""WITH c AS (SELECT side, y, c, exp(-c * x) AS e FROM ({tails_sql(20)}), (SELECT unnest([{', '.join(repr(0.1 * 1.15**i) + '::DOUBLE' for i in range(50))}]) AS c)),
    f AS (SELECT side, c, regr_intercept(y, e) AS a, regr_slope(y, e) AS b, regr_r2(y, e) AS r2 FROM c GROUP BY 1, 2)
    SELECT side, {R('c', 4)} AS c, {R('a', 4)} AS a, {R('b', 4)} AS b, {R('r2', 4)} AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY r2 DESC NULLS LAST, c) AS rn FROM f) WHERE rn = 1""",
)
def fit_exp_tails_curve(spark, d):
    bins = inference.tail_bins(b.scored_cases(spark, d), "lead", "hit", 20)
    return rounded(inference.exponential_tails(bins), "a", "b", "c", "r2", digits=4)


@query(
    "welch_t",
    f"""SELECT n_a, n_b, {R('ma')} AS mean_a, {R('mb')} AS mean_b, {R('ma - mb')} AS gap, {R('sqrt(va / n_a + vb / n_b)')} AS se, {R('(ma - mb) / sqrt(va / n_a + vb / n_b)', 5)} AS t
    FROM (SELECT count(*) FILTER (WHERE hit) AS n_a, count(*) FILTER (WHERE NOT hit) AS n_b, avg(lead) FILTER (WHERE hit) AS ma, avg(lead) FILTER (WHERE NOT hit) AS mb,
      var_samp(lead) FILTER (WHERE hit) AS va, var_samp(lead) FILTER (WHERE NOT hit) AS vb FROM v_scored)""",
)
def welch_t(spark, d):
    out = inference.welch(b.scored_cases(spark, d), "lead", F.col("hit"))
    return rounded(rounded(out, "mean_a", "mean_b", "gap", "se"), "t", digits=5)


view(
    "v_pvals",
    """SELECT owner, exp(-abs(avg(lead) - 0.9) * sqrt(count(*)) * 4) AS p FROM v_scored GROUP BY owner""",
)


@query(
    "bh_fdr",
    """WITH o AS (SELECT owner, p, row_number() OVER (ORDER BY p, owner) AS rk, count(*) OVER () AS m FROM v_pvals)
    SELECT owner, rk <= (SELECT coalesce(max(rk), 0) FROM o WHERE p <= 0.05 * rk / m) AS rejected FROM o""",
)
def bh_fdr(spark, d):
    g = b.scored_cases(spark, d).groupBy("owner").agg(F.avg("lead").alias("m"), n_rows().alias("n"))
    p = F.exp(-F.abs(F.col("m") - 0.9) * F.sqrt("n") * 4)
    out = inference.benjamini_hochberg(g.select("owner", p.alias("p")), "p", "owner")
    return out.select("owner", "rejected")


@query(
    "eb_shrink",
    f"""WITH c AS (SELECT owner, count(*) AS n, count(*) FILTER (WHERE hit) AS hits FROM v_scored GROUP BY owner),
    t AS (SELECT sum(n) AS nn, sum(hits) / CAST(sum(n) AS DOUBLE) AS m, count(*) AS k, sum(n * n) AS q FROM c),
    s AS (SELECT sum(n * (hits / CAST(n AS DOUBLE) - m) ** 2) AS ss FROM c, t),
    p AS (SELECT m, m * (1 - m) / greatest((ss - m * (1 - m) * (k - 1)) / (nn - q / CAST(nn AS DOUBLE)), 1e-12) - 1 AS nu FROM t, s)
    SELECT owner, n, hits, {R('m')} AS prior_mean, {R('nu', 2)} AS prior_n, {R('(hits + nu * m) / (n + nu)')} AS shrunk FROM c, p""",
)
def eb_shrink(spark, d):
    c = b.scored_cases(spark, d).groupBy("owner").agg(n_rows().alias("n"), F.count_if("hit").alias("hits"))
    return rounded(rounded(inference.shrink_rates(c), "prior_mean", "shrunk"), "prior_n", digits=2)


_ICC = """WITH g AS (SELECT cls AS g, count(*) AS c, avg(CAST(hit AS DOUBLE)) AS m, var_pop(CAST(hit AS DOUBLE)) AS v FROM v_scored GROUP BY 1),
    t AS (SELECT sum(c) AS n, count(*) AS k, sum(c * m) / sum(c) AS yb, sum(c * v) AS ssw, sum(c * c) AS cc FROM g),
    s AS (SELECT sum(c * (m - yb) ** 2) AS ssb FROM g, t),
    i AS (SELECT n, k, (ssb / (k - 1) - ssw / (n - k)) / (ssb / (k - 1) + ((n - cc / CAST(n AS DOUBLE)) / (k - 1) - 1) * ssw / (n - k)) AS rho FROM t, s)"""


@query(
    "icc_design_effect",
    _ICC + f""", c AS (SELECT year, cls, CAST(count(*) AS DOUBLE) AS c FROM v_scored GROUP BY 1, 2),
    m AS (SELECT year, CAST(sum(c) AS BIGINT) AS n, sum(c * c) / sum(c) AS mbar FROM c GROUP BY 1)
    SELECT year, m.n, {R('mbar')} AS mbar, {R('greatest(1 + (mbar - 1) * greatest(0, least(1, rho)), 1)', 5)} AS deff, {R('m.n / greatest(1 + (mbar - 1) * greatest(0, least(1, rho)), 1)', 3)} AS n_eff FROM m, i""",
)
def icc_design_effect(spark, d):
    s = b.scored_cases(spark, d)
    rho = inference.intraclass(s, "cls", "hit").select("icc").scalar()
    out = inference.design_effects(s, ["year"], "cls", rho)
    return rounded(rounded(rounded(out, "mbar"), "deff", digits=5), "n_eff", digits=3)


@query(
    "hex_bin",
    """WITH p AS (SELECT kl_past / 6 * 20 AS ix, kl_future / 6 * 11 AS iy, CAST(hit AS DOUBLE) AS y FROM v_scored WHERE kl_past BETWEEN 0 AND 6 AND kl_future BETWEEN 0 AND 6),
    q AS (SELECT *, (ix - round(ix)) ** 2 + 3 * (iy - round(iy)) ** 2 < (ix - floor(ix) - 0.5) ** 2 + 3 * (iy - floor(iy) - 0.5) ** 2 AS f FROM p)
    SELECT CAST(CASE WHEN f THEN round(ix) ELSE floor(ix) + 0.5 END AS DOUBLE) AS hx, CAST(CASE WHEN f THEN round(iy) ELSE floor(iy) + 0.5 END AS DOUBLE) AS hy,
    count(*) AS n, sum(y) AS hits FROM q GROUP BY 1, 2""",
)
def hex_bin(spark, d):
    return inference.hexagons(b.scored_cases(spark, d), "kl_past", "kl_future", "hit", 0.0, 6.0, 20)


@query(
    "kernel_surface",
    f"""WITH g AS (SELECT CAST(greatest(0, least(19, floor(kl_past / 0.3))) AS INTEGER) AS ix, CAST(greatest(0, least(19, floor(kl_future / 0.3))) AS INTEGER) AS iy,
      count(*) AS c, sum(CAST(hit AS DOUBLE)) AS s FROM v_scored GROUP BY 1, 2),
    t AS (SELECT CAST(x AS INTEGER) AS ix, CAST(y AS INTEGER) AS iy FROM range(20) a(x), range(20) b(y)),
    k AS (SELECT t.ix, t.iy, exp(-((g.ix - t.ix) ** 2 + (g.iy - t.iy) ** 2) / 2.0) AS w, g.c, g.s FROM t JOIN g ON abs(g.ix - t.ix) <= 5 AND abs(g.iy - t.iy) <= 5)
    SELECT ix, iy, {R('sum(w * s) / sum(w * c)')} AS rate, {R('sum(w * c) ** 2 / sum(w * w * c)', 3)} AS n_eff FROM k GROUP BY 1, 2""",
)
def kernel_surface(spark, d):
    cells = inference.lattice(b.scored_cases(spark, d), "kl_past", "kl_future", "hit", 0.0, 6.0, 20)
    return rounded(rounded(inference.kernel_surface(cells, 1.0, 20), "rate"), "n_eff", digits=3)


@query(
    "kernel_surface_bandwidth",
    f"""WITH g AS (SELECT CAST(greatest(0, least(19, floor(kl_past / 0.3))) AS INTEGER) AS ix, CAST(greatest(0, least(19, floor(kl_future / 0.3))) AS INTEGER) AS iy,
      CAST('0x' || substr(md5(owner || ':42'), 1, 8) AS BIGINT) % 3 AS fold, count(*) AS c, sum(CAST(hit AS DOUBLE)) AS s FROM v_scored GROUP BY 1, 2, 3),
    z AS (SELECT sum(s) / sum(c) AS base FROM g), b AS (SELECT unnest([0.5::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE]) AS sigma),
    t AS (SELECT f.fold, g.ix, g.iy, sum(g.c) AS c, sum(g.s) AS s FROM g, (SELECT DISTINCT fold FROM g) f WHERE g.fold <> f.fold GROUP BY 1, 2, 3),
    p AS (SELECT h.fold, h.ix, h.iy, h.c, h.s, sigma,
        sum(exp(-((t.ix - h.ix) ** 2 + (t.iy - h.iy) ** 2) / (2 * sigma * sigma)) * t.s) / sum(exp(-((t.ix - h.ix) ** 2 + (t.iy - h.iy) ** 2) / (2 * sigma * sigma)) * t.c) AS rate
      FROM g h CROSS JOIN b LEFT JOIN t ON t.fold = h.fold AND abs(t.ix - h.ix) <= floor(5 * sigma + 0.5) AND abs(t.iy - h.iy) <= floor(5 * sigma + 0.5) GROUP BY ALL),
    q AS (SELECT sigma, c, s, greatest(0.0001, least(0.9999, coalesce(rate, base))) AS r FROM p, z)
    SELECT sigma, {R('sum(-(s * ln(r) + (c - s) * ln(1 - r))) / sum(c)')} AS deviance FROM q GROUP BY 1""",
)
def kernel_surface_bandwidth(spark, d):
    s = b.stage(b.scored_cases(spark, d).select("kl_past", "kl_future", "hit", "owner"), "surface")
    out = inference.bandwidth_scores(s, "kl_past", "kl_future", "hit", "owner", 0.0, 6.0, 20, (0.5, 1.0, 2.0), 3)
    return rounded(out, "deviance")


@query(
    "surface_forward_coverage",
    f"""WITH n AS (SELECT year, count(*) AS n FROM v_scored GROUP BY 1), e AS (SELECT max(year) AS y1 FROM n),
    f AS (SELECT CASE WHEN a.n < 0.5 * z.n THEN y1 - 1 ELSE y1 END AS last, CASE WHEN a.n < 0.5 * z.n THEN z.n ELSE a.n END AS rate FROM e JOIN n a ON a.year = y1 LEFT JOIN n z ON z.year = y1 - 1),
    x AS (SELECT n.year, o.n AS obs, CASE WHEN n.year + j <= f.last THEN coalesce(o.n, f.rate) ELSE f.rate END AS fl FROM n CROSS JOIN f CROSS JOIN (SELECT unnest(range(1, 3)) AS j) LEFT JOIN n o ON o.year = n.year + j),
    c AS (SELECT year, coalesce(sum(obs), 0) / CAST(sum(fl) AS DOUBLE) AS cov FROM x GROUP BY 1)
    SELECT CAST(floor(kl_past) AS INTEGER) AS gx, CAST(floor(kl_future) AS INTEGER) AS gy, count(*) AS n, {R('avg(CAST(hit AS DOUBLE))')} AS rate, {R('avg(cov)')} AS coverage
    FROM v_scored JOIN c USING (year) GROUP BY 1, 2""",
)
def surface_forward_coverage(spark, d):
    from ..operators.surprise import forward_coverage

    s = b.scored_cases(spark, d)
    n = s.groupBy("year").agg(n_rows().alias("n")).withColumn("cls", F.lit("all"))
    cov = forward_coverage(n, 2).select("year", "coverage")
    cell = lambda c: F.floor(c).cast("int")
    j = s.join(cov, "year").groupBy(cell("kl_past").alias("gx"), cell("kl_future").alias("gy"))
    return j.agg(n_rows().alias("n"), r(F.avg(F.col("hit").cast("double"))).alias("rate"), r(F.avg("coverage")).alias("coverage"))
