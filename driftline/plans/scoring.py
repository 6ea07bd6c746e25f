"""Surprise scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import correlation, share
from ..operators import audits, outcomes, ranking, regression, surprise, topics, vocabulary
from . import bindings as b
from .bins import n_rows
from .lifecycle import lift_out, lift_sql, qbin_sql
from .fit_sql import logit as logit_sql
from .registry import R, query, r, rounded, view


def parts(spark, d):
    """Corpus, its terms as a stage table (texts are tokenised once) and its vocabulary."""
    docs = b.corpus(spark, d)
    terms = b.stage(b.raw_terms(spark, d, docs), "terms")
    return docs, terms, vocabulary.build_vocabulary(docs, terms, b.MIN_DF, 0.5)


def decayed(spark, d, halflives):
    """Decayed scores, one table a half-life."""
    docs = b.corpus(spark, d)
    if b.keys_unique(docs):
        out = surprise.corpus_decay(docs, b.doc_terms(spark, d, docs, True), b.stage, halflives, b.ALPHA, b.BOUNDS)
        if out:
            return out
    own = parts(spark, d)
    return [surprise.decay(*own, h, h) for h in halflives]


@query(
    "kl_year_window",
    f"SELECT * REPLACE ({R('kl_past')} AS kl_past, {R('kl_future')} AS kl_future) FROM v_scores",
)
def kl_year_window(spark, d):
    return rounded(b.scores(spark, d), "kl_past", "kl_future")


@query(
    "kl_year_term_totals",
    """SELECT t.cls, t.year, t.term, t.tf, n.n_docs
    FROM (SELECT cls, year, term, CAST(sum(cnt) AS BIGINT) AS tf FROM v_terms GROUP BY ALL) t
    JOIN (SELECT cls, year, count(*) AS n_docs FROM v_corpus GROUP BY ALL) n USING (cls, year)""",
)
def kl_year_term_totals(spark, d):
    docs = b.corpus(spark, d)
    tf, n = surprise.period_totals(docs, b.doc_terms(spark, d, docs))
    return tf.join(n, ["cls", "year"]).select("cls", "year", "term", "tf", "n_docs")


# decayed references, by direct summation over earlier and later days
view("v_daily", "SELECT cls, filed, term, CAST(sum(cnt) AS DOUBLE) AS tf FROM v_terms JOIN v_vocab USING (cls, term) GROUP BY ALL")
view("v_dn", "SELECT cls, filed, CAST(count(*) AS DOUBLE) AS n FROM v_corpus WHERE length(body) > 0 GROUP BY ALL")


def _w(h: str, mult: int = 1) -> str:
    return f"pow(2.0, -{mult} * abs(date_diff('day', a.filed, x.filed)) / 365.25 / {h})"


def decay_views(tag: str, h: float) -> None:
    view(
        f"v_decay_ref{tag}",
        f"""SELECT a.cls, a.filed, a.term, coalesce(sum(x.tf * {_w(h)}) FILTER (WHERE x.filed < a.filed), 0) AS rp,
        coalesce(sum(x.tf * {_w(h)}) FILTER (WHERE x.filed > a.filed), 0) AS rf FROM v_daily a JOIN v_daily x ON x.cls = a.cls AND x.term = a.term GROUP BY ALL""",
    )
    both = lambda e, n: ", ".join(
        f"coalesce(sum({e}) FILTER (WHERE x.filed {op} a.filed), 0) AS {n}{s}" for s, op in (("p", "<"), ("f", ">"))
    )
    view(
        f"v_decay_tot{tag}",
        f"""WITH m AS (SELECT n.cls, n.filed, n.n, coalesce(t.m, 0) AS m FROM v_dn n LEFT JOIN (SELECT cls, filed, sum(tf) AS m FROM v_daily GROUP BY 1, 2) t USING (cls, filed))
        SELECT a.cls, a.filed, {both('x.m * ' + _w(h), 't')}, {both('x.n * ' + _w(h), 'w')}, {both('x.n * ' + _w(h, 2), 'v')}
        FROM m a JOIN m x ON x.cls = a.cls GROUP BY ALL""",
    )
    kl = lambda s: f"sum(p * (ln(p) - ln((r{s} + 1) / (t{s} + vs))))"
    view(
        f"v_decay{tag}",
        f"""WITH j AS (SELECT t.doc_id, t.cnt / CAST(sum(t.cnt) OVER (PARTITION BY t.doc_id) AS DOUBLE) AS p, r.rp, r.rf, x.* EXCLUDE (cls, filed),
          (SELECT count(*) FROM v_vocab v WHERE v.cls = t.cls) AS vs
          FROM v_terms t JOIN v_decay_ref{tag} r USING (cls, filed, term) JOIN v_decay_tot{tag} x USING (cls, filed))
        SELECT doc_id, count(*) AS n_terms, CASE WHEN max(wp) > 0 THEN {kl('p')} END AS kl_past, CASE WHEN max(wf) > 0 THEN {kl('f')} END AS kl_future,
        CASE WHEN max(wp) > 0 THEN max(wp) * max(wp) / max(vp) END AS n_eff_past, CASE WHEN max(wf) > 0 THEN max(wf) * max(wf) / max(vf) END AS n_eff_future
        FROM j GROUP BY doc_id""",
    )


decay_views("", 1.0)
decay_views("2", 0.5)


@query(
    "kl_decay",
    f"""SELECT c.doc_id, c.cls, c.year, coalesce(d.n_terms, 0) AS n_terms, {R('kl_past')} AS kl_past, {R('n_eff_past', 4)} AS n_eff_past,
    {R('kl_future')} AS kl_future, {R('n_eff_future', 4)} AS n_eff_future FROM v_corpus c LEFT JOIN v_decay d USING (doc_id) WHERE length(c.body) > 0""",
)
def kl_decay(spark, d):
    out = decayed(spark, d, [1.0])[0]
    out = rounded(rounded(out, "kl_past", "kl_future"), "n_eff_past", "n_eff_future", digits=4)
    return out.drop("filed", "owner", "mark")


@query(
    "kish_neff",
    f"""SELECT cls, {R('avg(n_eff_past)', 4)} AS mean_past, {R('max(n_eff_future)', 4)} AS max_future, count(n_eff_past) AS n_scored
    FROM v_decay JOIN v_corpus USING (doc_id) GROUP BY cls""",
)
def kish_neff(spark, d):
    out = decayed(spark, d, [1.0])[0]
    return out.groupBy("cls").agg(
        r(F.avg("n_eff_past"), 4).alias("mean_past"), r(F.max("n_eff_future"), 4).alias("max_future"),
        F.count("n_eff_past").alias("n_scored"),
    )


@query(
    "kl_halflife_sweep",
    " UNION ALL ".join(
        f"""SELECT {R(str(h))} AS halflife, count(*) AS n, {R('corr(kl_past - kl_future, quality)', 5)} AS corr_lead, {R('corr(kl_past, quality)', 5)} AS corr_past,
        {R('stddev_samp(kl_past - kl_future)', 5)} AS sd_lead, max(pseudo_r2) AS pseudo_r2
        FROM v_decay{t} JOIN labels USING (doc_id), (SELECT pseudo_r2 FROM {logit_sql(f"v_decay{t} JOIN labels USING (doc_id)", "quality", {"lead": "kl_past - kl_future"}, "m")} LIMIT 1)
        WHERE kl_past IS NOT NULL AND kl_future IS NOT NULL"""
        for h, t in ((1.0, ""), (0.5, "2"))
    ),
)
def kl_halflife_sweep(spark, d):
    y, out = b.quality(spark, d), None
    for h, s in zip((1.0, 0.5), decayed(spark, d, (1.0, 0.5))):
        s = s.withColumn("halflife", F.lit(h))
        out = s if out is None else out.unionByName(s)
    lead, good = F.col("kl_past") - F.col("kl_future"), F.col("good").cast("double")
    j = out.filter(lead.isNotNull()).join(y, "doc_id").select("halflife", lead.alias("lead"), "kl_past", good.alias("good"))
    j, fits = b.stage(j, "sweep"), None
    for h in (1.0, 0.5):
        one = regression.logit(j.filter(F.col("halflife") == h), "good", ["lead"]).filter(F.col("term") == "lead")
        one = one.select(F.lit(h).alias("halflife"), r("pseudo_r2", 4).alias("pseudo_r2"))
        fits = one if fits is None else fits.unionByName(one)
    return j.groupBy("halflife").agg(
        n_rows().alias("n"), r(correlation("lead", "good"), 5).alias("corr_lead"),
        r(correlation("kl_past", "good"), 5).alias("corr_past"), r(F.stddev_samp("lead"), 5).alias("sd_lead"),
    ).join(fits, "halflife")


@query(
    "kl_token_attribution",
    """SELECT doc_id, side, CAST(rank AS INTEGER) AS rank, term, part FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, side ORDER BY part DESC, term) AS rank FROM (
    SELECT doc_id, 'past' AS side, term, round(part_past, 9) + CAST(0 AS DOUBLE) AS part FROM v_parts UNION ALL
    SELECT doc_id, 'future', term, round(part_future, 9) + CAST(0 AS DOUBLE) FROM v_parts) WHERE part IS NOT NULL) WHERE rank <= 5""",
)
def kl_token_attribution(spark, d):
    docs = b.corpus(spark, d)
    if b.keys_unique(docs):
        terms = vocabulary.by_term(b.raw_terms(spark, d, docs, True).drop("filed"), b.corpus_slices(docs))
        own = surprise.corpus_term_contributions(docs, terms, b.stage, b.WINDOW, b.ALPHA, b.BOUNDS)
    else:
        own = surprise.term_contributions(*parts(spark, d), b.WINDOW)
    out = surprise.top_contributions(own, 5)
    return rounded(out, "part", digits=9)


@query(
    "kl_topic_year",
    f"""WITH s AS (SELECT cls, year, k, sum(theta) AS s, count(*) AS n FROM v_theta GROUP BY ALL),
    m AS (SELECT a.cls, a.year, a.k, sum(x.s) FILTER (WHERE x.year BETWEEN a.year - 2 AND a.year - 1) AS sp, sum(x.s) FILTER (WHERE x.year BETWEEN a.year + 1 AND a.year + 2) AS sf,
      count(*) FILTER (WHERE x.year BETWEEN a.year - 2 AND a.year - 1) AS yp, count(*) FILTER (WHERE x.year BETWEEN a.year + 1 AND a.year + 2) AS yf
      FROM s a JOIN s x USING (cls, k) GROUP BY a.cls, a.year, a.k),
    q AS (SELECT cls, year, k, sp / sum(sp) OVER w AS qp, sf / sum(sf) OVER w AS qf FROM m WHERE yp = 2 AND yf = 2 WINDOW w AS (PARTITION BY cls, year))
    SELECT doc_id, t.cls, t.year, {R('sum(theta * (ln(theta) - ln(qp)))')} AS kl_past, {R('sum(theta * (ln(theta) - ln(qf)))')} AS kl_future
    FROM v_theta t LEFT JOIN q ON q.cls = t.cls AND q.year = t.year AND q.k = t.k GROUP BY 1, 2, 3""",
)
def kl_topic_year(spark, d):
    out = topics.year_scores(b.theta_arrays(spark, d), 2)
    return rounded(out, "kl_past", "kl_future").drop("filed", "n_past", "n_future")


@query(
    "kl_topic_rolling",
    f"SELECT doc_id, cls, year, {R('kl_past')} AS kl_past, n_past, {R('kl_future')} AS kl_future, n_future FROM v_rolling",
)
def kl_topic_rolling(spark, d):
    return rounded(b.rolling(spark, d), "kl_past", "kl_future").drop("filed")


@query(
    "score_quality_mask",
    f"SELECT doc_id, scored, {R('kl_past')} AS kl_past, {R('kl_future')} AS kl_future, {R('lead')} AS lead FROM v_masked",
)
def score_quality_mask(spark, d):
    m = rounded(b.masked(spark, d), "kl_past", "kl_future", "lead")
    return m.select("doc_id", "scored", "kl_past", "kl_future", "lead")


@query(
    "score_axes",
    f"""SELECT doc_id, {R('(kl_past + kl_future) / 2', 5)} AS level, {R('kl_past - kl_future')} AS lead, {R('abs(kl_past - kl_future)')} AS abs_lead,
    {R('kl_past - (kl_past - kl_future) / 2', 5)} AS level_again FROM v_scores WHERE kl_past IS NOT NULL AND kl_future IS NOT NULL""",
)
def score_axes(spark, d):
    s = surprise.axes(b.scores(spark, d)).filter(F.col("lead").isNotNull())
    again = F.col("kl_past") - F.col("lead") / 2
    out = s.select("doc_id", "level", "lead", "abs_lead", again.alias("level_again"))
    return rounded(rounded(out, "lead", "abs_lead"), "level", "level_again", digits=5)


@query("clean_filter", "SELECT doc_id, n_terms, n_past, n_future FROM v_clean")
def clean_filter(spark, d):
    return surprise.clean(b.scores(spark, d), **b.CLEAN).select("doc_id", "n_terms", "n_past", "n_future")


_CL = {"past": "n_past >= 20", "future": "n_future >= 20", "terms": "n_terms >= 3",
       "scored": "kl_past IS NOT NULL AND kl_future IS NOT NULL"}


@query(
    "clean_filter_audit",
    " UNION ALL ".join(
        f"""SELECT count(*) AS n_rows, '{n}' AS clause, count(*) FILTER (WHERE {c}) AS alone,
        count(*) FILTER (WHERE {' AND '.join(list(_CL.values())[: i + 1])}) AS cumulative,
        count(*) FILTER (WHERE {' AND '.join(v for k, v in _CL.items() if k != n)}) AS left_out FROM v_scores"""
        for i, (n, c) in enumerate(_CL.items())
    ),
)
def clean_filter_audit(spark, d):
    return surprise.clean_audit(b.scores(spark, d), **b.CLEAN)


@query(
    "forward_coverage",
    f"""WITH n AS (SELECT cls, year, count(*) AS n FROM v_corpus GROUP BY 1, 2),
    e AS (SELECT cls, max(year) AS y1 FROM n GROUP BY 1),
    f AS (SELECT e.cls, CASE WHEN a.n < 0.5 * z.n THEN e.y1 - 1 ELSE e.y1 END AS last, CASE WHEN a.n < 0.5 * z.n THEN z.n ELSE a.n END AS rate
      FROM e JOIN n a ON a.cls = e.cls AND a.year = e.y1 LEFT JOIN n z ON z.cls = e.cls AND z.year = e.y1 - 1),
    x AS (SELECT n.cls, n.year, j, o.n AS obs, CASE WHEN n.year + j <= f.last THEN coalesce(o.n, f.rate) ELSE f.rate END AS full
      FROM n JOIN f USING (cls) CROSS JOIN (SELECT unnest(range(1, 6)) AS j) LEFT JOIN n o ON o.cls = n.cls AND o.year = n.year + j)
    SELECT cls, year, {R('coalesce(sum(obs), 0) / CAST(sum("full") AS DOUBLE)')} AS coverage FROM x GROUP BY 1, 2""".replace("END AS full", 'END AS "full"'),
)
def forward_coverage(spark, d):
    n = b.corpus(spark, d).groupBy("cls", "year").agg(n_rows().alias("n"))
    return rounded(surprise.forward_coverage(n, 5), "coverage")


for _w_days in (180, 365):
    view(f"v_sweep{_w_days}", b.rolling_sql(_w_days))
view(
    "v_sweep",
    " UNION ALL ".join(
        f"""SELECT doc_id, {w} AS days, round(kl_past, 9) - round(kl_future, 9) AS lead, quality = 1 AS good FROM v_sweep{w} JOIN labels USING (doc_id)
        WHERE kl_past IS NOT NULL AND kl_future IS NOT NULL"""
        for w in (180, 365)
    ),
)


@query("kl_window_sweep", lift_sql(qbin_sql("v_sweep", "lead", 5, "days"), "good", "days"))
def kl_window_sweep(spark, d):
    y, out = b.quality(spark, d), None
    theta = b.stage(b.theta_arrays(spark, d), "theta")
    for w in (180, 365):
        s = rounded(topics.rolling_scores(theta, w), "kl_past", "kl_future", digits=9)
        s = s.select("doc_id", F.lit(w).alias("days"), (F.col("kl_past") - F.col("kl_future")).alias("lead"))
        out = s if out is None else out.unionByName(s)
    rows = b.stage(out.filter(F.col("lead").isNotNull()).join(y, "doc_id"), "sweep")
    return lift_out(outcomes.lift_by(rows, "lead", "good", ["days"]))


for _w_years in (1, 3):
    view(f"v_ref_w{_w_years}", b.year_refs_sql(_w_years))
    view(f"v_tot_w{_w_years}", b.year_totals_sql(_w_years))
    view(f"v_parts_w{_w_years}", b.parts_sql(f"v_ref_w{_w_years}", f"v_tot_w{_w_years}"))
    view(f"v_scores_w{_w_years}", b.scores_sql(f"v_parts_w{_w_years}"))


@query(
    "kl_asymmetric_windows",
    f"""SELECT a.doc_id, {R('a.kl_past - a.kl_future')} AS sym1, {R('m.kl_past - m.kl_future')} AS sym2, {R('z.kl_past - z.kl_future')} AS sym3,
    {R('a.kl_past - z.kl_future')} AS asym13, {R('z.kl_past - a.kl_future')} AS asym31 FROM v_scores_w1 a JOIN v_scores m USING (doc_id) JOIN v_scores_w3 z USING (doc_id)
    WHERE a.kl_past IS NOT NULL AND a.kl_future IS NOT NULL AND a.n_terms >= 3""",
)
def kl_asymmetric_windows(spark, d):
    # all widths in one pass over the terms instead of three score tables joined
    spans = {}
    for w in (1, 2, 3):
        spans[f"past{w}"], spans[f"future{w}"] = (-w, -1), (1, w)
    s = rounded(b.span_scores(spark, d, spans), *[f"kl_{x}" for x in spans], digits=9)
    s = s.filter(F.col("kl_past1").isNotNull() & F.col("kl_future1").isNotNull() & (F.col("n_terms") >= 3))

    def diff(p, f):
        return r(F.col(f"kl_past{p}") - F.col(f"kl_future{f}"))

    return s.select(
        "doc_id", *[diff(w, w).alias(f"sym{w}") for w in (1, 2, 3)],
        diff(1, 3).alias("asym13"), diff(3, 1).alias("asym31"),
    )


view(
    "v_month",
    """WITH t AS (SELECT t.*, year(filed) * 12 + month(filed) - 1 AS m FROM v_terms t),
    tf AS (SELECT cls, m, term, sum(cnt) AS tf FROM t JOIN v_vocab USING (cls, term) GROUP BY ALL),
    rf AS (SELECT a.cls, a.m, a.term, coalesce(sum(x.tf) FILTER (WHERE x.m BETWEEN a.m - 12 AND a.m - 1), 0) AS rn,
      coalesce(sum(x.tf) FILTER (WHERE x.m BETWEEN a.m - 24 AND a.m - 13), 0) AS rr FROM tf a JOIN tf x USING (cls, term) GROUP BY a.cls, a.m, a.term),
    cm AS (SELECT cls, year(filed) * 12 + month(filed) - 1 AS m, count(*) AS n FROM v_corpus WHERE length(body) > 0 GROUP BY ALL),
    ms AS (SELECT cm.*, coalesce(s.s, 0) AS s FROM cm LEFT JOIN (SELECT cls, m, sum(tf) AS s FROM tf GROUP BY ALL) s USING (cls, m)),
    tt AS (SELECT a.cls, a.m, min(x.m) AS m0, sum(x.s) FILTER (WHERE x.m BETWEEN a.m - 12 AND a.m - 1) AS tn, sum(x.s) FILTER (WHERE x.m BETWEEN a.m - 24 AND a.m - 13) AS tr
      FROM ms a JOIN ms x USING (cls) GROUP BY a.cls, a.m),
    j AS (SELECT t.doc_id, t.cls, t.m, t.cnt, t.cnt / CAST(sum(t.cnt) OVER (PARTITION BY t.doc_id) AS DOUBLE) AS p, rn, rr, m0, CAST(tn AS DOUBLE) AS tn, CAST(tr AS DOUBLE) AS tr,
      (SELECT count(*) FROM v_vocab v WHERE v.cls = t.cls) AS vs FROM t JOIN rf USING (cls, m, term) JOIN tt USING (cls, m))
    SELECT doc_id, cls, count(*) AS n_terms, sum(p * (ln(p) - ln((rn + 1) / (tn + vs)))) AS kl_near, sum(p * (ln(p) - ln((rr + 1) / (tr + vs)))) AS kl_far
    FROM j GROUP BY doc_id, cls HAVING sum(cnt) >= 3 AND max(m) - max(m0) >= 24""",
)


@query(
    "kl_monthly_freshness",
    f"SELECT doc_id, cls, n_terms, {R('kl_near')} AS kl_near, {R('kl_far')} AS kl_far, {R('kl_far - kl_near')} AS freshness FROM v_month",
)
def kl_monthly_freshness(spark, d):
    docs = b.corpus(spark, d)
    if b.keys_unique(docs):
        out = surprise.corpus_monthly_freshness(docs, b.doc_terms(spark, d, docs, True), b.stage, bounds=b.BOUNDS)
    else:
        out = surprise.monthly_freshness(*parts(spark, d))
    return rounded(out, "kl_near", "kl_far", "freshness")


view(
    "v_borrowed",
    f"""WITH tf AS (SELECT cls, year, term, sum(cnt) AS tf FROM v_terms JOIN v_vocab_all USING (term) GROUP BY ALL),
    pool AS (SELECT year, term, sum(tf) AS tf FROM tf GROUP BY ALL),
    ow AS (SELECT a.cls, a.year, a.term, coalesce(sum(x.tf) FILTER (WHERE x.year BETWEEN a.year - 2 AND a.year - 1), 0) AS rw FROM tf a JOIN tf x USING (cls, term) GROUP BY a.cls, a.year, a.term),
    cr AS (SELECT a.year, a.term, coalesce(sum(x.tf) FILTER (WHERE x.year BETWEEN a.year - 2 AND a.year - 1), 0) AS rc FROM pool a JOIN pool x USING (term) GROUP BY a.year, a.term),
    cy AS (SELECT cls, year, sum(tf) AS m FROM tf GROUP BY ALL),
    tw AS (SELECT a.cls, a.year, sum(x.m) FILTER (WHERE x.year BETWEEN a.year - 2 AND a.year - 1) AS tw FROM cy a JOIN cy x USING (cls) GROUP BY a.cls, a.year),
    yy AS (SELECT year, sum(m) AS m FROM cy GROUP BY year),
    tc AS (SELECT a.year, sum(x.m) AS tc FROM yy a LEFT JOIN yy x ON x.year BETWEEN a.year - 2 AND a.year - 1 GROUP BY a.year),
    j AS (SELECT t.doc_id, t.cls, t.year, t.cnt / CAST(sum(t.cnt) OVER (PARTITION BY t.doc_id) AS DOUBLE) AS p, rw, rc, CAST(tw AS DOUBLE) AS tw, CAST(tc AS DOUBLE) AS tc,
      (SELECT count(*) FROM v_vocab_all) AS vs FROM v_terms t JOIN ow USING (cls, year, term) JOIN cr USING (year, term) JOIN tw USING (cls, year) JOIN tc USING (year))
    SELECT doc_id, cls, year, n_terms, kw AS kl_within, kc AS kl_cross, round(kw - kc, 9) AS gap FROM (
    SELECT doc_id, cls, year, count(*) AS n_terms, round(sum(p * (ln(p) - ln((rw + 1) / (tw + vs)))), 9) AS kw,
    round(sum(p * (ln(p) - ln((rc + 1) / (tc + vs)))), 9) AS kc FROM j GROUP BY 1, 2, 3)""",
)


def borrowed(spark, d):
    docs = b.corpus(spark, d)
    if b.keys_unique(docs):
        out = surprise.corpus_borrowed_novelty(docs, b.doc_terms(spark, d, docs, True), b.stage, b.WINDOW, b.ALPHA, b.BOUNDS)
    else:
        terms = b.doc_terms(spark, d, docs, False)
        v = vocabulary.build_vocabulary(docs, terms, b.MIN_DF, 0.5, by=())
        out = surprise.borrowed_novelty(docs, terms, v, b.WINDOW)
    out = rounded(out, "kl_within", "kl_cross", digits=9)
    return out.withColumn("gap", F.round(F.col("kl_within") - F.col("kl_cross"), 9))


@query(
    "kl_borrowed_novelty",
    f"SELECT doc_id, cls, year, n_terms, {R('kl_within')} AS kl_within, {R('kl_cross')} AS kl_cross, {R('gap')} AS gap FROM v_borrowed",
)
def kl_borrowed_novelty(spark, d):
    return rounded(borrowed(spark, d).drop("owner"), "kl_within", "kl_cross", "gap")


@query(
    "borrowed_quadrants",
    f"""WITH s AS (SELECT * FROM v_borrowed WHERE kl_within IS NOT NULL AND kl_cross IS NOT NULL), m AS (SELECT median(kl_within) AS w, median(kl_cross) AS c FROM s)
    SELECT cls, count(*) AS n, {R('avg(CAST(kl_within > w AND kl_cross <= c AS DOUBLE))')} AS borrowed, {R('avg(CAST(kl_within > w AND kl_cross > c AS DOUBLE))')} AS born_new,
    {R('avg(gap)')} AS mean_gap, arg_min(doc_id, (-gap, doc_id)) FILTER (WHERE kl_cross <= c AND n_terms >= 10) AS top_doc FROM s, m GROUP BY cls""",
)
def borrowed_quadrants(spark, d):
    s = borrowed(spark, d).filter(F.col("kl_within").isNotNull() & F.col("kl_cross").isNotNull())
    s = b.stage(s, "borrowed")
    for c, n in (("kl_within", "_w"), ("kl_cross", "_c")):
        s = ranking.with_quantiles(s, c, [0.5], [n])
    high, low = F.col("kl_within") > F.col("_w"), F.col("kl_cross") <= F.col("_c")
    top = F.min(F.when(low & (F.col("n_terms") >= 10), F.struct((-F.col("gap")).alias("g"), "doc_id"))).doc_id
    return s.groupBy("cls").agg(
        n_rows().alias("n"), r(share(high & low)).alias("borrowed"), r(share(high & ~low)).alias("born_new"),
        r(F.avg("gap")).alias("mean_gap"), top.alias("top_doc"),
    )


view(
    "v_novel",
    """WITH f AS (SELECT cls, term, min(year) AS y0 FROM v_tf GROUP BY 1, 2)
    SELECT doc_id, CAST(sum(cnt) AS BIGINT) AS n_tokens, coalesce(sum(cnt) FILTER (WHERE y0 >= year - 1), 0) / CAST(sum(cnt) AS DOUBLE) AS novel_share
    FROM v_terms JOIN f USING (cls, term) GROUP BY doc_id""",
)
view("v_novel_lead", "SELECT n.*, s.lead FROM v_novel n JOIN v_clean s USING (doc_id) WHERE n_tokens >= 10")


@query(
    "novel_share_provenance",
    f"""SELECT bin, count(*) AS n, {R('avg(novel_share)')} AS mean_novel, {R('avg(lead)')} AS mean_lead FROM ({qbin_sql('v_novel_lead', 'novel_share', 5)}) GROUP BY bin""",
)
def novel_share_provenance(spark, d):
    _, terms, vocab = parts(spark, d)
    n = surprise.novel_share(terms, vocab, 1).filter(F.col("n_tokens") >= 10)
    j = b.stage(n.join(b.clean_scores(spark, d).select("doc_id", "lead"), "doc_id"), "novel")
    return ranking.quantile_bin(j, "novel_share", 5).groupBy("bin").agg(
        n_rows().alias("n"), r(F.avg("novel_share")).alias("mean_novel"), r(F.avg("lead")).alias("mean_lead")
    )


@query(
    "vocab_forensics",
    f"""WITH o AS (SELECT DISTINCT term FROM v_vocab WHERE cls = 'en')
    SELECT doc_id, CAST(sum(cnt) AS BIGINT) AS n_tokens, CAST(coalesce(sum(cnt) FILTER (WHERE o.term IS NULL), 0) AS BIGINT) AS n_outside,
    {R('coalesce(sum(cnt) FILTER (WHERE o.term IS NULL), 0) / CAST(sum(cnt) AS DOUBLE)')} AS outside_share
    FROM v_terms JOIN v_vocab USING (cls, term) LEFT JOIN o ON o.term = v_terms.term GROUP BY doc_id""",
)
def vocab_forensics(spark, d):
    _, terms, vocab = parts(spark, d)
    other = vocab.filter(F.col("cls") == "en")
    return rounded(vocabulary.outside_share(vocabulary.count_matrix(terms, vocab), other), "outside_share")


@query(
    "encoding_exhibit",
    """WITH top AS (SELECT t.doc_id, t.term, t.cnt, v.doc_freq, v.term IS NULL AS oov, row_number() OVER (PARTITION BY t.doc_id ORDER BY t.cnt DESC, t.term) AS rn
      FROM v_terms t LEFT JOIN v_vocab v USING (cls, term)), k AS (SELECT doc_id, string_agg(CAST(k AS VARCHAR), ',' ORDER BY rn) AS topics, sum(theta) AS topic_share FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(theta, 12) DESC, k) AS rn FROM v_theta) WHERE rn <= 3 GROUP BY 1)
    SELECT doc_id, CAST(rn AS INTEGER) AS rank, term, cnt, doc_freq, oov, topics, """ + R("topic_share") + """ AS topic_share FROM top JOIN k USING (doc_id) WHERE rn <= 3""",
)
def encoding_exhibit(spark, d):
    from ..operators.exhibits import encodings

    _, terms, vocab = parts(spark, d)
    return rounded(encodings(terms, vocab, b.theta(spark, d), 3), "topic_share")


@query(
    "vocab_turnover",
    f"""WITH y AS (SELECT DISTINCT cls, term, year FROM v_terms), f AS (SELECT a.cls, a.year, a.term, bool_or(x.year IS NOT NULL) AS seen
      FROM y a LEFT JOIN y x ON x.cls = a.cls AND x.term = a.term AND x.year BETWEEN a.year - 2 AND a.year - 1 GROUP BY ALL),
    t AS (SELECT cls, year, count(*) AS n_types, avg(CAST(NOT seen AS DOUBLE)) AS turnover FROM f GROUP BY 1, 2),
    n AS (SELECT cls, year, count(*) AS n_docs FROM v_corpus WHERE length(body) > 0 GROUP BY 1, 2),
    p AS (SELECT a.cls, a.year, a.n_docs, coalesce(sum(x.n_docs), 0) AS prior FROM n a LEFT JOIN n x ON x.cls = a.cls AND x.year BETWEEN a.year - 2 AND a.year - 1 GROUP BY ALL)
    SELECT cls, year, n_docs, {R('ln(1 + n_docs) - ln(1 + prior / 2.0)')} AS growth, n_types, {R('turnover')} AS turnover FROM p LEFT JOIN t USING (cls, year)""",
)
def vocab_turnover(spark, d):
    docs = b.corpus(spark, d)
    return rounded(surprise.turnover(docs, b.doc_terms(spark, d, docs), 2), "growth", "turnover")


@query(
    "burnin_end",
    f"""WITH y AS (SELECT cls, year, count(*) AS n, avg(lead) AS m FROM v_scored GROUP BY 1, 2 HAVING count(*) >= 10),
    s AS (SELECT cls, median(m) FILTER (WHERE year BETWEEN 1997 AND 2000) AS ref, greatest(0.02, 3 * stddev_pop(m) FILTER (WHERE year BETWEEN 1997 AND 2000)) AS band,
      min(year) AS first_year FROM y GROUP BY cls HAVING count(*) FILTER (WHERE year BETWEEN 1997 AND 2000) >= 3),
    j AS (SELECT y.cls, y.year, abs(m - ref) <= band AS ok FROM y JOIN s USING (cls)),
    g AS (SELECT a.cls, min(a.year) AS burnin_end FROM j a JOIN j p ON p.cls = a.cls AND p.year = a.year + 1 JOIN j q ON q.cls = a.cls AND q.year = a.year + 2 WHERE a.ok AND p.ok AND q.ok GROUP BY a.cls)
    SELECT cls, first_year, {R('ref')} AS ref_level, {R('band')} AS band, burnin_end FROM s LEFT JOIN g USING (cls)""",
)
def burnin_end(spark, d):
    out = surprise.burnin_end(b.scored_cases(spark, d), (1997, 2000), min_docs=10, min_stable=3)
    return rounded(out, "ref_level", "band")


_RES = ", ".join(
    f"{R(f'kl_{s} - (regr_intercept(kl_{s}, x) OVER (PARTITION BY cls) + regr_slope(kl_{s}, x) OVER (PARTITION BY cls) * x)', 5)} AS resid_{s}"
    for s in ("past", "future")
)


@query("length_residualise", f"SELECT case_id, {_RES} FROM (SELECT *, ln(n_terms) AS x FROM v_scored)")
def length_residualise(spark, d):
    s = b.scored_cases(spark, d).withColumn("log_n", F.log("n_terms"))
    out = audits.residualise(s, ["kl_past", "kl_future"], "log_n", ["cls"])
    return out.select(
        "case_id", r("kl_past_resid", 5).alias("resid_past"), r("kl_future_resid", 5).alias("resid_future")
    )


view(
    "v_two",
    """SELECT a.doc_id, a.n_terms, a.filed, a.lead AS l1, b.lead AS l2 FROM v_clean a JOIN v_masked b USING (doc_id) WHERE b.lead IS NOT NULL""",
)


@query(
    "length_reliability",
    f"""SELECT CASE WHEN n_terms < 5 THEN '1:<5' WHEN n_terms < 15 THEN '2:5-14' WHEN n_terms < 40 THEN '3:15-39' ELSE '4:40+' END AS length, count(*) AS n,
    {R('avg(abs(l1))')} AS mean_abs, {R('avg(abs(l2))')} AS mean_abs_other, {R('avg(CAST(sign(l1) <> sign(l2) AS DOUBLE))')} AS flip_rate FROM v_two GROUP BY 1""",
)
def length_reliability(spark, d):
    other = b.masked(spark, d).filter(F.col("lead").isNotNull())
    out = audits.length_reliability(b.clean_scores(spark, d), other)
    return rounded(out, "mean_abs", "mean_abs_other", "flip_rate")


@query(
    "score_summary",
    " UNION ALL ".join(
        f"""SELECT cls, {year} AS year, count(*) AS n, {R('avg(lead)')} AS mean, {R('stddev_samp(lead)')} AS sd, {R('avg(CAST(lead > 0 AS DOUBLE))')} AS share_positive,
        {R('avg(abs(lead))')} AS mean_abs, {R('CASE WHEN count(*) > 2 THEN corr(kl_past, kl_future) END')} AS corr_sides, {R('quantile_cont(lead, 0.1)')} AS p10, {R('quantile_cont(lead, 0.5)')} AS p50,
        {R('quantile_cont(lead, 0.9)')} AS p90, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY hi) FILTER (WHERE hi <= 3) AS highest,
        string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY lo) FILTER (WHERE lo <= 3) AS lowest
        FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY lead DESC, doc_id) AS hi, row_number() OVER (PARTITION BY {by} ORDER BY lead, doc_id) AS lo FROM v_clean) GROUP BY {by}"""
        for year, by in (("CAST(NULL AS INTEGER)", "cls"), ("year", "cls, year"))
    ),
)
def score_summary(spark, d):
    """Each class as a whole and by year, with its three highest and lowest documents."""
    s, out = b.clean_scores(spark, d), None
    for by in (["cls"], ["cls", "year"]):
        ends = audits.extremes(s, "lead", "doc_id", 3, by)
        ids = lambda side: F.array_join(F.transform(
            F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("rank", "doc_id")))), lambda x: x["doc_id"].cast("string")
        ), ",")
        ends = ends.groupBy(*by).agg(ids("high").alias("highest"), ids("low").alias("lowest"))
        part = audits.summary(s, "lead", by).join(ends, by)
        part = part.withColumn("corr_sides", F.when(F.col("n") > 2, F.col("corr_sides")))
        part = part if "year" in by else part.withColumn("year", F.lit(None).cast("int"))
        out = part if out is None else out.unionByName(part)
    return rounded(out, "mean", "sd", "share_positive", "mean_abs", "corr_sides", "p10", "p50", "p90")


from .relational import mid_rank_sql  # noqa: E402


@query(
    "scoring_compare",
    f"""SELECT CAST(NULL AS DATE) AS month, count(*) AS n, {R('corr(l1, l2)')} AS pearson, {R('corr(CAST(r1 AS DOUBLE), CAST(r2 AS DOUBLE))')} AS spearman, {R('avg(l1)')} AS mean_a, {R('avg(l2)')} AS mean_b,
    {R('stddev_samp(l1)')} AS sd_a, {R('stddev_samp(l2)')} AS sd_b FROM (SELECT *, {mid_rank_sql('l1')} AS r1, {mid_rank_sql('l2')} AS r2 FROM v_two)
    UNION ALL SELECT CAST(date_trunc('month', filed) AS DATE), count(*), {R('CASE WHEN count(*) > 2 THEN corr(l1, l2) END')}, CAST(NULL AS DOUBLE), {R('avg(l1)')}, {R('avg(l2)')}, {R('stddev_samp(l1)')}, {R('stddev_samp(l2)')}
    FROM v_two GROUP BY 1""",
)
def scoring_compare(spark, d):
    """The two scorings over all documents, and month by month."""
    one, two = b.clean_scores(spark, d), b.masked(spark, d)
    out = audits.compare_scorings(one, two).withColumn("month", F.lit(None).cast("date"))
    out = out.unionByName(audits.compare_by(one, two, F.trunc("filed", "month").alias("month")), allowMissingColumns=True)
    return rounded(out, "pearson", "spearman", "mean_a", "mean_b", "sd_a", "sd_b")


@query(
    "series_quantiles_by_year",
    f"""SELECT cls, year, {', '.join(f"{R(f'quantile_cont(kl_{s}, {q})')} AS {s}_{n}" for s in ('past', 'future') for n, q in (('q1', .25), ('q2', .5), ('q3', .75)))}
    FROM v_scored GROUP BY 1, 2""",
)
def series_quantiles_by_year(spark, d):
    s, out = b.scored_cases(spark, d), None
    for side in ("past", "future"):
        names = [f"{side}_q{i}" for i in (1, 2, 3)]
        q = rounded(ranking.quantiles(s, f"kl_{side}", [0.25, 0.5, 0.75], ["cls", "year"], names), *names)
        out = q if out is None else out.join(q, ["cls", "year"])
    return out


@query(
    "corpus_turbulence",
    f"""WITH g AS (SELECT cls, year, count(*) AS n, avg(kl_past) AS m FROM v_scores WHERE n_terms >= 3 AND n_past >= 20 AND kl_past IS NOT NULL GROUP BY 1, 2)
    SELECT cls, year, n, {R('m')} AS mean_past FROM g UNION ALL SELECT 'all', year, CAST(sum(n) AS BIGINT), {R('sum(m * n) / sum(n)')} FROM g GROUP BY year""",
)
def corpus_turbulence(spark, d):
    s = b.scores(spark, d).filter((F.col("n_terms") >= 3) & (F.col("n_past") >= 20) & F.col("kl_past").isNotNull())
    g = s.groupBy("cls", "year").agg(n_rows().alias("n"), F.avg("kl_past").alias("m"))
    pooled = g.groupBy("year").agg(
        F.sum("n").alias("k"), (F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("m")
    ).select(F.lit("all").alias("cls"), "year", F.col("k").alias("n"), "m")
    return g.unionByName(pooled).select("cls", "year", "n", r("m").alias("mean_past"))


@query(
    "class_gap_series",
    f"""SELECT cls, year, count(*) AS n, {R('avg(lead)')} AS mean, {R('stddev_samp(lead)')} AS sd, {R('avg(abs(lead))')} AS mean_abs, {R('avg(CAST(lead > 0 AS DOUBLE))')} AS share_positive
    FROM v_clean GROUP BY 1, 2""",
)
def class_gap_series(spark, d):
    kept = surprise.axes(surprise.clean(b.scores(spark, d), **b.CLEAN))
    lead = F.col("lead")
    return kept.groupBy("cls", "year").agg(
        n_rows().alias("n"), r(F.avg(lead)).alias("mean"), r(F.stddev_samp(lead)).alias("sd"),
        r(F.avg(F.abs(lead))).alias("mean_abs"), r(share(lead > 0)).alias("share_positive"),
    )
