"""Topic-model and theme queries."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions.scalars import share
from ..operators import ranking, themes, topic_models as tm, topics, vocabulary
from . import bindings as b
from .bins import n_rows
from .registry import R, query, r, rounded, view
from .relational import mid_rank_sql

TAU, FLOOR = 0.22, 10
# The fits as surveyed: passes and batch of LDA; most updates and tolerance of NMF.
PASSES, BATCH = 8, 2048
UPDATES, TOLERANCE = 200, 1e-3
MIN_DOCS, MAX_SHARE = 5, 0.5  # of a term in the vocabulary

_fits: dict[tuple[str, str], tuple] = {}


def fitted(spark, d):
    """LDA over all documents and their whole vocabulary in eight passes, fitted once a session
    for the queries that read it: the documents, the model and their theta."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _fits:
        docs = b.stage(b.corpus(spark, d).select("doc_id", "cls", "filed", "year", "body"), "lda-docs")
        terms = b.stage(b.raw_terms(spark, d, docs), "lda-terms")
        vocab = vocabulary.build_vocabulary(docs, terms, MIN_DOCS, MAX_SHARE, [])
        counts = b.stage(vocabulary.count_matrix(terms, vocab, []).select("doc_id", "term", "cnt"), "lda-counts")
        model = tm.fit_lda(counts, b.TOPICS, b.stage, passes=PASSES, batch=BATCH)
        _fits[key] = docs, model, b.stage(tm.theta_table(model), "lda-theta")
    return _fits[key]


@query(
    "sample_stratified",
    """SELECT doc_id, cls, year FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY md5(doc_id || ':42'), doc_id) AS rn FROM v_corpus) WHERE rn <= 50""",
)
def sample_stratified(spark, d):
    docs = b.corpus(spark, d).select("doc_id", "cls", "year")
    return tm.stratified_sample(docs, ["cls"], "doc_id", 50)


@query("lda_fit")
def lda_fit(spark, d):
    _, _, theta = fitted(spark, d)
    return rounded(tm.topic_sizes(theta), "tokens", "share", digits=4)


@query("lda_transform")
def lda_transform(spark, d):
    """Theta of every document; one without a term of the vocabulary is uniform."""
    docs, _, theta = fitted(spark, d)
    even = F.array_repeat(F.lit(1.0 / b.TOPICS), b.TOPICS)
    t = docs.select("doc_id", "cls", "year").join(theta.drop("n_tokens"), "doc_id", "left").withColumn("theta", F.coalesce("theta", even))
    return t.select("doc_id", "cls", "year", F.transform("theta", lambda x: r(x, 6)).alias("theta"), r(F.array_max("theta"), 4).alias("top_weight"))


@query("topic_top_words")
def topic_top_words(spark, d):
    _, model, _ = fitted(spark, d)
    return rounded(tm.topic_words(model, 10), "weight")


@query("nmf_fit")
def nmf_fit(spark, d):
    _, w = b.tfidf(spark, d)
    factors, _, _ = tm.nmf(w, b.TOPICS, b.stage, UPDATES, TOLERANCE)
    return rounded(tm.heaviest_factor(factors), "top_weight", digits=4)


view("v_top", "SELECT doc_id, cls, filed, year, k AS top_topic, theta AS top_weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(theta, 12) DESC, k) AS rn FROM v_theta) WHERE rn = 1")


def theta_top(spark, d, arrays=None):
    """Theta (over a stage table) and each document's top topic."""
    t = b.theta(spark, d, arrays)
    return t, topics.top_topic(t.withColumn("theta", F.round("theta", 12)))


@query("topic_assign", f"SELECT doc_id, CAST(top_topic AS INTEGER) AS top_topic, {R('top_weight')} AS top_weight FROM v_top")
def topic_assign(spark, d):
    return rounded(theta_top(spark, d)[1].select("doc_id", "top_topic", "top_weight"), "top_weight")


view(
    "v_panel",
    f"""SELECT t.k AS theme, t.cls, t.year, count(*) AS n_cy, avg(CAST(t.k = p.top_topic AS DOUBLE)) AS share_top, avg(CAST(t.theta >= {TAU} AS DOUBLE)) AS share_tau, avg(t.theta) AS mean_theta
    FROM v_theta t JOIN v_top p USING (doc_id) GROUP BY 1, 2, 3 HAVING count(*) >= {FLOOR}""",
)


def pan(spark, d):
    t, top = theta_top(spark, d)
    return b.stage(themes.panel(t, top, TAU, FLOOR), "panel")


@query(
    "theme_panel",
    f"SELECT theme, cls, year, n_cy, {R('share_top')} AS share_top, {R('share_tau')} AS share_tau, {R('mean_theta')} AS mean_theta FROM v_panel",
)
def theme_panel(spark, d):
    return rounded(pan(spark, d), "share_top", "share_tau", "mean_theta")


@query(
    "theme_shuffle_null",
    f"""SELECT theme, cls, count(*) AS n_pairs, {R('corr(mean_theta, p)', 5)} AS ar1 FROM (SELECT *, lag(mean_theta) OVER (PARTITION BY theme, cls ORDER BY year) AS p FROM v_panel)
    WHERE p IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 4""",
)
def theme_shuffle_null(spark, d):
    return rounded(themes.autocorrelation(pan(spark, d), "mean_theta"), "ar1", digits=5)


def top_ar1_sql(source: str) -> str:
    """Lag-1 autocorrelation of each theme's yearly share of labels."""
    return f"""SELECT theme, cls, CASE WHEN NOT isnan(a) THEN a END AS ar1 FROM (SELECT theme, cls, corr(v, p) AS a FROM (
      SELECT *, lag(v) OVER (PARTITION BY theme, cls ORDER BY year) AS p FROM (SELECT h.theme, n.cls, n.year, coalesce(c.c, 0) / CAST(n.n AS DOUBLE) AS v
        FROM (SELECT DISTINCT top_topic AS theme, cls FROM {source}) h JOIN (SELECT cls, year, count(*) AS n FROM {source} GROUP BY 1, 2 HAVING count(*) >= {FLOOR}) n USING (cls)
        LEFT JOIN (SELECT top_topic AS theme, cls, year, count(*) AS c FROM {source} GROUP BY 1, 2, 3) c ON c.theme = h.theme AND c.cls = n.cls AND c.year = n.year))
      WHERE p IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 4)"""


for _seed in range(5):
    view(
        f"v_shuffle{_seed}",
        f"""SELECT a.* REPLACE (l.t AS top_topic) FROM (SELECT *, row_number() OVER (ORDER BY md5(doc_id || ':{_seed}'), doc_id) AS seq FROM v_top) a
        JOIN (SELECT row_number() OVER (ORDER BY md5(doc_id || ':{-_seed - 1}'), doc_id) AS seq, top_topic AS t FROM v_top) l USING (seq)""",
    )


@query(
    "theme_shuffle_null_z",
    f"""SELECT CAST(x.theme AS INTEGER) AS theme, x.cls, {R('x.ar1', 4)} AS ar1, {R('(x.ar1 - m) / nullif(s, 0)', 4)} AS z FROM ({top_ar1_sql('v_top')}) x
    JOIN (SELECT theme, cls, avg(ar1) AS m, stddev_samp(ar1) AS s FROM ({' UNION ALL '.join(top_ar1_sql(f'v_shuffle{i}') for i in range(5))}) GROUP BY 1, 2) n
    ON n.theme = x.theme AND n.cls = x.cls""",
)
def theme_shuffle_null_z(spark, d):
    top = b.stage(theta_top(spark, d)[1], "top")
    real = themes.autocorrelation(themes.top_share_series(top, FLOOR), "share_top").withColumn("draw", F.lit(-1))
    draws = None
    for seed in range(5):
        x = themes.autocorrelation(themes.top_share_series(themes.shuffled(top, seed), FLOOR), "share_top")
        x = x.withColumn("draw", F.lit(seed))
        draws = x if draws is None else draws.unionByName(x)
    null = draws.groupBy("theme", "cls").agg(F.avg("ar1").alias("m"), F.stddev_samp("ar1").alias("s"))
    z = (F.col("ar1") - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0))
    return real.join(null, ["theme", "cls"]).select("theme", "cls", r("ar1", 4).alias("ar1"), r(z, 4).alias("z"))


view("v_themed", "SELECT p.top_topic AS theme, m.cls, CAST(m.year AS DOUBLE) AS year, m.lead FROM v_masked m JOIN v_top p USING (doc_id) WHERE m.lead IS NOT NULL")


@query(
    "theme_ahead_behind",
    f"""WITH k AS (SELECT theme, cls, CAST({mid_rank_sql('lead', 'theme, cls')} AS DOUBLE) AS rx, CAST({mid_rank_sql('year', 'theme, cls')} AS DOUBLE) AS ry FROM v_themed),
    c AS (SELECT theme, cls, count(*) AS n, corr(rx, ry) AS rho FROM k GROUP BY 1, 2 HAVING count(*) >= 8)
    SELECT CAST(theme AS INTEGER) AS theme, cls, n, {R('rho')} AS rho, {R('(SELECT avg(CAST(rho < 0 AS DOUBLE)) FROM c)')} AS share_negative FROM c""",
)
def theme_ahead_behind(spark, d):
    arrays = b.theta_arrays(spark, d)
    top = theta_top(spark, d, arrays)[1].select("doc_id", F.col("top_topic").alias("theme"))
    rows = b.masked(spark, d, arrays).filter(F.col("lead").isNotNull()).join(top, "doc_id")
    rows = b.stage(rows.select("theme", "cls", "year", "lead"), "themed")
    return rounded(themes.ahead_behind(rows, 8), "rho", "share_negative")


view("v_topic_words", "SELECT topic, word FROM (SELECT length(term) % 5 AS topic, term AS word, row_number() OVER (PARTITION BY length(term) % 5 ORDER BY sum(cnt) DESC, term) AS rn FROM v_terms WHERE year < 1998 GROUP BY 1, 2) WHERE rn <= 10")
view("v_topic_words2", "SELECT topic, word FROM (SELECT (length(term) + 1) % 5 AS topic, term AS word, row_number() OVER (PARTITION BY (length(term) + 1) % 5 ORDER BY sum(cnt) DESC, term) AS rn FROM v_terms WHERE year >= 1998 GROUP BY 1, 2) WHERE rn <= 10")


def pseudo_words(spark, d, late, k=10):
    shift, cond = (1, F.col("year") >= 1998) if late else (0, F.col("year") < 1998)
    t = b.doc_terms(spark, d).filter(cond)
    g = t.groupBy(((F.length("term") + shift) % 5).alias("topic"), F.col("term").alias("word")).agg(F.sum("cnt").alias("n"))
    w = W.partitionBy("topic").orderBy(F.desc("n"), "word")
    return g.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).select("topic", "word")


_JAC = """SELECT a.topic AS a, c.topic AS b, count(*) AS common, count(*) / CAST(20 - count(*) AS DOUBLE) AS jaccard FROM v_topic_words a JOIN v_topic_words2 c USING (word) GROUP BY 1, 2"""


@query("topic_align_jaccard", f"SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, common, {R('jaccard')} AS jaccard FROM ({_JAC})")
def topic_align_jaccard(spark, d):
    return rounded(themes.word_overlap(pseudo_words(spark, d, False), pseudo_words(spark, d, True)), "jaccard")


@query(
    "topic_align_greedy",
    f"""SELECT * FROM (WITH RECURSIVE s AS (SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, round(jaccard, 6) AS jaccard,
      row_number() OVER (ORDER BY round(jaccard, 6) DESC, a, b) AS i FROM ({_JAC})),
    g AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS INTEGER[]) AS ua, CAST([] AS INTEGER[]) AS ub, false AS took, -1 AS a, -1 AS b, CAST(0 AS DOUBLE) AS jaccard
      UNION ALL SELECT s.i, CASE WHEN NOT list_contains(ua, s.a) AND NOT list_contains(ub, s.b) THEN list_append(ua, s.a) ELSE ua END,
        CASE WHEN NOT list_contains(ua, s.a) AND NOT list_contains(ub, s.b) THEN list_append(ub, s.b) ELSE ub END,
        NOT list_contains(ua, s.a) AND NOT list_contains(ub, s.b), s.a, s.b, s.jaccard FROM g JOIN s ON s.i = g.i + 1)
    SELECT a, b, {R('jaccard')} AS jaccard FROM g WHERE took)""",
)
def topic_align_greedy(spark, d):
    return rounded(themes.greedy_match(topic_align_jaccard(spark, d)), "jaccard")


@query(
    "cluster_ari",
    f"""WITH l AS (SELECT cls, top_topic FROM v_top), c AS (SELECT cls, top_topic, CAST(count(*) AS DOUBLE) AS n FROM l GROUP BY 1, 2),
    s AS (SELECT sum(n * (n - 1) / 2) AS ij, sum(n) AS n FROM c), a AS (SELECT sum(k * (k - 1) / 2) AS ra FROM (SELECT sum(n) AS k FROM c GROUP BY cls)), z AS (SELECT sum(k * (k - 1) / 2) AS cb FROM (SELECT sum(n) AS k FROM c GROUP BY top_topic))
    SELECT CAST(n AS BIGINT) AS n, {R('(ij - ra * cb / (n * (n - 1) / 2)) / ((ra + cb) / 2 - ra * cb / (n * (n - 1) / 2))')} AS ari FROM s, a, z""",
)
def cluster_ari(spark, d):
    return rounded(themes.adjusted_rand(theta_top(spark, d)[1], "cls", "top_topic"), "ari")


SEEDS = ["er", "on", "th", "ent"]


@query(
    "seed_phrase_topics",
    f"""SELECT seed, CAST(topic AS INTEGER) AS topic, n AS matches FROM (SELECT seed, topic, count(*) AS n, row_number() OVER (PARTITION BY seed ORDER BY count(*) DESC, topic) AS rn
    FROM v_topic_words JOIN (SELECT unnest({SEEDS}) AS seed) ON contains(word, seed) GROUP BY 1, 2) WHERE rn = 1""",
)
def seed_phrase_topics(spark, d):
    return themes.seed_topics(pseudo_words(spark, d, False), SEEDS)


@query(
    "theme_examples",
    """SELECT theme, CAST(rn AS INTEGER) AS rank, doc_id, cls, year, theta FROM (SELECT k AS theme, doc_id, cls, year, round(theta, 9) AS theta, row_number() OVER (PARTITION BY k ORDER BY round(theta, 9) DESC, doc_id) AS rn
    FROM v_theta JOIN (SELECT doc_id, count(*) AS n FROM v_terms GROUP BY 1) USING (doc_id) WHERE n >= 10 AND year >= 1996) WHERE rn <= 8""",
)
def theme_examples(spark, d):
    n = b.raw_terms(spark, d).groupBy("doc_id").agg(n_rows().alias("n_terms"))
    return themes.examples(b.theta(spark, d), n, 8, 10, 1996)


view("v_arr", "SELECT theme, cls, min(year) AS year FROM v_panel WHERE share_tau >= 0.3 GROUP BY 1, 2")


@query(
    "theme_arrivals",
    f"""WITH n AS (SELECT year, sum(n_cy) AS n FROM (SELECT DISTINCT cls, year, n_cy FROM v_panel) GROUP BY 1), a AS (SELECT year, count(*) AS k FROM v_arr GROUP BY 1),
    c AS (SELECT year, CAST(sum(coalesce(k, 0)) OVER (ORDER BY year) AS BIGINT) AS cum_themes, CAST(sum(n) OVER (ORDER BY year) AS BIGINT) AS cum_docs FROM n LEFT JOIN a USING (year))
    SELECT *, {R('(SELECT regr_slope(ln(cum_themes), ln(cum_docs)) FROM c WHERE cum_themes > 0)')} AS heaps FROM c""",
)
def theme_arrivals(spark, d):
    return rounded(themes.arrivals(pan(spark, d), 0.3), "heaps")


view(
    "v_transit",
    """WITH t AS (SELECT theme, cls, min(year) FILTER (WHERE share_tau >= 0.3) AS first_year, max(share_tau) AS peak FROM v_panel GROUP BY 1, 2),
    o AS (SELECT theme, arg_min(cls, (first_year, cls)) AS origin, min(first_year) AS y0 FROM t WHERE first_year IS NOT NULL GROUP BY 1)
    SELECT t.theme, t.cls, first_year, peak, origin, first_year - y0 AS lag FROM t JOIN o USING (theme) WHERE first_year IS NOT NULL""",
)


@query("theme_transit", f"SELECT theme, cls, first_year, {R('peak')} AS peak, origin, CAST(lag AS INTEGER) AS lag FROM v_transit")
def theme_transit(spark, d):
    return rounded(themes.transit(pan(spark, d), 0.3), "peak")


@query("theme_breadth_flow", f"SELECT origin, cls AS reached, count(*) AS n_themes, {R('avg(lag)')} AS mean_lag FROM v_transit WHERE cls <> origin GROUP BY 1, 2")
def theme_breadth_flow(spark, d):
    return rounded(themes.breadth(themes.transit(pan(spark, d), 0.3)), "mean_lag")


def bass_sql(series: str) -> str:
    """The search of :func:`themes.bass_fits` as five narrowing grids, one step a round."""
    n = themes.BASS_GRID - 1
    steps = [f"""WITH c AS (SELECT theme, cls, CAST(year - min(year) OVER (PARTITION BY theme, cls) AS DOUBLE) AS t,
        sum(value) OVER (PARTITION BY theme, cls ORDER BY year) AS c, sum(value) OVER (PARTITION BY theme, cls) AS last, count(*) OVER (PARTITION BY theme, cls) AS n FROM ({series})),
    y AS (SELECT theme, cls, t, greatest(0, least(1, c / last)) AS y FROM c WHERE n >= 5 AND last > 0),
    g AS (SELECT i, j FROM range({n + 1}) a(i), range({n + 1}) b(j)),
    r0 AS (SELECT theme, cls, {themes.BASS_LOW}::DOUBLE AS lp, {themes.BASS_LOW}::DOUBLE AS lq, {themes.BASS_HIGH[0]}::DOUBLE AS hp, {themes.BASS_HIGH[1]!r}::DOUBLE AS hq FROM y GROUP BY 1, 2)"""]
    for k in range(themes.BASS_ROUNDS):
        steps.append(f"""e{k} AS (SELECT theme, cls, i, j, lp + i * ((hp - lp) / {n}) AS gp, lq + j * ((hq - lq) / {n}) AS gq, (hp - lp) / 12 AS sp, (hq - lq) / 12 AS sq FROM r{k}, g),
    p{k} AS (SELECT theme, cls, i, j, gp, gq, sp, sq, sum(pow((1 - exp(-(pow(10, gp) + pow(10, gq)) * t)) / (1 + pow(10, gq) / pow(10, gp) * exp(-(pow(10, gp) + pow(10, gq)) * t)) - y, 2)) AS sse
        FROM e{k} JOIN y USING (theme, cls) GROUP BY ALL),
    r{k + 1} AS (SELECT theme, cls, gp, gq, sse, greatest(gp - sp, {themes.BASS_LOW}) AS lp, greatest(gq - sq, {themes.BASS_LOW}) AS lq, least(gp + sp, {themes.BASS_HIGH[0]}) AS hp, least(gq + sq, {themes.BASS_HIGH[1]!r}) AS hq
        FROM p{k} QUALIFY row_number() OVER (PARTITION BY theme, cls ORDER BY round(sse, 12), i, j) = 1)""")
    last = f"""SELECT CAST(theme AS INTEGER) AS theme, cls, {R('p', 4)} AS p, {R('q', 4)} AS q, {R('r2', 4)} AS r2 FROM (SELECT theme, cls, pow(10, gp) AS p, pow(10, gq) AS q, 1 - sse / (ss + 1e-12) AS r2
        FROM r{themes.BASS_ROUNDS} JOIN (SELECT theme, cls, var_pop(y) * count(*) AS ss FROM y GROUP BY 1, 2) USING (theme, cls)) WHERE r2 >= 0.7"""
    return ",\n    ".join(steps) + "\n    " + last


@query("theme_bass_fit", bass_sql("SELECT theme, cls, year, share_tau AS value FROM v_panel"))
def theme_bass_fit(spark, d):
    s = pan(spark, d).select("theme", "cls", "year", F.col("share_tau").alias("value"))
    return rounded(themes.bass_fits(s), "p", "q", "r2", digits=4)


view("v_first", "SELECT owner, min(year) AS y0 FROM v_cases GROUP BY 1")
view("v_cdoc", "SELECT c.*, o.o_custkey AS own FROM v_corpus c JOIN orders o ON o.o_orderkey = c.doc_id")
view("v_base", "SELECT c.year, avg(CAST(f.y0 >= c.year - 1 AS DOUBLE)) AS base FROM v_cdoc c JOIN v_first f ON f.owner = c.own GROUP BY 1")
view(
    "v_entr",
    f"""SELECT CAST(k AS INTEGER) AS theme, f.y0 >= t.year - 1 AS new, b.base FROM (SELECT t.k, t.year, c.own, row_number() OVER (PARTITION BY t.k ORDER BY t.filed, t.doc_id) AS rn FROM v_theta t JOIN v_cdoc c USING (doc_id) WHERE t.theta >= {TAU}) t
    JOIN v_first f ON f.owner = t.own JOIN v_base b ON b.year = t.year WHERE rn <= 50""",
)


def entrants(spark, d):
    own = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("owner"))
    first = b.cases(spark, d).groupBy("owner").agg(F.min("year").alias("y0"))
    docs = b.corpus(spark, d).drop("owner", "body").join(own, "doc_id")
    base = docs.join(first, "owner").groupBy("year").agg(share(F.col("y0") >= F.col("year") - 1).alias("base_rate"))
    t = b.theta(spark, d).filter(F.col("theta") >= TAU).select(F.col("k").alias("theme"), "doc_id", "filed", "year")
    carriers = t.join(own, "doc_id").join(base, "year")
    return themes.entrant_shares(carriers, first, 50)


@query("theme_entrants", f"SELECT theme, count(*) AS n, {R('avg(CAST(new AS DOUBLE))')} AS new_share FROM v_entr GROUP BY 1")
def theme_entrants(spark, d):
    return rounded(entrants(spark, d).select("theme", "n", "new_share"), "new_share")


@query(
    "theme_entrants_baseline",
    f"SELECT theme, {R('avg(CAST(new AS DOUBLE))')} AS new_share, {R('avg(base)')} AS base_rate, {R('avg(CAST(new AS DOUBLE)) - avg(base)')} AS excess FROM v_entr GROUP BY 1",
)
def theme_entrants_baseline(spark, d):
    return rounded(entrants(spark, d).drop("n"), "new_share", "base_rate", "excess")


@query(
    "theme_inflow",
    f"""SELECT cls, year, {R('m - pm')} AS d_share, k - pk AS d_active FROM (SELECT *, lag(m) OVER w AS pm, lag(k) OVER w AS pk FROM (SELECT cls, year, avg(share_tau) AS m, count(*) FILTER (WHERE share_tau >= 0.3) AS k FROM v_panel GROUP BY 1, 2)
    WINDOW w AS (PARTITION BY cls ORDER BY year)) WHERE pm IS NOT NULL""",
)
def theme_inflow(spark, d):
    return rounded(themes.inflow(pan(spark, d), 0.3), "d_share")
