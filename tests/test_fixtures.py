"""Hand-computed cases and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions import names, text as tx
from driftline.functions.scalars import correlation, parse_compact_date, wilson_bounds
from driftline.operators import (
    aggregates, binning, entities, inference, outcomes, ranking, regression, similarity, surprise, themes, topics, vocabulary,
)
from driftline.sources import files


def one(df):
    return df.first()[0]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, cls string, filed string, body string").select(
        "doc_id", "cls", F.col("filed").cast("date").alias("filed"), F.year(F.col("filed").cast("date")).alias("year"),
        F.lit("o").alias("owner"), "body",
    )


def terms_of(docs):
    return vocabulary.document_terms(docs, F.split("body", " "))


def test_analyzer(spark):
    df = spark.createDataFrame([("Beer and wine; soft drinks, namely cola",)], "t string")
    got = one(df.select(tx.chunked_terms("t", ["and", *tx.BOILERPLATE_WORDS])))
    assert got == ["beer", "wine", "beer wine", "soft", "drinks", "soft drinks", "cola"]
    assert one(df.select(tx.plain_terms("t", (1, 1))))[:3] == ["beer", "and", "wine"]


def test_default_stopwords(spark):
    words = tx.default_stopwords(spark)
    assert "the" in words and "namely" in words


def test_flat_window_score(spark):
    docs = docs_of(spark, [(1, "X", "2000-01-05", "aa aa bb"), (2, "X", "2001-03-01", "aa cc")])
    terms = terms_of(docs)
    vocab = vocabulary.build_vocabulary(docs, terms, 1, 1.0)
    s = {r["doc_id"]: r for r in surprise.year_window(docs, terms, vocab, 1).collect()}
    assert s[2]["kl_past"] == pytest.approx(0.5 * math.log(3))
    assert s[2]["kl_future"] is None and s[2]["n_future"] == 0 and s[1]["kl_past"] is None


def test_decay_same_day_and_kish(spark):
    same = docs_of(spark, [(1, "X", "2000-01-05", "aa"), (2, "X", "2000-01-05", "bb")])
    t = terms_of(same)
    v = vocabulary.build_vocabulary(same, t, 1, 1.0)
    assert all(r["kl_past"] is None and r["kl_future"] is None for r in surprise.decay(same, t, v).collect())
    # half-life of 100 days: three documents one half-life back, one two back
    rows = [(i, "X", "2000-04-10", "aa") for i in range(3)] + [(3, "X", "2000-01-01", "aa"), (9, "X", "2000-07-19", "aa bb")]
    docs = docs_of(spark, rows)
    t = terms_of(docs)
    v = vocabulary.build_vocabulary(docs, t, 1, 1.0)
    h = 100 / 365.25
    last = surprise.decay(docs, t, v, h, h).filter("doc_id = 9").first()
    assert last["n_eff_past"] == pytest.approx(3.0625 / 0.8125)


def test_long_halflife_equals_unbounded_window(spark):
    rows = [(i, "X", f"{1995 + i % 6}-01-0{1 + i % 7}", "aa bb" if i % 3 else "bb cc cc") for i in range(30)]
    docs = docs_of(spark, rows)
    t = terms_of(docs)
    v = vocabulary.build_vocabulary(docs, t, 1, 1.0)
    d = {r["doc_id"]: r["kl_past"] for r in surprise.decay(docs, t, v, 1e9, 1e9).collect()}
    day = {r["doc_id"]: (r["filed"], r["body"].split()) for r in docs.collect()}
    for k, (filed, words) in day.items():
        before = [w for f, ws in day.values() if f < filed for w in ws]
        if not before:
            assert d[k] is None
            continue
        kl = 0.0
        for w in set(words):
            p = words.count(w) / len(words)
            kl += p * math.log(p / ((before.count(w) + 1) / (len(before) + 3)))
        assert d[k] == pytest.approx(kl, abs=1e-6) and d[k] >= 0


def test_ordinal_bins_and_ties(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 8)], "k long, x double")
    got = [r["bin"] for r in ranking.ordinal_bin(df, "x", "k", 5).orderBy("k").collect()]
    assert got == [0, 0, 1, 2, 2, 3, 4]
    q = ranking.quantile_bin(spark.createDataFrame([(float(i),) for i in range(1, 12)], "x double"), "x", 5)
    assert {r["x"]: r["bin"] for r in q.collect()}[3.0] == 1  # equal to the first cut


@pytest.mark.parametrize("by", [(), ("g",)])
def test_split_groups_match_plain_ranks(spark, by):
    """A group cut at splitters gives the same ranks, sums and quantiles."""
    rng = np.random.default_rng(3)
    rows = [("hot" if i % 5 else "cold", int(i), float(rng.integers(0, 40)), int(rng.integers(1, 9))) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, k long, x double, w long")
    plain = ranking.running_total(df, ["x", "k"], F.col("w"), by, "before").collect()
    split = ranking.running_total(df, ["x", "k"], F.col("w"), by, "before", split_rows=50).collect()
    assert {r["k"]: r["before"] for r in plain} == {r["k"]: r["before"] for r in split}
    probs = [0.1, 0.5, 0.93]
    a = ranking.quantiles(df, "x", probs, by).collect()
    b = ranking.quantiles(df, "x", probs, by, split_rows=50).collect()
    assert len(a) == len(b)
    for r, s in zip(sorted(map(tuple, a)), sorted(map(tuple, b))):
        assert r[-3:] == pytest.approx(s[-3:])
    near = ranking.quantiles(df, "x", [0.9], by, method="nearest").collect()
    for r in near:
        xs = sorted(x[2] for x in rows if not by or x[0] == r["g"])
        assert r["q1"] == xs[int(0.9 * (len(xs) - 1) + 0.5)]


def test_spearman_with_ties(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0), (2.0, 3.0), (3.0, 3.0)], "x double, y double")
    rx, ry = np.array([1.5, 1.5, 3, 4]), np.array([2, 1, 3.5, 3.5])
    assert ranking.spearman(df, "x", "y").first()["rho"] == pytest.approx(np.corrcoef(rx, ry)[0, 1])


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert one(df.agg(correlation("x", "y"))) is None


def test_wilson_hhi_hazard(spark):
    lo, hi = wilson_bounds(F.lit(0.5), F.lit(10))
    r = spark.range(1).select(lo, hi).first()
    assert r[0] == pytest.approx(0.236590, abs=2e-6) and r[1] == pytest.approx(0.763410, abs=2e-6)
    owners = spark.createDataFrame([("c", o) for o in "aaaaabbbcc"], "cls string, owner string")
    assert aggregates.concentration(owners, "owner", ["cls"]).first()["hhi"] == pytest.approx(3800)
    lives = spark.createDataFrame([("2000-01-01", 1.2), ("2000-01-01", 1.8), ("2000-01-01", None)], "f string, age_at_death double")
    h = outcomes.hazard_by_age(lives.withColumn("filed", F.col("f").cast("date")), "2005-01-02", (), 5, 0)
    assert {r["age"]: r["hazard"] for r in h.collect()}[1] == pytest.approx(2 / 3)


def test_adjusted_rand(spark):
    same = spark.createDataFrame([(i % 3, i % 3) for i in range(12)], "a int, b int")
    lump = spark.createDataFrame([(0, i) for i in range(6)], "a int, b int")
    assert themes.adjusted_rand(same, "a", "b").first()["ari"] == pytest.approx(1)
    assert themes.adjusted_rand(lump, "a", "b").first()["ari"] == pytest.approx(0)


def test_regression_matches_numpy(spark):
    rng = np.random.default_rng(0)
    n = 400
    x1, x2, g, c = rng.normal(size=n), rng.normal(size=n), rng.integers(0, 8, n), rng.integers(0, 40, n)
    y = 1 + 2 * x1 - x2 + g * 0.3 + rng.normal(size=n)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(y, x1, x2, g, c)], "y double, x1 double, x2 double, g double, c double")
    got = {r["term"]: r for r in regression.fit(df, "y", ["x1", "x2"]).collect()}
    X = np.column_stack([np.ones(n), x1, x2])
    inv = np.linalg.inv(X.T @ X)
    b = inv @ X.T @ y
    e = y - X @ b
    se = np.sqrt(np.diag(n / (n - 3) * inv @ (X.T * e**2) @ X @ inv))
    assert got["x1"]["b"] == pytest.approx(b[1]) and got["x1"]["se"] == pytest.approx(se[1])
    assert got["intercept"]["b"] == pytest.approx(b[0])
    fe = {r["term"]: r for r in regression.fit(df, "y", ["x1", "x2"], cluster="c", absorb="g").collect()}
    D = (g[:, None] == np.arange(8)).astype(float)
    M = np.eye(n) - D @ np.linalg.inv(D.T @ D) @ D.T
    Xd, yd = M @ X[:, 1:], M @ y
    inv = np.linalg.inv(Xd.T @ Xd)
    bd = inv @ Xd.T @ yd
    s = np.array([(Xd * (yd - Xd @ bd)[:, None])[c == k].sum(0) for k in np.unique(c)])
    G = len(s)
    se = np.sqrt(np.diag(G / (G - 1) * (n - 1) / (n - 2) * inv @ s.T @ s @ inv))
    assert fe["x2"]["b"] == pytest.approx(bd[1]) and fe["x2"]["se"] == pytest.approx(se[1])


def test_cell_logits_match_the_glm(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=600)
    y = (rng.random(600) < 1 / (1 + np.exp(-(0.2 + 0.5 * z + 0.4 * z * z)))).astype(float)
    df = spark.createDataFrame([("a", float(a), float(b), float(a * a)) for a, b in zip(z, y)], "g string, z double, y double, z2 double")
    cell = regression.quadratic_logits(df, "y", "z", ["g"]).first()
    glm = {r["term"]: r["b"] for r in regression.logit(df, "y", ["z", "z2"]).collect()}
    assert cell["b1"] == pytest.approx(glm["z"], abs=1e-4) and cell["b2"] == pytest.approx(glm["z2"], abs=1e-4)


def test_cell_logits_of_odd_cells(spark):
    rng = np.random.default_rng(6)
    rows = [("few", float(i % 2), float(i % 2 == i % 3)) for i in range(200)]  # two values of z: no curvature
    rows += [("one-sided", float(i), 1.0) for i in range(200)]  # not between the rates
    rows += [(c, float(z), float(rng.random() < 1 / (1 + np.exp(-(b * z * z - 1))))) for c, b in (("u", 1.0), ("n", -1.0)) for z in rng.normal(size=900)]
    got = {r.g: r for r in regression.quadratic_logits(spark.createDataFrame(rows, "g string, z double, y double"), "y", "z", ["g"]).collect()}
    assert set(got) == {"few", "u", "n"} and (got["u"]["shape"], got["n"]["shape"], got["few"]["shape"]) == ("U", "inverted", "flat")
    assert got["few"].b2 is None and got["u"].b2 == pytest.approx(1.0, abs=0.6)


def test_alternating_projections_equal_dummies(spark):
    rng = np.random.default_rng(9)
    rows = []
    for e in range(60):
        for t in rng.choice(25, int(rng.integers(2, 9)), replace=False):
            x = rng.normal() + 0.1 * e + 0.05 * t
            rows.append((e, int(t), float(x), float(rng.normal()), float(0.7 * x + 0.3 * e - 0.2 * t + rng.normal())))
    df = spark.createDataFrame(rows, "e int, t int, x double, v double, y double")
    a, b = ({r.term: r for r in regression.two_way(df, "y", ["x", "v"], "e", "t", most_dummies=m).collect()} for m in (100, 0))
    assert a.keys() == b.keys() == {"x", "v"}
    for term in a:
        for c in ("b", "se", "t", "r2"):
            assert a[term][c] == pytest.approx(b[term][c], rel=1e-8, abs=1e-8)
        assert (a[term].n, a[term].n_clusters) == (b[term].n, b[term].n_clusters)


def test_bass_recovers_planted_curves(spark):
    rows = []
    for k, (p, q) in enumerate([(0.01, 0.4), (0.05, 0.6), (0.2, 0.1)]):
        t = np.arange(26)
        e = np.exp(-(p + q) * t)
        curve = (1 - e) / (1 + q / p * e)
        rows += [(k, "c", 2000 + int(i), float(v)) for i, v in zip(t, np.diff(curve, prepend=0.0))]
    rows += [(8, "c", 2000 + i, 0.0) for i in range(9)] + [(9, "c", 2000 + i, 1.0) for i in range(3)]
    got = {r.theme: r for r in themes.bass_fits(spark.createDataFrame(rows, "theme int, cls string, year int, value double")).collect()}
    assert set(got) == {0, 1, 2} and all(r.r2 > 0.99 for r in got.values())
    for k, (p, q) in enumerate([(0.01, 0.4), (0.05, 0.6)]):
        assert got[k].p == pytest.approx(p, rel=0.15) and got[k].q == pytest.approx(q, rel=0.15)


def test_kernel_surface_against_all_cells(spark):
    rng = np.random.default_rng(7)
    cells = [(int(i), int(j), int(c), float(rng.integers(0, c + 1))) for i in range(12) for j in range(12) if (c := rng.integers(0, 5))]
    df = spark.createDataFrame(cells, "ix int, iy int, c long, s double")
    rows = inference.kernel_surfaces(df, [0.7, 1.5], 12).collect()
    for r in rows:
        m = int(5 * r.sigma + 0.5)
        near = [(np.exp(-((i - r.ix) ** 2 + (j - r.iy) ** 2) / (2 * r.sigma**2)), c, s) for i, j, c, s in cells if abs(i - r.ix) <= m and abs(j - r.iy) <= m]
        k, y, k2 = (sum(f(*x) for x in near) for f in (lambda w, c, s: w * c, lambda w, c, s: w * s, lambda w, c, s: w * w * c))
        assert r.rate == pytest.approx(y / k, rel=1e-9, abs=1e-12) and r.n_eff == pytest.approx(k * k / k2, rel=1e-9)
    assert len(rows) == 2 * 144


def test_rolling_windows_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows, day = [], np.datetime64("2000-01-01")
    for i in range(60):
        t = rng.dirichlet([1, 1, 1])
        f = str(day + int(rng.integers(0, 200)))
        rows.append((i, "X", f, t.tolist()))
    df = spark.createDataFrame(rows, "doc_id long, cls string, f string, theta array<double>")
    df = df.select("doc_id", "cls", F.col("f").cast("date").alias("filed"), F.year(F.col("f").cast("date")).alias("year"), "theta")
    got = {r["doc_id"]: r for r in topics.rolling_scores(df, 40).collect()}
    th = {r[0]: np.array(r[3]) for r in rows}
    at = {r[0]: np.datetime64(r[2]) for r in rows}
    for i in range(60):
        ref = [th[j] for j in th if 0 < (at[i] - at[j]).astype(int) <= 40]
        assert got[i]["n_past"] == len(ref)
        if ref:
            q = np.mean(ref, 0)
            assert got[i]["kl_past"] == pytest.approx(float((th[i] * np.log(th[i] / (q / q.sum()))).sum()))
        else:
            assert got[i]["kl_past"] is None


@pytest.mark.parametrize("cell_rows", [1_000, 3])
def test_neighbours_against_brute_force(spark, cell_rows):
    rng = np.random.default_rng(4)
    base = [rng.integers(0, 30, 6) for _ in range(12)]
    rows, good = [], []
    for i in range(60):
        words = np.bincount(np.append(base[i % 12], rng.integers(0, 30, int(i % 3))), minlength=30)
        w = words / np.linalg.norm(words)
        rows += [(i, "X", 2000 + i % 9, f"t{j:02d}", float(v)) for j, v in enumerate(w) if v > 0]
        good.append((i, bool(i % 2)))
    w = spark.createDataFrame(rows, "doc_id long, cls string, year int, term string, weight double")
    g = spark.createDataFrame(good, "doc_id long, good boolean")
    got = {r["doc_id"]: (r["n_near"], r["n_near_good"]) for r in similarity.band_neighbours(w, g, 0.7, cell_rows=cell_rows).collect()}
    vec = {i: {r[3]: r[4] for r in rows if r[0] == i} for i in range(60)}
    for i in vec:
        near = [j for j in vec if j != i and -2 <= (2000 + j % 9) - (2000 + i % 9) <= 5
                and round(sum(v * vec[j].get(t, 0) for t, v in vec[i].items()), 9) >= 0.7]
        assert got[i] == (len(near), sum(j % 2 for j in near))


def test_band_candidates_keep_true_pairs_and_years_apart(spark):
    rng = np.random.default_rng(9)
    rows, years = [], []
    for i in range(40):
        words = rng.integers(0, 12, 12) * (rng.random(12) < 0.5)
        words[i % 12] += 1
        w = words / np.linalg.norm(words)
        rows += [("X", i, f"t{j:02d}", float(v)) for j, v in enumerate(w) if v > 0]
        years += [("X", i, 1990 + int(y)) for y in rng.integers(0, 25, 1 + i % 3)]
    v = spark.createDataFrame(rows, "cls string, rep long, term string, weight double")
    y = spark.createDataFrame(years, "cls string, rep long, year int").distinct()
    pairs = similarity.band_candidates(similarity.prefixes(v, 0.7), y, 0.7, 4, cell_rows=5)
    got = {(r["a"], r["c"]): r["_cos"] for r in similarity.pair_cosines(pairs, v).collect()}
    vec, when = {i: {} for i in range(40)}, {i: set() for i in range(40)}
    for _, i, t, w in rows:
        vec[i][t] = w
    for _, i, at in years:
        when[i].add(at)
    n_true = 0
    for a in vec:
        for c in vec:
            cos = sum(x * vec[c].get(t, 0) for t, x in vec[a].items())
            apart = min(abs(p - q) for p in when[a] for q in when[c])
            if a < c and cos >= 0.7 and apart <= 4:
                n_true += 1
                assert abs(got[a, c] - cos) < 1e-12
            if (a, c) in got:
                assert a < c and abs(got[a, c] - cos) < 1e-12
    assert n_true > 5 and len(got) < 40 * 39 / 2
    assert similarity.pair_cosines(pairs.limit(0), v).count() == 0


def test_names(spark):
    df = spark.createDataFrame([("The Acme Holdings Corp Ltd.",), ("Smith, John Jr.",), ("Müller, José",)], "n string")
    assert [r[0] for r in df.select(names.strong_key("n")).collect()][0] == "ACME HOLDINGS"
    assert [r[0] for r in df.select(names.surname("n")).collect()][1] == "SMITH"
    assert [r[0] for r in df.select(names.folded_surname("n")).collect()][2] == "JOSE"


def test_dates_and_renames(spark):
    df = spark.createDataFrame([("20010228",), ("20010230",), ("x",)], "d string")
    assert [str(r[0]) for r in df.select(parse_compact_date("d")).collect()] == ["2001-02-28", "None", "None"]
    with pytest.raises(ValueError):
        files.rename(spark.createDataFrame([(1, 2)], "a int, b int"), {"a": "b"})
    with pytest.raises(ValueError):
        vocabulary.require_text(spark.createDataFrame([("",)], "body string"))


def test_benjamini_hochberg(spark):
    p = [0.001, 0.011, 0.02, 0.04, 0.9]
    df = spark.createDataFrame(list(enumerate(p)), "k int, p double")
    got = {r["k"]: r["rejected"] for r in inference.benjamini_hochberg(df, "p", "k", 0.05).collect()}
    assert got == {0: True, 1: True, 2: True, 3: True, 4: False}


def test_bootstrap_interval(spark):
    rng = np.random.default_rng(5)
    y = rng.normal(size=800)
    df = spark.createDataFrame([(i, 0, float(v)) for i, v in enumerate(y)], "k long, bin int, y double")
    r = binning.bin_means(df, "y", ["bin"], 30, draws=100, key="k").first()
    again = binning.bin_means(df.repartition(5), "y", ["bin"], 30, draws=100, key="k").first()
    half = 1.96 * y.std() / math.sqrt(len(y))
    assert r["lo"] < r["mean"] < r["hi"] and r["hi"] - r["lo"] == pytest.approx(2 * half, rel=0.35)
    assert again["lo"] == pytest.approx(r["lo"]) and again["hi"] == pytest.approx(r["hi"])


def test_fuzzy_names_against_all_pairs(spark):
    rng = np.random.default_rng(12)
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZ ")
    known = sorted({"".join(rng.choice(letters, int(rng.integers(8, 24)))).strip() for _ in range(300)} | {"IBM", "ACME HOLDINGS", "ACME HOLDING"})

    def misspelt(n):
        i = int(rng.integers(1, len(n) - 1))
        return [n[:i] + n[i + 1 :], n[:i] + "Q" + n[i:], n[:i] + "Z" + n[i + 1 :], n[:i] + n[i + 1] + n[i] + n[i + 2 :]][int(rng.integers(0, 4))]

    asked = sorted({misspelt(n) for n in known[::2]} | {"NOTHING LIKE IT AT ALL", "", "IBN"})

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {(a, b): e for a in asked for b in known if a and a != b and (e := edits(a, b)) <= max(1, int(max(len(a), len(b)) * 0.15))}
    a, b = (spark.createDataFrame([(n,) for n in ns], "norm string") for ns in (asked, known))
    for cell_rows in (1_000, 1):
        got = {(r.norm, r.near): r.edits for r in entities.fuzzy_candidates(a, b, cell_rows=cell_rows).collect()}
        assert got.items() <= want.items() and len(got) >= 0.97 * len(want)
    best = entities.nearest_names(entities.fuzzy_candidates(a, b), 1).collect()
    assert len(best) == len({k for k, _ in got})
