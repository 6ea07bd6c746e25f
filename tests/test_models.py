"""Topic models on planted topics, guards of ranks and fits, archives on disk."""

import gzip
import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import ranking, regression, term_blocks as tb, topic_models as tm
from driftline.plans import topic_plans
from driftline.session import remove_folder, shared_folder
from driftline.sources import archive_source, files
from driftline.sources.staging import stage

WORDS = {0: ["iron", "steel", "bolt", "gear"], 1: ["milk", "cheese", "butter", "cream"], 2: ["cloth", "wool", "linen", "silk"]}


def planted(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(240):
        topic = i % 3
        own = rng.choice(WORDS[topic], 30).tolist()
        rows.append((i, topic, own + rng.choice(WORDS[(topic + 1) % 3], 2).tolist()))
    return spark.createDataFrame(rows, "doc_id long, topic int, words array<string>")


def purity(rows):
    table = np.zeros((3, 3))
    for truth, found in rows:
        table[truth, found] += 1
    return table.max(0).sum() / table.sum()


def long_counts(docs, copies=1):
    docs = docs.crossJoin(docs.sparkSession.range(copies).withColumnRenamed("id", "_copy")).withColumn("doc_id", F.col("doc_id") * copies + F.col("_copy"))
    return docs.select("doc_id", F.explode("words").alias("term")).groupBy("doc_id", "term").agg(F.count("*").cast("double").alias("cnt"))


def slow_lda_step(v, lam, totals, alpha):
    """Plain variational inference, document by document: gamma and expected counts."""
    from math import lgamma

    psi = lambda x: np.vectorize(lambda y: (lgamma(y + 1e-5) - lgamma(y - 1e-5)) / 2e-5)(x)
    beta = np.exp(psi(lam) - psi(totals))
    gammas, expected = [], np.zeros_like(lam)
    for n in v:
        g = np.ones(lam.shape[1])
        for _ in range(100):
            t, before = np.exp(psi(g) - psi(g.sum())), g
            g = alpha + t * (beta.T @ (n / (beta @ t + 1e-100)))
            if np.abs(g - before).mean() < 1e-3:
                break
        t = np.exp(psi(g) - psi(g.sum()))
        expected += np.outer(n / (beta @ t + 1e-100), t) * beta
        gammas.append(g)
    return np.array(gammas), expected


def test_digamma():
    x = np.array([0.01, 0.2, 1.0, 2.5, 40.0])
    want = [-100.56088545786868, -5.289039896592188, -0.5772156649015329, 0.7031566406452432, 3.6763273780344186]
    assert np.allclose(tm.digamma(x), want, rtol=1e-10)


def test_lda_step_equals_plain_inference(spark):
    counts = stage(long_counts(planted(spark)), "test-v")
    model = tm.fit_lda(counts, 3, stage, passes=1, batch=0)
    words = model.words.toPandas().set_index("term")["vec"]
    v = counts.toPandas().pivot(index="doc_id", columns="term", values="cnt").fillna(0)
    lam = np.array(words.loc[v.columns].tolist())
    assert model.steps == 1 and np.allclose(lam.sum(0), model.totals)
    gamma, _ = slow_lda_step(v.to_numpy(), lam, lam.sum(0), 1 / 3)
    theta = {r.doc_id: r.theta for r in tm.theta_table(model).collect()}
    assert np.allclose(np.array([theta[i] for i in v.index]), gamma / gamma.sum(1, keepdims=True), atol=1e-5)


@pytest.mark.parametrize("k", [3, 4])
def test_lda_recovers_planted_topics(spark, k):
    docs = planted(spark)
    counts = stage(long_counts(docs), "test-v")
    model = tm.fit_lda(counts, k, stage, passes=8, batch=60)
    assert model.steps == 32 and model.n_terms == 12
    theta = tm.theta_table(model)
    rows = theta.join(docs, "doc_id").select("topic", "theta", "n_tokens").collect()
    assert all(abs(sum(r.theta) - 1) < 1e-9 and r.n_tokens == 32 for r in rows)
    table = np.zeros((3, k))
    for r in rows:
        table[r.topic, int(np.argmax(r.theta))] += 1
    assert table.sum() == 240 and table.max(0).sum() > 0.95 * 240, table
    if k == 3:
        words = {}
        for r in tm.topic_words(model, 4).collect():
            words.setdefault(r.topic, set()).add(r.word)
        assert sorted(map(sorted, words.values())) == sorted(map(sorted, WORDS.values()))
    sizes = tm.topic_sizes(theta).collect()
    assert abs(sum(r.tokens for r in sizes) - 240 * 32) < 1 and abs(sum(r.share for r in sizes) - 1) < 1e-9


def test_topic_models_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, term string, cnt double")
    model = tm.fit_lda(none, 3, stage)
    assert tm.theta_table(model).count() == 0 and tm.topic_words(model).count() == 0
    w, h, n = tm.nmf(none.withColumnRenamed("cnt", "weight"), 3, stage)
    assert (w.count(), h.count(), n) == (0, 0, 0)


def dense(frame, key, index):
    return np.array(frame.toPandas().set_index(key)["vec"].loc[index].tolist())


def test_svd_start_spans_the_leading_vectors(spark):
    counts = stage(long_counts(planted(spark)), "test-v")
    v = counts.toPandas().pivot(index="doc_id", columns="term", values="cnt").fillna(0)
    blocks, _ = tb.pack(counts, 240, 0, weight="cnt")
    h = dense(tm.svd_start(blocks, counts.select("term").distinct(), 3, 12, stage), "term", v.columns)
    u, _, right = np.linalg.svd(v.to_numpy(), full_matrices=False)
    for j in range(3):
        halves = [np.maximum(s * right[j], 0) for s in (1, -1)]
        weight = [np.linalg.norm(np.maximum(s * u[:, j], 0)) * np.linalg.norm(x) for s, x in zip((1, -1), halves)]
        assert np.allclose(h[:, j], halves[int(np.argmax(weight))], atol=1e-4)


def test_nonnegative_least_squares():
    rng = np.random.default_rng(1)
    a, x = rng.random((30, 4)), np.maximum(rng.standard_normal((20, 4)), 0)
    got = tm.nonnegative(x @ (a.T @ a), a.T @ a, sweeps=2000)
    assert np.allclose(got, x, atol=5e-3)


def test_nmf_recovers_planted_topics(spark):
    docs = planted(spark)
    counts = stage(long_counts(docs).withColumnRenamed("cnt", "weight"), "test-v")
    w, h, n = tm.nmf(counts, 3, stage)
    top = tm.heaviest_factor(w).join(docs, "doc_id").select("topic", "top_topic", "top_weight").collect()
    assert len(top) == 240 and purity([(r.topic, r.top_topic) for r in top]) > 0.95 and all(0 < r.top_weight <= 1 for r in top)
    assert n <= 40
    # as near to the matrix as many updates of a random start come
    v = counts.toPandas().pivot(index="doc_id", columns="term", values="weight").fillna(0)
    a, b = dense(w, "doc_id", v.index), dense(h, "term", v.columns)
    v, rng = v.to_numpy(), np.random.default_rng(0)
    x, y = rng.random(a.shape), rng.random(b.shape)
    for _ in range(500):
        y *= v.T @ x / (y @ (x.T @ x) + 1e-12)
        x *= v @ y / (x @ (y.T @ y) + 1e-12)
    assert a.min() >= 0 and b.min() >= 0
    assert np.linalg.norm(v - a @ b.T) < 1.01 * np.linalg.norm(v - x @ y.T)


def bind_planted(spark, monkeypatch, copies):
    """Planted documents as the corpus of the registered fits; the topic of each."""
    docs = planted(spark).crossJoin(spark.range(copies).withColumnRenamed("id", "_copy"))
    docs = docs.withColumn("doc_id", F.col("doc_id") * copies + F.col("_copy")).drop("_copy")
    texts = docs.select("doc_id", F.lit("c").alias("cls"), F.to_date(F.lit("2000-01-01")).alias("filed"), F.lit(2000).alias("year"),
                        F.lit("o").alias("owner"), F.lit("m").alias("mark"), F.array_join("words", " ").alias("body"))
    monkeypatch.setattr(topic_plans.b, "corpus", lambda spark, d: stage(texts, "test-planted"))
    monkeypatch.setattr(topic_plans, "_fits", {})
    return {r.doc_id: r.topic for r in docs.collect()}


@pytest.mark.parametrize("k", [3, 5])
def test_registered_lda_recovers_planted_topics(spark, monkeypatch, k):
    monkeypatch.setattr(topic_plans.b, "TOPICS", k)
    truth = bind_planted(spark, monkeypatch, 10)
    theta = topic_plans.lda_transform(spark, "").collect()
    assert topic_plans.fitted(spark, "")[1].steps == 8 and len(topic_plans._fits) == 1
    # more topics than planted ones: one may be split, none may be mixed with another
    table = np.zeros((3, k))
    for r in theta:
        assert len(r.theta) == k
        table[truth[r.doc_id], int(np.argmax(r.theta))] += 1
    assert table.sum() == 2_400 and table.max(0).sum() > 0.95 * 2_400, table
    assert topic_plans.lda_fit(spark, "").count() == k and topic_plans.topic_top_words(spark, "").count() == 10 * k


def test_registered_nmf_recovers_planted_topics(spark, monkeypatch):
    truth, asked, factors = bind_planted(spark, monkeypatch, 1), {}, tm.nmf
    monkeypatch.setattr(topic_plans.b, "TOPICS", 3)
    monkeypatch.setattr(tm, "nmf", lambda v, k, s, *a, **kw: asked.update(nmf=(a, kw), out=factors(v, k, s, *a, **kw)) or asked["out"])
    got = topic_plans.nmf_fit(spark, "").collect()
    assert len(got) == 240 and purity([(truth[r.doc_id], r.top_topic) for r in got]) > 0.95
    assert asked["nmf"] == ((200, 1e-3), {}) and asked["out"][2] <= 60


def test_ranks_keep_rows_without_a_value(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", None), (3, None, 2.0), (4, "a", 1.0)], "k long, g string, x double")
    for ties in ("min", "ordinal"):
        got = {r.k: r.bin for r in ranking.ordinal_bin(df, "x", "k", 2, ["g"], ties=ties).collect()}
        assert set(got) == {1, 2, 3, 4} and got[3] is None
    assert {r.k: r["rank"] for r in ranking.average_rank(df, "x", ["g"]).collect()} == {1: 1.5, 2: None, 3: None, 4: 1.5}


def test_slices_follow_the_group(spark):
    df = spark.range(5000).select(F.xxhash64("id").alias("x"), "id")
    got = ranking.running_total(df, ["x", "id"], None, [], "before", split_rows=20).orderBy("x").select("before").collect()
    assert [r.before for r in got] == list(range(5000))


def test_fit_without_spare_rows_or_clusters(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a"), (2.0, 3.5, "a"), (3.0, 4.0, "a")], "x double, y double, g string")
    one = {r.term: r for r in regression.fit(df, "y", ["x"], cluster="g").collect()}
    assert one["x"].b == pytest.approx(1.0) and one["x"].se is None and one["x"].t is None
    two = {r.term: r for r in regression.fit(df.limit(2), "y", ["x"]).collect()}
    assert two["x"].se is None


def archive(path, members):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name, text in members.items():
            z.writestr(f"2020q1/{name}", text)
    return path, buf.getvalue()


def test_archives_are_read_by_header(spark):
    a = archive("a.zip", {
        "sub.txt": "adsh\tcik\tname\tsic\tzip\tfiled\tform\tperiod\tfy\tfp\nA1\t7\tN\t10\t9\tF\t10-K\tP\t2020\tFY\nA2\tx\tN\t1\t1\tF\t10-K\tP\t1\tFY\nshort\t1\n",
        "num.txt": "adsh\ttag\tversion\tddate\tqtrs\tuom\tsegments\tvalue\nA1\tRevenues\tv\t20201231\t4\tUSD\t\t5.5\nA1\tRevenues\tv\t20201231\t4\tUSD\tS=1\t1\n",
    })
    b = archive("b.zip", {
        "sub.txt": "form\tcik\tadsh\tfy\tname\tsic\tfp\tperiod\tfiled\n10-Q\t8\tB1\t\tM\t11\tQ1\tP\tF\n",
        "num.txt": "value\tsegments\tqtrs\ttag\tadsh\tddate\n2\t\t1\tRevenues\tB1\t20200331\n3\t\t1\tOther\tB1\t20200331\n",
    })
    path = shared_folder(spark, "test-zip")
    files.write_archives(spark.createDataFrame([a, b], "path string, content binary"), path)
    got = files.financial_facts(files.archives(spark, f"{path}/*.zip"), ["Revenues"])
    assert sorted((r.adsh, r.cik, r.fy, r.fp, r.ddate, r.qtrs, r.value) for r in got.collect()) == [
        ("A1", 7, 2020, "FY", "20201231", 4, 5.5), ("B1", 8, None, "Q1", "20200331", 1, 2.0)
    ]
    remove_folder(spark, path)


def test_zipped_case_files_equal_plain_ones(spark):
    case = lambda i, more="": f"<case-file kind='x'>\n<serial-number>{i:08d}</serial-number><case-file-header><status-code>7{i}</status-code></case-file-header>{more}</case-file >"
    long = "<case-file-statements><case-file-statement><type-code>GS01</type-code><text>" + "wörter &amp; mehr " * 200_000 + "</text></case-file-statement></case-file-statements>"
    text = "<?xml version='1.0'?><root>" + "".join(case(i, long if i == 3 else "") for i in range(40)) + "</root>"
    path = shared_folder(spark, "test-xml")
    plain = spark.createDataFrame([("all.xml", text.encode())], "path string, content binary")
    files.write_archives(plain, f"{path}/plain")
    name, content = archive("a.zip", {"a.xml": text[: text.index("<case-file kind='x'>\n<serial-number>00000030")], "c.txt": text, "d.xml": "<root><case-file><serial-number>1"})
    buf = io.BytesIO(content)
    with zipfile.ZipFile(buf, "a") as z:
        z.writestr("b.xml.gz", gzip.compress(("<root>" + text[text.index("<case-file kind='x'>\n<serial-number>00000030") :]).encode()))
    files.write_archives(spark.createDataFrame([(name, buf.getvalue())], "path string, content binary"), f"{path}/zip")
    want, got = files.case_files(spark, f"{path}/plain"), files.zipped_case_files(files.archives(spark, f"{path}/zip/*.zip"))
    rows = sorted(map(repr, got.collect()))
    assert len(rows) == 40 and rows == sorted(map(repr, want.collect()))
    assert got.rdd.getNumPartitions() == 3
    remove_folder(spark, path)


def test_elements_across_chunks(monkeypatch):
    monkeypatch.setattr(archive_source, "CHUNK", 7)
    text = b"<r><item-x>no</item-x><item>1</item><item a='2'>two</item ><items/><item>3</item><item>cut"
    assert list(archive_source.elements(io.BytesIO(text), "item")) == ["<item>1</item>", "<item a='2'>two</item >", "<item>3</item>"]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Elsewhere:
        conf = spark.conf
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError, match="checkpoint"):
            shared_folder(Elsewhere, "x")


@pytest.mark.parametrize("halflife", [2.0, 2 / 365.25])
def test_decay_with_any_half_life(spark, halflife):
    """A half-life of two days over forty years gives what the definition gives, and no NaN."""
    import datetime as dt
    import math

    from driftline.operators import surprise, vocabulary

    rng = np.random.default_rng(8)
    base, days = dt.date(1980, 1, 1), sorted({0, 1, 3, 14_600, 14_601, *rng.integers(0, 14_600, 40).tolist()})
    rows = [(i, "a", base + dt.timedelta(days=int(x)), rng.choice(["p", "q", "r"], 6).tolist()) for i, x in enumerate(days * 2)]
    docs = spark.createDataFrame([(i, c, f, " ".join(w)) for i, c, f, w in rows], "doc_id long, cls string, filed date, body string")
    docs = docs.withColumn("year", F.year("filed"))
    terms = docs.select("doc_id", "cls", "filed", "year", F.explode(F.split("body", " ")).alias("term")).groupBy(
        "doc_id", "cls", "filed", "year", "term").agg(F.count("*").alias("cnt"))
    vocab = vocabulary.build_vocabulary(docs, terms, 1, 1.0)
    got = {r.doc_id: r for r in surprise.decay(docs, terms, vocab, halflife, halflife).collect()}
    rate = math.log(2) / halflife / 365.25
    for i, _, filed, _ in rows:
        for side, later in (("past", -1), ("future", 1)):
            ages = [later * (f - filed).days for _, _, f, _ in rows]
            w = [math.exp(-rate * a) if a > 0 else 0.0 for a in ages]
            n_eff = got[i][f"n_eff_{side}"]
            if sum(w) > 1e-125:  # their squares stay above what is carried
                assert n_eff == pytest.approx(sum(w) ** 2 / sum(x * x for x in w), rel=1e-6)
                assert not math.isnan(got[i][f"kl_{side}"])
            elif sum(w) == 0:
                assert n_eff is None and got[i][f"kl_{side}"] is None
