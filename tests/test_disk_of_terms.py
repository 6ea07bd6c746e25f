"""Terms move once where the vocabulary is the documents' own: same rows, and no more exchanges than said."""

import pytest
from pyspark.sql import functions as F

from driftline.operators import emergence, similarity, surprise, vocabulary
from driftline.sources.staging import stage


@pytest.fixture(scope="module")
def docs(spark):
    words = ["iron", "steel", "bolt", "milk", "cream", "wool", "silk", "rare", "gear", "cloth", "tin"]
    rows = [(i, "ab"[i % 2], 1990 + i % 9, " ".join(words[(i * j * j + i // 3 + j) % (5 + i % 7)] for j in range(9))) for i in range(150)]
    return stage(spark.createDataFrame(rows, "doc_id long, cls string, year int, body string"), "test-docs")


def terms_of(docs, *more):
    own = docs.select("doc_id", "cls", "year", *more, F.explode(F.split("body", " ")).alias("term"))
    return stage(own.groupBy("doc_id", "cls", "year", *more, "term").agg(F.count(F.lit(1)).alias("cnt")), "test-terms")


def rows(df, *cols):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*cols).collect()), key=repr)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_emergence_of_a_corpus(spark, docs):
    # two labels of one document, and documents without any
    labels = spark.createDataFrame([(i, i % 3 == 0) for i in range(0, 150, 2)] + [(4, True), (4, False)], "doc_id long, good boolean")
    terms, sizes = terms_of(docs), {"early": (0, 1), "mid": (2, 3), "late": (4, 6)}
    outcome = docs.select("doc_id").join(labels, "doc_id", "left").select("doc_id", F.coalesce("good", F.lit(False)).alias("good"))
    kept = vocabulary.count_matrix(terms, vocabulary.build_vocabulary(docs, terms, 5, 0.6))
    want = emergence.emergence(kept, outcome, 4, 3, sizes, 3)
    said = labels.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_m"), F.count_if("good").alias("_g"))
    marked = docs.join(said, "doc_id", "left").withColumns({"_m": F.coalesce("_m", F.lit(1)), "_g": F.coalesce("_g", F.lit(0))})
    dealt = vocabulary.by_term(terms_of(marked, "_m", "_g").select("cls", "year", "term", "_m", "_g"), 3)
    got = emergence.corpus_emergence(docs, dealt, 4, 3, sizes, 3, 5, 0.6)
    assert rows(got, *want.columns) == rows(want, *want.columns) and want.count() > 3
    assert exchanges(got) <= 2  # the terms, and the classes' sizes


def test_tfidf_of_a_corpus(docs):
    terms = terms_of(docs)
    want = vocabulary.tfidf_l2(terms, vocabulary.build_vocabulary(docs, terms, 5, 0.6), docs)
    got = vocabulary.corpus_tfidf_l2(docs, vocabulary.by_term(terms, 3), 5, 0.6)
    cols = ("doc_id", "cls", "term", "weight")
    assert rows(got, *cols) == rows(want, *cols) and want.count() > 300
    assert exchanges(got) <= 3  # by term, by document, and the classes' sizes


def test_contributions_move_without_the_totals(docs):
    got = surprise.corpus_term_contributions(docs, vocabulary.by_term(terms_of(docs), 3), stage, 2, bounds=surprise.Bounds(5, 0.6))
    lines = got._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda word: min(len(x) - len(x.lstrip(" :+-*()0123456789")) for x in lines if word in x)
    assert depth("Window") > depth("BroadcastHashJoin")


def test_tiles_meet_in_rounds(spark, monkeypatch):
    vectors = [("X", i, 2000 + i % 3, 1, i % 2, [i % 4, 9], [0.6, 0.8]) for i in range(40)]
    units = spark.createDataFrame(vectors, "cls string, rep long, year int, n long, n_good long, terms array<long>, weights array<double>")
    cols, label = ("cls", "rep", "year", "_n", "_g"), []
    want = rows(similarity.near_counts(units, 0.7, 2, 5), *cols)
    monkeypatch.setattr(similarity, "stage", lambda df, x: label.append(x) or stage(df, x))
    monkeypatch.setattr(similarity, "ROUND_PAIRS", 10)
    assert rows(similarity.near_counts(units, 0.7, 2, 5, 9), *cols) == want and label.count("similar-counts") >= 2
