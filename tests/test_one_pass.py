"""Scores in one pass over the terms: equal to those with an explicit vocabulary, with one shuffle of the rows."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from driftline.operators import surprise, vocabulary
from driftline.plans import bindings as b

@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)
    rows = []
    for i in range(120):
        filed = date(1995, 1, 1) + timedelta(days=rng.randrange(1800))
        body = " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("xyz") for _ in range(rng.randrange(12)))
        rows.append((i, "uv"[i % 2], filed, filed.year, f"o{i % 9}", "m", body))
    return spark.createDataFrame(rows, "doc_id long, cls string, filed date, year int, owner string, mark string, body string")


def terms_of(docs):
    return vocabulary.by_term(vocabulary.document_terms(docs, F.split("body", " "), unique=True).filter("term <> ''"))


def equal(one, two):
    cols = sorted(one.columns)
    assert cols == sorted(two.columns)
    rows = lambda df: sorted([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(cols).collect()], key=repr)
    assert rows(one) == rows(two)


def test_terms_are_counted_inside_a_row(spark):
    df = spark.createDataFrame([(1, "b a b c b"), (2, ""), (3, None), (4, "a")], "doc_id long, body string")
    got = vocabulary.document_terms(df, F.split("body", " "), keep=(), unique=True)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a", 1), (1, "b", 3), (1, "c", 1), (2, "", 1), (4, "a", 1)]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_rows_with_the_same_key_are_added_up(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a")], "doc_id long, body string")
    assert not b.keys_unique(df)
    got = vocabulary.document_terms(df, F.split("body", " "), keep=())
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a", 2), (1, "b", 1)]


def test_scores_equal_those_with_a_vocabulary(docs):
    terms, bounds = terms_of(docs), surprise.Bounds(2, 0.4)
    vocab = vocabulary.build_vocabulary(docs, terms, *bounds)
    keep = lambda df, _: df
    spans = {"past": (-2, -1), "future": (1, 3)}
    equal(surprise.corpus_span_scores(docs, terms, keep, spans, bounds=bounds), surprise.span_scores(docs, terms, vocab, spans))
    for h, got in zip((1.0, 0.5), surprise.corpus_decay(docs, terms, keep, (1.0, 0.5), bounds=bounds)):
        equal(got, surprise.decay(docs, terms, vocab, h, h))
    equal(
        surprise.corpus_monthly_freshness(docs, terms, keep, bounds=bounds), surprise.monthly_freshness(docs, terms, vocab)
    )
    equal(surprise.corpus_term_contributions(docs, terms, keep, 2, bounds=bounds), surprise.term_contributions(docs, terms, vocab, 2))
    free = vocabulary.build_vocabulary(docs, terms, *bounds, by=())
    equal(surprise.corpus_borrowed_novelty(docs, terms, keep, 2, bounds=bounds), surprise.borrowed_novelty(docs, terms, free, 2))


def test_weights_beyond_a_double_take_the_other_way(docs):
    assert surprise.corpus_decay(docs, terms_of(docs), lambda df, _: df, [0.001]) is None


def test_rows_are_dealt_by_term_once(docs):
    rows = surprise.vocabulary_rows(
        surprise._class_sizes(docs), terms_of(docs), surprise._span_sums({"past": (-2, -1), "future": (1, 2)}, "year"), "year", surprise.Bounds(2, 0.4)
    )
    plan = rows.select("doc_id", "term", "tf_past")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(term") == 1 and plan.count("SortMergeJoin") == 0


def test_a_vocabulary_is_not_dealt_by_class(docs):
    plan = vocabulary.build_vocabulary(docs, terms_of(docs), 2, 0.4)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning(term") == 1


def test_fuzzy_pairs_are_not_made_distinct(spark):
    from driftline.operators import entities

    names = spark.createDataFrame([("acme tools 1",), ("acme tools 2",), ("other thing",)], "norm string")
    got = entities.fuzzy_candidates(names, names)
    assert sorted(tuple(r) for r in got.collect()) == [("acme tools 1", "acme tools 2", 1), ("acme tools 2", "acme tools 1", 1)]
    assert "keys=[norm" in (plan := got._jdf.queryExecution().executedPlan().toString()) and "near#" in plan
    assert not any("HashAggregate(keys=[norm" in line and "near" in line for line in plan.splitlines())
