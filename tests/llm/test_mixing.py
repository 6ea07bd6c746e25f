from fractions import Fraction
from collections import Counter

import pytest
from pyspark.sql import functions as F

from driftline.llm import mixing, queries

from .oracle import frame_rows, rows_of




def fill(budget, children):
    """Water filling of ``{name: (weight, capacity)}`` with exact fractions."""
    out, open_ = {}, {k: v for k, v in children.items() if v[0] > 0}
    budget = Fraction(budget)
    while open_:
        unit = budget / sum(w for w, _ in open_.values())
        full = [k for k, (w, c) in open_.items() if c <= w * unit]
        if not full:
            return {**{k: 0 for k in children}, **out, **{k: int(w * unit) for k, (w, _) in open_.items()}}
        for k in full:
            out[k] = open_.pop(k)[1]
            budget -= out[k]
    return {**{k: 0 for k in children}, **out}


def mixed(spark, rows, weights, schema="doc_id long, a string, b string, n long", **more):
    frame = spark.createDataFrame(rows, schema)
    return mixing.mix(frame, {x: F.col(x) for x in "ab"}, weights, tokens=F.coalesce("n", F.lit(0)), **more)


def test_budgets_are_water_filled_siblings_first(spark):
    rows, weights, i = [], ({"x": 3, "y": 1, "z": 0}, {"p": 5, "q": 1}), 0
    for a, sizes in {"x": {"p": 40, "q": 400, "r": 900}, "y": {"p": 300, "q": 7}, "z": {"p": 100}, None: {None: 50, "p": 60}}.items():
        for b, n in sizes.items():
            for _ in range(n // 10 + 1):
                rows.append((i, a, b, 10))
                i += 1
    tokens = Counter()
    for _, a, b, n in rows:
        tokens[a, b] += n
    total = sum(tokens.values()) * 2 // 3
    first = {a: (weights[0].get(a, 1), 3 * sum(n for (x, _), n in tokens.items() if x == a)) for a, _ in tokens}
    want = {}
    for a, budget in fill(total, first).items():
        below = {b: (weights[1].get(b, 1), 3 * n) for (x, b), n in tokens.items() if x == a}
        want |= {(a, b): v for b, v in fill(budget, below).items()}
    got = mixed(spark, rows, weights, total=(2, 3), max_epochs=3).groupBy("a", "b").agg(F.sum("tokens_taken").alias("t")).collect()
    assert {(r.a, r.b): r.t for r in got} == {k: v for k, v in want.items() if v}
    assert want["x", "p"] == 3 * tokens["x", "p"]  # used up, and its siblings took over


@pytest.mark.parametrize("few", [0, 20_000])
def test_prefix_and_epochs(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", few)
    monkeypatch.setattr(mixing, "BUCKETS", 8)
    rows = [(i, "x", "p", 7 + i % 5) for i in range(200)] + [(1000 + i, "x", "q", 1) for i in range(30)]
    got = mixed(spark, rows, ({}, {"p": 3, "q": 2}), total=(1, 2), max_epochs=2).collect()
    by_doc = Counter(r.doc_id for r in got)
    q = {k: n for k, n in by_doc.items() if k >= 1000}
    assert set(q.values()) == {2} and len(q) == 30
    p = [r for r in got if r.b == "p"]
    budget = sum(n for *_, n in rows) // 2 - 60
    assert sum(r.tokens_taken for r in p) == budget and all(r.epoch == 0 for r in p)
    import hashlib

    order = sorted(rows[:200], key=lambda r: hashlib.md5(f"7:0:{r[0]}".encode()).hexdigest())
    assert {r.doc_id for r in p} == {r[0] for r in order[: len(p)]}
    assert [r.doc_id for r in p if r.tokens_taken < r.n_tokens] in ([], [order[len(p) - 1][0]])


def test_edge_cases(spark):
    rows = [(1, "x", "p", 5, 0.1), (1, "x", "p", 5, 0.1), (None, "x", None, 4, 0.2), (3, None, "q", 0, 0.3), (4, "y", "p", None, 0.4)]
    schema = "doc_id long, a string, b string, n long, epoch double"
    got = mixed(spark, rows, ({}, {}), schema, total=(1, 1), max_epochs=1)
    assert got.columns == ["doc_id", "n", "a", "b", "epoch", "n_tokens", "tokens_taken"]
    # a leaf without tokens has no budget and no whole epoch
    assert sorted((r.doc_id or 0, r.tokens_taken) for r in got.collect()) == [(0, 4), (1, 5), (1, 5)]
    assert mixed(spark, [], ({}, {}), schema).count() == 0


def test_words(spark):
    rows = [(None,), ("",), (" \t\n",), ("a b\x0bc\x1cd é",), ("w " * 100_000,)]
    got = spark.createDataFrame(rows, "text string").select(mixing.word_tokens()).collect()
    assert [r[0] for r in got] == [0, 0, 0, 4, 100_000]


def test_query_equals_its_sql_and_stays_native(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op7_mix_budget(spark, d)
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert frame_rows(got) == rows_of(queries.ORACLE_SQL["op7_mix_budget"], d)
