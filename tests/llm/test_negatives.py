from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import negatives, queries

from .oracle import frame_rows, rows_of

SCHEMA = "vec_id long, embedding array<double>, label string, score string, rank string"


def slow(rows, is_anchor, positives=5, wanted=10, low=30, high=90):
    """Every pair by plain Python integers."""
    good = {(i, label, tuple(int(np.floor(256 * x)) for x in v)) for i, v, label in rows if None not in (i, v, label) and all(x is not None and np.isfinite(x) for x in v)}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, label, v in good:
        if not is_anchor(i):
            continue
        others = [(-dot(v, w), j, m == label) for j, m, w in good if j != i and len(w) == len(v)]
        for p, j, _ in sorted(o for o in others if o[2])[:positives]:
            fit = sorted(o[:2] for o in others if not o[2] and low * -p <= 100 * -o[0] <= high * -p)[:wanted]
            out += [(i, j, r, n, -p, -s) for r, (s, n) in enumerate(fit, 1)]
    return Counter(out)


def mined(frame, **more):
    got = negatives.hard_negatives(frame, F.col("vec_id") % 10 == 0, F.col("label"), **more)
    return Counter(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def framed(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


@pytest.mark.parametrize("dim", [1, 2, 5, 40])
def test_candidates_lose_nothing(dim):
    rng = np.random.default_rng(dim)
    x = np.floor(256 * rng.standard_normal((300, dim)) * rng.lognormal(size=(300, 1))).astype(np.int64)
    x[7] = 0
    bucket = negatives.Bucket(np.arange(300), np.array(["a"] * 300), x, negatives.Bucket.orders(x))
    fewer = 0
    for q in x[:40]:
        scores = x @ q
        for t in (-5, 0, *np.sort(scores)[[-1, -2, -5, -20, -100]], scores.max() + 1):
            found = negatives.candidates(bucket, q, int(t))
            assert set(np.nonzero(scores >= t)[0]) <= set(found) and len(set(found)) == len(found)
            assert (bucket.scores(found, q) == scores[found]).all()
            fewer += t > 0 and len(found) < 150
    assert fewer > 10 or dim > 5  # random directions in many dimensions leave wide ranges


@pytest.mark.parametrize("bucket_rows, anchor_rows", [(4096, 2048), (16, 3)])
def test_against_all_pairs(spark, monkeypatch, bucket_rows, anchor_rows):
    monkeypatch.setattr(negatives, "ANCHOR_ROWS", anchor_rows)
    monkeypatch.setattr(negatives, "GROUP_BUCKETS", 1 if bucket_rows == 16 else 8)
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((6, 12))
    rows = [(i, (centre[i % 6] + 0.4 * rng.standard_normal(12)).tolist(), "hot" if i % 3 else f"l{i % 5}") for i in range(400)]
    rows += [(i + 1000, rows[i][1], rows[i][2]) for i in range(0, 60)]  # equal vectors under other keys
    assert mined(framed(spark, rows).repartition(7)) == slow(rows, lambda i: i % 10 == 0)


def test_edge_cases(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-3, 4, 3).astype(float).tolist(), "ab"[i % 2]) for i in range(30)]
    rows += [rows[0], rows[10], (10, [9.0, 9.0, 9.0], "a"), (10, rows[1][1], "b")]  # repeats, and other rows under one key
    rows += [(100, None, "a"), (110, [1.0, None, 2.0], "a"), (120, [float("nan")] * 3, "a"), (130, [float("inf"), 0.0, 0.0], "b"), (140, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], "a")]
    rows += [(150, [0.0, 0.0, 0.0], "a"), (160, [], "a"), (161, [], "b"), (170, [2.0, 1.0], "a"), (171, [2.0, 2.0], "a"), (172, [1.0, 1.0], "b"), (180, [5e6, 5e6, -7e6], "z"), (181, [5e6, 4e6, -7e6], "z"), (182, [3e6, 3e6, -5e6], "y")]
    assert mined(framed(spark, rows)) == slow(rows, lambda i: i % 10 == 0)
    assert mined(framed(spark, rows), positives=1, negatives=2, low=0, high=200) == slow(rows, lambda i: i % 10 == 0, 1, 2, 0, 200)
    assert mined(framed(spark, rows).limit(0)) == Counter()
    assert mined(framed(spark, rows[1:4])) == Counter()  # no anchor


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_query_equals_its_sql(spark, size):
    d = f"/root/testdata/{size}"
    got = frame_rows(queries.op12_hard_negatives(spark, d))
    assert got == rows_of(queries.ORACLE_SQL["op12_hard_negatives"], d)
    assert sum(got[1].values()) > 50
