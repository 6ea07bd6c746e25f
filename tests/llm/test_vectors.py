import numpy as np
import pytest

from driftline.llm import queries, vectors

SCHEMA = "vec_id long, embedding array<float>, score string"


def slow(ids, x, asks, k):
    out = {}
    for i in np.nonzero(asks)[0]:
        score = (x * x[i]).sum(1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(r + 1, int(ids[j]), float(score[j])) for r, j in enumerate(order)]
    return out


def collected(df):
    out = {}
    for r in sorted(df.collect()):
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def recall(got, want):
    hits = sum(len({v for _, v, _ in got.get(q, [])} & {v for _, v, _ in w}) for q, w in want.items())
    return hits / sum(map(len, want.values()))


@pytest.mark.parametrize("dim", [1, 3, 64, 100])
def test_bounds_hold(dim):
    rng = np.random.default_rng(dim)
    x, q = rng.standard_normal((500, dim)) + 1, rng.standard_normal((40, dim))
    center, turn = x.mean(0), vectors.rotation(dim, 1)
    assert np.allclose(turn @ turn.T, np.eye(dim))
    estimate, error = vectors.bounds(q, *vectors.encode(x, center, turn), center, turn, 3.0)
    assert (np.abs(q @ x.T - estimate) <= error).mean() > 0.99


def test_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 7)
    monkeypatch.setattr(vectors, "QUERY_ROWS", 2)
    rng = np.random.default_rng(0)
    base = rng.standard_normal((40, 8)).astype("f4")
    base[5] = base[6] = base[7] = base[4]
    rows = [(i, base[i].tolist()) for i in range(40)]
    bad = [(100, None), (120, []), (140, [0.0] * 8), (160, [1.0, None] + [0.0] * 6), (180, [float("nan")] * 8), (200, [float("inf")] + [1.0] * 7), (None, [1.0] * 8)]
    other = [(220, [1.0, 2.0]), (221, [3.0, -1.0]), (240, [1.0] * 5)]
    frame = spark.createDataFrame([(*r, "x") for r in rows + bad + other + [rows[0], rows[9]]], SCHEMA)
    got = collected(vectors.search(frame, vectors.F.col("vec_id") % 20 == 0))
    x = base.astype(float)
    want = slow(np.arange(40), x, np.arange(40) % 20 == 0, 20)
    want[220] = [(1, 221, 1.0)]
    assert got.keys() == want.keys()
    for q, rows_ in want.items():
        assert [r[:2] for r in got[q]] == [r[:2] for r in rows_]
        assert np.allclose([r[2] for r in got[q]], [r[2] for r in rows_], rtol=1e-12)
    assert vectors.search(frame.limit(0), vectors.F.col("vec_id") > 0).count() == 0


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_recall_against_brute_force(spark, size):
    d = f"/root/testdata/{size}"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], np.float64)
    want = slow(ids, x, ids % 20 == 0, 20)
    got = collected(queries.op6_one_bit_codes(spark, d))
    assert recall(got, want) >= 0.99
    scores = {(q, v): s for q, w in want.items() for _, v, s in w}
    for q, found in got.items():
        assert [r for r, *_ in found] == list(range(1, 21))
        assert all(abs(scores[q, v] - s) < 1e-9 for _, v, s in found if (q, v) in scores)
