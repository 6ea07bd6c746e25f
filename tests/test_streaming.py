"""Keyed state of the online scorer: restarts, rows out of order and rows too late."""

import datetime as dt
import math

from pyspark.sql import functions as F

from driftline.session import shared_folder
from driftline.streaming import jobs

DAY0 = dt.date(2020, 1, 1)
SCHEMA = "doc_id long, cls string, filed date, body string"


def slow_scores(docs, vocab, halflife):
    """Each document against all documents of its class on earlier days."""
    out = {}
    for i, cls, day, words in docs:
        own = [w for w in words.split() if (cls, w) in vocab]
        past = [(d, ws.split()) for _, c, d, ws in docs if c == cls and d < day and ws]
        if not own:
            continue
        if not past:
            out[i] = None
            continue
        fade = lambda d: 2 ** (-(day - d) / 365.25 / halflife)
        ref = {w: sum(fade(d) * ws.count(w) for d, ws in past) for c, w in vocab if c == cls}
        total = sum(ref.values()) + len(ref)
        p = {w: own.count(w) / len(own) for w in own}
        out[i] = sum(x * math.log(x / ((ref[w] + 1) / total)) for w, x in p.items())
    return out


def test_restart_order_and_lateness(spark):
    vocab = {("a", w) for w in "pqrs"} | {("b", w) for w in "pq"}
    frame = spark.createDataFrame(sorted(vocab), "cls string, term string")
    first = [(1, "a", 0, "p q q"), (2, "a", 40, "p r x"), (3, "b", 5, "p"), (4, "b", 30, "q q p"), (5, "a", 41, "x"), (6, "a", 20, "")]
    second = [(7, "a", 25, "s s p"), (8, "a", 60, "q s"), (9, "b", 45, "p q"), (10, "b", 45, "q")]  # 7 is late, but in time
    third = [(11, "a", 3, "p p"), (12, "b", 80, "p"), (13, "a", 80, "r r")]  # 11 is too late
    root = shared_folder(spark, "test-stream")
    done = []
    for rows in (first, second, third, [(None, "", 40_000, "")]):
        days = [(i, c, DAY0 + dt.timedelta(d), w) for i, c, d, w in rows]
        spark.createDataFrame(days, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")
        # a new object each time: all it knows is under its root
        online = jobs.OnlineSurprise(spark, frame, F.split("body", " "), root, 0.5, delay="20 days", buckets=3)
        online.run(spark.readStream.schema(SCHEMA).parquet(f"{root}/in"))
        done.append({r.doc_id: r.kl_past for r in online.scores().collect()})
    assert spark.conf.get(jobs.PROVIDER, "none") != jobs.ROCKSDB
    # a day is scored once the watermark has passed it, and never changes
    assert set(done[0]) == {1, 3} and set(done[0]) < set(done[1]) < set(done[2]) < set(done[3])
    for early, late in zip(done, done[1:]):
        assert all(late[i] == v or math.isclose(late[i], v) for i, v in early.items())
    want = slow_scores([d for d in first + second + third if d[0] != 11], vocab, 0.5)
    assert done[3].keys() == want.keys()
    for i, v in want.items():
        assert (done[3][i] is None) if v is None else math.isclose(done[3][i], v, rel_tol=1e-9, abs_tol=1e-12)


def test_a_document_moves_as_a_row_a_bucket_and_meets_no_vocabulary(spark):
    vocab = spark.createDataFrame([("a", "p")], "cls string, term string")
    docs = [(1, "a", DAY0, " ".join(f"w{i} w{i} p" for i in range(50))), (2, "a", DAY0, ""), (None, "", DAY0, ""), (3, "b", DAY0, None)]
    docs = spark.createDataFrame(docs, SCHEMA).withColumn("at", F.col("filed").cast("timestamp"))
    online = jobs.OnlineSurprise(spark, vocab, F.split("body", " "), "", 0.5, buckets=3)
    rows = online.rows(docs)
    got = rows.filter("day is not null").collect()
    assert sorted((r.doc_id, r.bucket) for r in got if r.doc_id) == [(1, 0), (1, 1), (1, 2)]
    assert [r.terms for r in got if not r.doc_id] == [None]
    counts = {t: c for r in got if r.doc_id for t, c in zip(r.terms, r.cnts)}
    want = spark.range(50).select(F.xxhash64(F.concat(F.lit("w"), F.col("id").cast("string")))).collect()
    assert len(counts) == 51 and all(counts[t] == 2 for t, in want) and sorted(counts.values())[-1] == 50
    assert "Join" not in rows._jdf.queryExecution().executedPlan().toString()


def test_days_are_scored_in_pieces(monkeypatch):
    import numpy as np

    def scored(held):
        monkeypatch.setattr(jobs.TermDecay, "HELD", held)
        p, kept = jobs.TermDecay(0.7, 1.0), {}

        class Value:
            def __init__(self, name): self.name = name  # noqa: E704
            def exists(self): return self.name in kept  # noqa: E704
            def get(self): return kept[self.name]  # noqa: E704
            def update(self, v): kept[self.name] = v  # noqa: E704

        class Handle:
            def getValueState(self, name, _): return Value(name)  # noqa: E704
            def getListState(self, *_): return waiting  # noqa: E704
            def registerTimer(self, _): pass  # noqa: E704

        class Waiting(list):
            appendValue, get = list.append, list.copy

        class Times:
            def getCurrentWatermarkInMs(self): return 900 * jobs.DAY_MS  # noqa: E704

        waiting, rng = Waiting(), np.random.default_rng(3)
        p.init(Handle())
        vocab = jobs.pd.DataFrame({"term": rng.integers(-(2**63), 2**63 - 1, 40)})
        for lo in (0, 20):  # state comes in batches
            p.handleInitialState(("a", 0), vocab[lo : lo + 20], None)
        terms = [rng.choice(vocab["term"], rng.integers(0, 9), False) for _ in range(300)]
        frame = jobs.pd.DataFrame({"doc_id": range(300), "day": rng.integers(0, 1000, 300), "terms": terms, "cnts": [t % 5 + 1 for t in terms]})
        list(p.handleInputRows(("a", 0), iter([frame[:100], frame[100:]]), None))
        out = jobs.pd.concat(p.handleExpiredTimer(("a", 0), Times(), None)).sort_values("doc_id").reset_index(drop=True)
        assert set(out["doc_id"]) == set(frame[frame["day"] <= 900]["doc_id"]) and len(waiting) > 0
        return out

    whole = scored(10**6)
    assert (whole["n_terms"] > 0).any() and (whole["n_terms"] == 0).any()
    jobs.pd.testing.assert_frame_equal(whole, scored(7))
