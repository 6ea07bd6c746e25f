import itertools
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from driftline.llm import lines, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup, "n_repeat_words": len(hit)}


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab#|é \n\t\x0b\x1c\x85", max_size=60))
def test_counts_equal_the_slow_ones(text):
    assert lines.base_counts(text) == slow_counts(text)


def test_counts_of_null():
    assert set(lines.base_counts(None).values()) == {0}


def test_viterbi_against_every_sequence():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 8):
        field = lines.LineField(rng.standard_normal(3), rng.standard_normal((2, 2)))
        x = rng.standard_normal((n, 3))
        value = lambda ys: sum((x @ field.emission)[i] * y for i, y in enumerate(ys)) + sum(field.transition[a, b] for a, b in zip(ys, ys[1:]))  # noqa: B023,E731
        best = max(itertools.product((0, 1), repeat=n), key=value)
        assert tuple(field.decode(x)) == best
    assert len(lines.LineField(np.zeros(3), np.zeros((2, 2))).decode(np.zeros((0, 3)))) == 0


def test_gradient_of_the_likelihood():
    rng = np.random.default_rng(3)
    x, y = rng.standard_normal((4, 5, 3)), rng.integers(0, 2, (4, 5))
    live = np.arange(5)[None, :] < np.array([5, 3, 1, 4])[:, None]
    w, t = rng.standard_normal(3), rng.standard_normal((2, 2))
    value, ge, gt = lines.log_likelihood(lines.LineField(w, t), x, y, live)
    total = 0.0
    for d in range(4):
        n = int(live[d].sum())
        score = lambda ys: sum(x[d, i] @ w * v for i, v in enumerate(ys)) + sum(t[a, b] for a, b in zip(ys, ys[1:]))  # noqa: B023,E731
        total += score(tuple(y[d, :n])) - np.log(sum(np.exp(score(ys)) for ys in itertools.product((0, 1), repeat=n)))
    assert np.isclose(value, total)
    f = lambda w, t: lines.log_likelihood(lines.LineField(w, t), x, y, live)[0]
    for i in range(3):
        h = np.eye(3)[i] * 1e-5
        assert np.isclose((f(w + h, t) - f(w - h, t)) / 2e-5, ge[i], rtol=1e-4)
    h = np.array([[0, 1e-5], [0, 0]])
    assert np.isclose((f(w, t + h) - f(w, t - h)) / 2e-5, gt[0, 1], rtol=1e-4)


def test_edge_cases(spark):
    good, junk = "A%d plain sentence of%d several words%d stands here%d on line %d.\n", "BUY%d!! NOW!! ### | | $$$ CLICK!! %% HERE!!\n"
    text = lambda kind, i: "".join(kind.replace("%d", str(i * 50 + j)) for j in range(12))
    rows = [(i, text(good if i % 2 else junk, i)) for i in range(40)]
    odd = [(100, None), (101, ""), (102, "\n\n \t"), (1, rows[1][1]), (None, rows[3][1]), (103, "word " * 60), (104, text(good, 9) * 300)]
    mixed = (105, text(good, 77) + text(junk, 78)[:200])
    docs = spark.createDataFrame([(*r, 1) for r in rows + odd + [mixed]], "doc_id long, text string, kept int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (7, None), (8, 3)], "doc_id long, quality int")
    got = lines.assess(docs, labels).collect()
    assert len(got) == len(rows) + len(odd) + 1
    for r in got:
        assert {k: r[k] for k in lines.COUNTS} == slow_counts(r.text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    by = {r.doc_id: r for r in got}
    assert all(by[i].kept == bool(i % 2) for i in range(40)) and by[None].kept and by[105].kept
    assert not any(by[i].kept for i in (100, 101, 102, 103)) and 0.5 < by[105].content_share < 1
    no_labels = lines.assess(docs, labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in no_labels)
    assert lines.assess(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_query_keeps_clean_documents(spark, size):
    d = f"/root/testdata/{size}"
    rows = {r.doc_id: r for r in queries.op3_line_field(spark, d).collect()}
    texts = dict(map(tuple, spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()))
    assert rows.keys() == texts.keys()
    if size == "sf0.01":
        for k, r in rows.items():
            assert {c: r[c] for c in lines.COUNTS} == slow_counts(texts[k])
    labels = spark.read.parquet(f"{d}/labels.parquet").collect()
    # half of the labels, by the hash of the key, were not seen in training at sf0.1
    kept = [(r.quality, rows[r.doc_id].kept) for r in labels if not rows[r.doc_id].base_failed]
    rate = lambda q: np.mean([k for x, k in kept if x == q])
    assert rate(1) >= 0.99 and rate(0) <= 0.05


def test_sample_is_whole_and_defined(spark):
    docs = [(i, f"line {i}\n" * (i + 1)) for i in range(12)] + [(3, "a smaller text"), (20, None), (None, "no key"), (21, "x" * 5000)]
    labels = [(i, i % 2) for i in range(12)] + [(4, 1), (5, 1), (20, 0), (None, 0), (99, 0), (21, 0)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = lines.labelled_sample(d, q, 50, 2000)
    text = {k: min(t for x, t in docs if x == k) for k in range(12)}
    # 4 is labelled both ways, 20 has no text, 21 is longer than all may be together
    assert got == [(k, text[k], k % 2 == 1) for k in range(12) if k != 4]
    assert lines.labelled_sample(d.orderBy("text").repartition(4), q.repartition(3), 50, 2000) == got
    assert [sum(g == x for *_, g in lines.labelled_sample(d, q, 3, 2000)) for x in (True, False)] == [3, 3]


def test_the_end_of_a_long_document_is_learned():
    good, bad = "A plain sentence of several words stands here.\n", "BUY NOW!! ### $$$ CLICK!!\n"
    texts = [good * 200, good * 80 + "".join(bad for _ in range(120))]
    field = lines.train(texts * 5, [True, False] * 5)
    found = field.decode(lines.line_features(texts[1])[0])
    assert found[:80].sum() == 0 and found[-100:].all()


def test_held_out_verdicts(spark):
    """The field learns from 250 documents a quality; the others are judged."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    seen = {k for k, *_ in lines.labelled_sample(docs, labels, 250, 4_000_000)}
    judged = {r.doc_id: r for r in lines.assess(docs, labels, per_label=250, keep=["doc_id"]).collect()}
    rest = [(r.quality, judged[r.doc_id].kept) for r in labels.collect() if r.doc_id not in seen and not judged[r.doc_id].base_failed]
    rate = lambda q: np.mean([k for x, k in rest if x == q])
    print("held out:", len(rest), rate(1), sum(q == 0 for q, _ in rest), rate(0))
    assert len(rest) > 1000 and rate(1) >= 0.99 and rate(0) <= 0.05
