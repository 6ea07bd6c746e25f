import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from driftline.llm import language

SCHEMA = "doc_id long, text string, lang string"


def slow_bits(samples, text, order, min_count):
    """Code length under each language, straight from counts of byte strings."""
    joined = {k: b"\n".join([b"", *v]) for k, v in samples.items()}
    count = {k: {} for k in joined}
    for k, data in joined.items():
        for n in range(order + 2):
            for i in range(len(data) - n + 1):
                count[k][data[i : i + n]] = count[k].get(data[i : i + n], 0) + 1
    known = {g for k in count for g, c in count[k].items() if len(g) <= order and c >= (min_count if len(g) > 1 else 1)}
    result = {}
    for k in joined:
        total = 0.0
        for i in range(len(text)):
            context = next(text[i - n : i] for n in range(min(order, i), -1, -1) if text[i - n : i] in known)
            p, out = 1.0, set()
            while True:
                seen = {s: count[k].get(context + bytes([s]), 0) for s in range(256)}
                fresh = {s: c for s, c in seen.items() if c and s not in out}
                if fresh:
                    total_n, kinds = sum(fresh.values()), len(fresh)
                    if text[i] in fresh:
                        p *= fresh[text[i]] / (total_n + kinds)
                        break
                    p *= kinds / (total_n + kinds)
                    out |= set(fresh)
                if not context:
                    p /= 256 - len(out)
                    break
                context = context[1:]
            total -= math.log2(p)
        result[k] = total
    return result


def test_code_lengths_equal_the_slow_ones():
    samples = {"x": [b"abracadabra abracadabra", b"bar bar bar"], "y": [b"cadabra cada dada", "é dé fé dé".encode()]}
    model = language.train(samples, 3, 2)
    texts = [b"abra cada", "dé zz".encode(), b"", b"a" * 40, b"bar cadabra abracadabra dada" * 5]
    for segment in (7, 512):
        got = language.code_lengths(model, texts, segment, lanes=3)
        for row, t in zip(got, texts, strict=True):
            want = slow_bits(samples, t, 3, 2)
            assert np.allclose(row, [want["x"], want["y"]], rtol=1e-4)


def test_a_context_distribution_sums_to_one():
    model = language.train({"x": [b"the cat sat on the mat " * 9]}, 3, 2)
    other = (model.symbol == 0).sum()
    p = np.exp2(-model.bits[:, :, 0].astype(float))
    assert np.allclose(p[:, 1:].sum(1) + other * p[:, 0], 1, atol=1e-4)


def test_edge_cases(spark):
    en, de = "the cat and the dog ", "der hund und die katze "
    rows = [(i, (en if i % 2 else de) * 5, "en" if i % 2 else "de") for i in range(40)]
    odd = [(100, None, "en"), (101, "", "en"), (102, "12 34 !!", None), (103, en * 20000, None), (None, de, "de"), (1, en * 5, "en")]
    frame = spark.createDataFrame([(*r, 7) for r in rows + odd], SCHEMA + ", score int")
    got = language.identify(frame).collect()
    assert len(got) == len(rows) + len(odd) and got[0].asDict().keys() == {"doc_id", "text", "lang", "lang_pred", "score", "bits_per_byte"}
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (100, 101, 102, 103, None)] == ["und", "und", "und", "en", "de"]
    assert all(by[i].lang_pred == ("en" if i % 2 else "de") for i in range(40))
    assert all(0 <= r.score <= 1 for r in got)


def test_nothing_to_learn_from(spark):
    frame = spark.createDataFrame([(1, "some words", None)], SCHEMA)
    assert language.identify(frame).first().lang_pred == "und"
    assert language.identify(spark.createDataFrame([], SCHEMA)).count() == 0


def test_held_out_fold(spark):
    rows = spark.range(50).select(F.col("id").alias("doc_id"), language.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    row = (
        language.identify(docs).filter(language.held_out())
        .agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a")).first()
    )
    assert row.a >= 0.97


def test_sample_takes_whole_texts_within_its_bounds(spark):
    rows = [(i, f"{i:03d} " + "ab" * 48, "x") for i in range(60)] + [(100, "y" * 5000, "y"), (101, "w" * 5000, "z"), (102, "v", "z")]
    frame = spark.createDataFrame(rows, SCHEMA)
    every = F.lit(True)
    got = language.training_sample(frame, every, 20, 1000)
    assert len(got["x"]) == 10 and all(len(t) == 100 for t in got["x"])  # 100 characters each, 1000 in all
    assert got["y"] == [b"y" * 5000] and got["z"] == [b"v"]  # too long alone: only for want of another
    assert len(language.training_sample(frame, every, 20, 10_000)["x"]) == 20
    mixed = frame.orderBy(F.rand(3)).repartition(5)
    assert language.training_sample(mixed, every, 20, 1000) == got


def test_held_out_accuracy_of_a_rare_language(spark):
    """One language keeps 20 labels, the others all of theirs."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rare = docs.filter(~language.held_out()).groupBy("lang").count().orderBy("count", "lang").first().lang
    few = [r.doc_id for r in docs.filter(~language.held_out() & (F.col("lang") == rare)).orderBy(F.crc32(F.col("doc_id").cast("string").cast("binary"))).limit(20).collect()]
    told = docs.withColumn("told", F.when((F.col("lang") != rare) | F.col("doc_id").isin(few), F.col("lang")))
    found = language.identify(told.withColumnRenamed("lang", "truth").withColumnRenamed("told", "lang"), keep=["doc_id", "truth"])
    row = found.filter(language.held_out() & (F.col("truth") == rare)).agg(F.avg((F.col("truth") == F.col("lang_pred")).cast("double")).alias("a"), F.count("*").alias("n")).first()
    print("rare language:", rare, row.n, row.a)
    assert row.a >= 0.97
