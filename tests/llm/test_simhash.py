import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from driftline.llm import simhash
from driftline.llm.components import components

SCHEMA = "doc_id long, text string"


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def slow_components(keys, words, radius):
    label = list(range(len(words)))
    for i in range(len(words)):
        for j in range(i):
            if bin((words[i] ^ words[j]) & (2**64 - 1)).count("1") <= radius and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for k, x in zip(keys, label, strict=True):
        if k is not None:
            least[x] = min(k, least.get(x, k))
    return [least.get(x) for x in label]


def test_fingerprint_equals_the_slow_one():
    cases = [None, "", "  \n", "a", "A b", "a b c", "Ab Cd\tef\x0bgh  x É ß y", "x y " * 50, "É a\n\n b", "\x1cq a b"]
    assert [simhash.fingerprint(t) for t in cases] == [slow_fingerprint(t) for t in cases]


def test_fingerprint_equals_the_engine_hash(spark):
    text = "One short sentence"
    row = spark.range(1).select(F.xxhash64(F.lit(text.lower())).alias("h")).first()
    assert simhash.fingerprint(text) == row.h


@pytest.mark.parametrize("blocks", [1, 2, 4])
@pytest.mark.parametrize("tile", [3, 4096])
def test_links_connect_what_brute_force_connects(spark, blocks, tile):
    rng = random.Random(blocks)
    words = {0, -1, 2**63 - 1, -(2**63)}
    for _ in range(12):
        w = rng.getrandbits(64)
        for _ in range(8):
            words.add(w - (1 << 64) if w >> 63 else w)
            for b in rng.sample(range(64), rng.randint(1, 4)):
                w ^= 1 << b
    words = sorted(words)
    frame = spark.createDataFrame([(w,) for w in words], "fp long")
    found = {r.node: r.component for r in components(simhash.links(frame, 3, tile, blocks)).collect()}
    assert [found.get(w, w) for w in words] == slow_components(words, words, 3)


def test_groups_on_edge_cases(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [
        (5, base), (3, base.upper().replace("W", "w")), (9, base + " tail"), (9, base + " tail"), (None, base),
        (4, None), (8, ""), (7, " \n\t"), (2, "a b"), (11, "word " * 5000), (None, "alone here"), (None, "alone here"),
    ]
    frame = spark.createDataFrame([(*r, 1.5) for r in rows], SCHEMA + ", component_id double")
    got = simhash.groups(frame).select("doc_id", "fp", "component_id").toPandas().astype(object)
    words = [slow_fingerprint(t) for _, t in rows]
    want = pd.DataFrame(
        {"doc_id": [k for k, _ in rows], "fp": words, "component_id": slow_components([k for k, _ in rows], words, 3)}
    ).astype(object)
    key = lambda f: sorted(tuple("-" if pd.isna(v) else str(int(v)) for v in r) for r in f.itertuples(index=False))
    assert key(got) == key(want)


def test_groups_of_an_empty_table(spark):
    assert simhash.groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_representatives_keep_one_row_of_each_group(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base, "x"), (3, base, "y"), (9, "other text here", "z"), (9, "other text here", "z"), (None, base, "q")]
    frame = spark.createDataFrame(rows, SCHEMA + ", fp string")
    got = sorted(map(tuple, simhash.representatives(frame).collect()))
    assert got == [(3, base, "y"), (9, "other text here", "z")]


def test_whole_corpus_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = simhash.groups(docs).toPandas().sort_values("doc_id")
    words = got["fp"].to_numpy(np.int64).view(np.uint64)
    close = np.bitwise_count(words[:, None] ^ words[None, :]) <= 3
    label = np.arange(len(words))
    while True:
        new = np.where(close, label[None, :], len(words)).min(1)
        if (new == label).all():
            break
        label = new
    assert (got["doc_id"].to_numpy()[label] == got["component_id"].to_numpy()).all()
    assert (got["component_id"] != got["doc_id"]).any()


def test_components_of_a_long_path(spark):
    path = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    got = components(path.union(spark.createDataFrame([(500, 400)], "a long, b long")))
    assert {r.node: r.component for r in got.collect()} == {**{i: 0 for i in range(200)}, 400: 400, 500: 400}
