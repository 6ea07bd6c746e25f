import zlib
from array import array
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from driftline.llm import packing, queries

TOKENIZER = Tokenizer.from_file(packing.vocabulary_path("byte_bpe_50k.json"))
TOKENIZER.encode_special_tokens = True


def slow_ids(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, packing.END_OF_TEXT]


def check_packed(rows, capacity):
    """Sequences are gapless from 0 and none is over capacity; returns how many there are."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_ids_equal_the_tokenizers_library():
    encode = packing.encoder(packing.vocabulary_path())
    cases = ["", " ", "It's  we'll\n\n\tx", "é ß 日本語 ٣٤ ½ ⅷ", "<|endoftext|> a", "a" * 5000, " " * 3000 + "b", "_-_ __ $$%", "​﻿\x00\x85 x", "🙂👍🏽 é"]
    for t in cases:
        assert [*encode(t), packing.END_OF_TEXT] == slow_ids(t)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_ids_of_any_text(text):
    encode = packing.encoder(packing.vocabulary_path())
    assert [*encode(text), packing.END_OF_TEXT] == slow_ids(text)


PLAIN = Tokenizer.from_file(packing.vocabulary_path("byte_bpe_50k.json"))
ADDED = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "x  <|endoftext|>\n\n<|endoftext| >", "<|ENDOFTEXT|> <|endoftext"]


def plain_ids(text):
    """Ids of the JSON file as it is, its added tokens matched inside the text."""
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, packing.END_OF_TEXT]


def test_pieces_match_added_tokens(spark):
    assert plain_ids("a <|endoftext|> b")[:-1] == [64, 220, 50256, 275]
    frame = spark.createDataFrame(list(enumerate(ADDED)), "doc_id int, text string")
    for r in packing.pack_documents(frame).collect():
        assert array("I", r.ids).tolist() == plain_ids(ADDED[r.doc_id]) and r.length == len(plain_ids(ADDED[r.doc_id]))


@pytest.fixture(scope="module")
def encode_added():
    path = packing.vocabulary_path()
    return packing.encoder(path, packing.added_tokens(path))


@settings(max_examples=100, deadline=None)
@given(parts=st.lists(st.one_of(st.just("<|endoftext|>"), st.text(max_size=12)), max_size=6))
def test_ids_around_added_tokens(encode_added, parts):
    assert [*encode_added("".join(parts)), packing.END_OF_TEXT] == plain_ids("".join(parts))


def test_only_longer_documents_are_cut():
    for n in (1, 7, 8, 9, 16, 17, 40):
        ids = array("I", range(n))
        parts = packing.cut(ids, 8)
        assert b"".join(p[3] for p in parts) == ids.tobytes()
        assert [p[2] for p in parts[1:]] == [8] * (len(parts) - 1) and 1 <= parts[0][2] <= 8
        assert [p[1] for p in parts] == list(np.cumsum([0, *[p[2] for p in parts[:-1]]]))


def test_knapsack_against_every_multiset():
    rng = np.random.default_rng(3)
    for _ in range(50):
        value = np.where(rng.random(13) < 0.6, rng.random(13), -1)
        best = np.zeros(13)
        for c in range(1, 13):
            best[c] = max([best[c - 1], *(best[c - x] + value[x] for x in range(1, c + 1))])
        config, gain = packing.best_configuration(value, 12)
        assert np.isclose(gain, best[12]) and sum(x * n for x, n in config.items()) <= 12
        assert np.isclose(sum(value[x] * n for x, n in config.items()), gain)


@pytest.mark.parametrize("seed", range(4))
def test_configurations_are_whole_and_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = [rng.integers(1, 129, 40_000), rng.integers(1, 129, 90), np.minimum(127, rng.exponential(30, 30_000).astype(int) + 1), np.repeat([60, 61], 500)][seed]
    histogram = {int(x): int(n) for x, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
    made = packing.configurations(histogram, 128)
    used = Counter()
    for config, times in made:
        assert times > 0 and sum(x * n for x, n in config.items()) <= 128
        for x, n in config.items():
            used[x] += n * times
    assert used == histogram
    bound = max(-(-int(lengths.sum()) // 128), int((lengths > 64).sum()))
    assert sum(t for _, t in made) <= 1.06 * bound + 2


def test_the_program_is_solved_fractionally():
    need = np.zeros(1025)
    need[[700, 300, 24]] = [50_000, 50_000, 50_000]
    amount = sum(a for _, a in packing.fractional(need, 1024))
    assert abs(amount - 50_000) < 1


def test_pack_on_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_A_SLICE", 2)
    rows = [(1, "one two three", 1), (1, "one two three", 1), (2, None, 2), (3, "", 3), (None, "x " * 6000, 4), (5, "same", 5)] + [(6, "same", 5)] * 9
    frame = spark.createDataFrame(rows, "doc_id long, text string, offset int")
    got = packing.pack_documents(frame, 64, keep=["doc_id", "offset"]).collect()
    assert got[0].asDict().keys() == {"doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"}
    want = Counter((k, len(slow_ids(t))) for k, t, _ in rows)
    total = Counter()
    for r in got:
        total[r.doc_id] += r.length
    assert total == {k: sum(n * c for (x, n), c in want.items() if x == k) for k in {k for k, _, _ in rows}}
    assert check_packed(got, 64) <= -(-sum(total.values()) // 64) + 2
    assert packing.pack_documents(frame.limit(0)).count() == 0


def test_query_round_trip(spark):
    d = "/root/testdata/sf0.01"
    texts = dict(map(tuple, spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()))
    got = queries.op10_pack_configurations(spark, d).collect()
    want = {}
    for k, t in texts.items():
        ids = array("I", slow_ids(t))
        for piece, start, length, raw in packing.cut(ids, 1024):
            want[k, piece] = (start, length, zlib.crc32(raw))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    bound = -(-sum(r.length for r in got) // 1024)
    assert check_packed(got, 1024) <= 1.005 * bound + 1
