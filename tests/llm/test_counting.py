from hypothesis import example, given, settings, strategies as st

from driftline.llm import counting, packing, queries

from .test_packing import TOKENIZER

COUNT = counting._counter(packing.vocabulary_path())
PIECES = st.lists(st.sampled_from(["a", "B", "ab", " ", "  ", "\n", "'", "'s", "re", "é", "1", "23", ".", "!?", " ", "\x1c", "　", "日", "x y z ", "_", "\t"]), max_size=40).map("".join)


def slow(text):
    return len(TOKENIZER.encode(text, add_special_tokens=False).ids)


def edited(text, edits):
    for a, b, s in reversed(edits):
        text = text[:a] + s + text[b:]
    return text


def consistent(tree):
    for t in (tree.chars, tree.tokens):
        assert all(t[i] == t[2 * i] + t[2 * i + 1] for i in range(1, tree.width))


@settings(max_examples=300, deadline=None)
@given(PIECES, st.integers(1, 9))
def test_leaves_are_counted_by_themselves(text, size):
    parts = counting.leaves(text, size)
    assert "".join(parts) == text
    tree = counting.build(text, COUNT, size)
    assert tree.tokens[1] == slow(text) and tree.chars[1] == len(text)
    consistent(tree)


@settings(max_examples=1500, deadline=None)
@given(PIECES, st.lists(st.tuples(st.integers(-2, 60), st.integers(0, 60), PIECES), max_size=4), st.integers(1, 9))
@example("a b c d", [(3, 4, "  ")], 1)
@example("", [(0, 0, "a b")], 3)
@example("a b", [(3, 3, " c")], 1)
def test_edits_keep_the_count(text, edits, size):
    tree = counting.build(text, COUNT, size)
    for part in (edits, [(a // 2, b // 3, s) for a, b, s in edits]):  # a second round on the same tree
        own = counting.normal(part, len(text))
        new, _ = counting.apply_edits(text, tree, own, COUNT)
        assert new == edited(text, own)
        assert tree.tokens[1] == slow(new) and tree.chars[1] == len(new)
        consistent(tree)
        text = new


def test_small_edits_encode_little():
    text = " ".join(f"word{i}" for i in range(20_000))
    tree = counting.build(text, COUNT)
    new, encoded = counting.apply_edits(text, tree, [(50_000, 50_004, "other")], COUNT)
    assert tree.tokens[1] == slow(new) and encoded < 1_000


def test_frames(spark):
    rows = [(1, None, 3), (2, "", 3), (3, "a few words 1234567 here", 3), (3, "a few words 1234567 here", 3), (None, "no key", 3), (4, "long " * 100_000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    counted = counting.count_tokens(docs)
    assert {r.doc_id: r.n_tokens for r in counted.collect()} == {k: slow(t or "") for k, t, _ in rows}
    edits = spark.createDataFrame(
        [(3, 2, 5, "many"), (3, 0, 0, "so "), (3, 1, 4, "lost"), (2, 0, 9, "new text"), (None, 0, 1, "x"), (4, 10, 15, None), (9, 0, 1, "y")],
        "doc_id long, start long, end long, replacement string",
    )
    got = counting.recount(counting.with_edits(counted, edits)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[3].text == "so alostw words 1234567 here" and by[3].n_edits == 2
    assert by[2].text == "new text" and by[1].text is None and by[None].text == "no key" and by[4].text == "long " * 99_999
    assert all(r.n_tokens == slow(r.text or "") and r.tree.tokens[1] == r.n_tokens for r in got)
    assert counting.count_tokens(docs.limit(0)).count() == 0


def test_query_against_a_full_count(spark):
    d = "/root/testdata/sf0.01"
    texts = dict(map(tuple, spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()))
    rows = queries.op1_edit_counts(spark, d).collect()
    assert len(rows) == len(texts) and any(r.n_edits for r in rows)
    for r in rows:
        text = texts[r.doc_id]
        edits = counting.cleaning_edits(text)
        assert (r.tokens_before, r.n_edits, r.n_tokens) == (slow(text), len(edits), slow(edited(text, edits)))
        assert r.n_encoded <= len(text) + 10 * len(edits)
