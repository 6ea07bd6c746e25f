from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from driftline.llm import pages
from driftline.llm import packing, secrets

from .test_packing import check_packed, slow_ids
from .test_simhash import slow_components, slow_fingerprint

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The result of every stage, and its input before it."""
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    seen = {"documents": docs}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, DIR).write.parquet(f"{root}/{name}")
        docs = seen[name] = spark.read.parquet(f"{root}/{name}")
    return seen


def keyed(df):
    return {r.doc_id: r for r in df.collect()}


def test_every_stage_but_the_last_has_the_columns_of_documents(stages):
    names = [n for n, _ in pipeline.STAGES]
    for n in names[:-1]:
        assert stages[n].columns == stages["documents"].columns


def test_language_keeps_clean_documents(stages):
    before, after = keyed(stages["documents"]), keyed(stages["language"])
    rejected = set(before) - set(after)
    assert all(before[k] == r for k, r in after.items())
    assert len(rejected) <= 0.01 * len(before)


def test_one_document_of_each_group_stays(stages):
    rows = sorted(keyed(stages["language"]).values(), key=lambda r: r.doc_id)
    keys = [r.doc_id for r in rows]
    least = slow_components(keys, [slow_fingerprint(r.text) for r in rows], 3)
    after = keyed(stages["near_duplicates"])
    assert sorted(after) == sorted(set(least))
    assert all(r == after[r.doc_id] for r in rows if r.doc_id in after)


def test_secrets_are_gone_and_clean_texts_stay(stages):
    before, after = keyed(stages["near_duplicates"]), keyed(stages["secrets"])
    assert set(before) == set(after)
    for k, r in after.items():
        spans = secrets.scan(before[k].text)
        assert r.text == secrets.redact(before[k].text, spans) and r.n_chars == len(r.text)
        assert spans or r == before[k]
        assert not secrets.scan(r.text)


def test_the_mix_takes_whole_documents_up_to_the_budget(stages):
    before, after = keyed(stages["secrets"]), keyed(stages["mix"])
    assert all(before[k] == r for k, r in after.items()) and 0 < len(after) < len(before)
    words = lambda rs: sum(len(secrets.re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rs)
    assert words(after.values()) >= 0.7 * words(before.values())


def test_packed_pieces_hold_every_token_once(stages):
    texts = {k: r.text for k, r in keyed(stages["mix"]).items()}
    rows = stages["pack"].collect()
    ids = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        ids[r.doc_id] = ids.get(r.doc_id, b"") + bytes(r.ids)
    assert ids == {k: packing.array("I", slow_ids(t)).tobytes() for k, t in texts.items()}
    check_packed(rows, 1024)


def test_odd_rows_and_clashing_columns(spark):
    good = "the cat and the dog went to the house of the man and "
    rows = [(i, good * (2 + i % 3) + f"w{i} x{i * 7} y{i * 3} z{i}", "en", f"src{i % 20}", 1.0) for i in range(60)]
    rows += [(1, rows[1][1], "en", "src1", 1.0), (None, "a lone line of the house", None, None, 2.0), (90, None, "en", "src0", 0.0), (91, "", None, None, 0.0), (92, "12 34", "en", "src3", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double").withColumn("tokens_taken", F.lit("own"))
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DIR)
        assert docs.columns == ["doc_id", "text", "lang", "source", "score", "tokens_taken"], name
    kept = docs.collect()
    assert kept and {r.tokens_taken for r in kept} == {"own"} and not {90, 91, 92} & {r.doc_id for r in kept}
    assert max(Counter(r.doc_id for r in kept).values()) == 1
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, DIR)
    assert empty.count() == 0


# names that the operators give to columns of their own
INNER = [
    "_rows", "_key", "_host", "_html", "_blocks", "_content", "_page", "_gone", "_on", "_of", "_left", "epochs", "left", "_bucket", "_end", "_before", "_upto", "_last", "_cut", "t",
    "budget", "tokens", "epoch", "_slice", "_n", "_first", "_rank", "_place", "_pieces", "piece", "start", "length", "ids", "sequence_id", "offset", "fingerprint", "component_id",
    "lang_pred", "score", "bits_per_byte", "secrets", "domain", "n_tokens", "tokens_taken", "_own_epoch", "~epoch", "~0", "host", "n_removed", "subtree", "around", "content",
]


def test_columns_named_like_inner_ones_ride_along(spark):
    good = "the cat and the dog went to the house of the man and "
    rows = [(i, good * (2 + i % 3) + f"w{i} x{i * 7} y{i * 3} z{i}", "en", f"src{i % 20}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.select("*", *[F.lit(f"own {c}").alias(c) for c in INNER])
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DIR)
        assert docs.columns == ["doc_id", "text", "lang", "source", *INNER], name
        got = docs.select(*[F.col(f"`{c}`") for c in INNER]).distinct().collect()
        assert [tuple(r) for r in got] == [tuple(f"own {c}" for c in INNER)], name
    replaced = {"piece", "start", "length", "ids", "sequence_id", "offset"}
    packed = pipeline.packing.pack_documents(docs)
    assert packed.columns == [c for c in docs.columns if c not in replaced | {"text"} or c == "text"] + ["piece", "start", "length", "ids", "sequence_id", "offset"]
    assert {r[0] for r in packed.select("_first").distinct().collect()} == {"own _first"}
    site = spark.createDataFrame([(i, f"http://a.org/{i}", f"<nav>menu</nav><p>text number {i} of the page</p>") for i in range(6)], "page_id long, url string, html string")
    site = site.select("*", *[F.lit(f"own {c}").alias(c) for c in INNER])
    found = pages.main_text(site)
    assert found.columns == [c for c in site.columns if c not in ("host", "n_removed")] + ["host", "text", "n_removed"]
    assert found.count() == 6 and {r[0] for r in found.select("_left").distinct().collect()} == {"own _left"}
