"""Texts are moved and tokenised once, however many rows a query derives from them."""

import io

import pytest
from pyspark.sql import functions as F, types as T

from driftline.functions import text as tx
from driftline.operators import audits, emergence
from driftline.plans import QUERIES, bindings as b
from driftline.sources import archive_source, files

SF = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_of_the_corpus_move_once_and_are_not_sorted(spark, no_broadcast):
    plan = plan_of(b.corpus(spark, SF))
    assert "RoundRobinPartitioning" not in plan
    assert plan.count("ShuffledHashJoin") == 1
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    assert len(joins) == 2 and all("doc_id" in j or "c_custkey" in j for j in joins)
    # both sort-merge joins are below the join with the texts
    assert plan.index("ShuffledHashJoin") < min(plan.index(j) for j in joins)


def test_pseudo_topics_are_counted_inside_a_row(spark, monkeypatch):
    monkeypatch.setattr(b, "stage", lambda df, label: df)
    assert "Generate" not in plan_of(b.theta_arrays(spark, SF))


def test_pseudo_topics_are_tokenised_once_for_their_readers(spark, monkeypatch):
    labels = []
    monkeypatch.setattr(b, "stage", lambda df, label: labels.append(label) or df)
    arrays = b.theta_arrays(spark, SF)
    b.theta(spark, SF, arrays)
    b.masked(spark, SF, arrays)
    assert labels == ["theta", "rolling"]


def test_events_take_the_attorney_of_their_own_file_in_one_pass(spark):
    assert "Join" not in plan_of(QUERIES["src_xml_events"](spark, SF))


def test_two_files_of_a_serial_keep_their_own_events(spark):
    header = T.StructType.fromDDL(files.EVENT_SCHEMA)
    event = lambda code: (code, "E", "20200102", "1")
    raw = spark.createDataFrame([("1", ("Smith",), ([event("A"), event("B")],)), ("1", (None,), ([event("C")],))], header)
    got = files.case_events(raw).select("serial", "code", "attorney_name").collect()
    assert sorted(map(tuple, got)) == [("1", "A", "Smith"), ("1", "B", "Smith"), ("1", "C", None)]


def test_elements_are_scanned_without_copying_what_follows(monkeypatch):
    text = b"<r>" + b"".join(b"<item n='%d'>%s</item>\n" % (i, b"x" * (i % 50)) for i in range(500)) + b"<item>cut"
    want = [x + "</item>" for x in text.decode().removeprefix("<r>").replace("\n", "").split("</item>")[:-1]]
    for chunk in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(archive_source, "CHUNK", chunk)
        assert list(archive_source.elements(io.BytesIO(text), "item")) == want


def test_slices_of_terms_follow_the_stored_input(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    docs = b.table(spark, SF, "documents")
    assert b.slices(docs) == cores
    assert b.slices(docs, 1 << 10) > 10 * cores
    monkeypatch.setattr(b, "slices", lambda df, part: 4 * cores)
    assert "hashpartitioning(term" in plan_of(b.doc_terms(spark, SF)) and f", {4 * cores})" in plan_of(b.doc_terms(spark, SF))


def test_recurrence_finds_first_positions_where_the_terms_lie(spark):
    docs = spark.createDataFrame(
        [(1, "o", 5, "a b"), (2, "o", 3, "b c"), (3, "p", 4, "a"), (4, None, 1, "a b"), (5, "o", 9, "a d c")],
        "doc_id long, mark string, filed int, body string",
    )
    terms = docs.select("doc_id", "mark", "filed", F.explode(F.split("body", " ")).alias("term"))
    one, two = (emergence.vocabulary_recurrence(docs, t, "mark") for t in (terms, terms.drop("mark")))
    scored = lambda df: sorted(map(tuple, df.filter("share_new is not null").collect()))
    assert scored(one) == scored(two) and len(scored(one)) == 2
    assert plan_of(one).count("Join") < plan_of(two).count("Join")


def test_lengths_of_terms_need_no_terms(spark):
    texts = ["red fox, the big dog. ox", "a", "", None, "été d'un soir the (fox) of", ";;", "one two three four"]
    df = spark.createDataFrame([(t,) for t in texts], "body string")
    of = F.transform(tx.chunked_terms("body", b.STOPWORDS), lambda t: F.length(t))
    rows = df.select(of.alias("a"), tx.chunked_lengths("body", b.STOPWORDS).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and len(rows[-1].b) == 7


def test_pseudo_topics_put_no_pairs_together(spark, monkeypatch):
    monkeypatch.setattr(b, "stage", lambda df, label: df)
    assert "lambdafunction(isnotnull" not in plan_of(b.theta_arrays(spark, SF))  # ngrams filters its pairs


def test_words_of_the_strata_are_read_from_a_stage_table(spark):
    rows = [(i / 40, i % 3 == 0, f"all some{chr(97 + i % 7)}word other{chr(97 + i % 5)}") for i in range(40)]
    docs, kept = spark.createDataFrame(rows, "lead double, good boolean, body string"), []
    got = emergence.enrichment(docs, "lead", "good", lambda df, _: kept.append(df) or df, 2)
    assert kept[0].columns == ["lead", "good", "_words"]
    plan = plan_of(got)
    # the cuts are the only subquery; sizes come with one row
    assert plan.count("Subquery scalar-subquery") <= 4 and "BroadcastNestedLoopJoin" in plan
    low = {r.word: r.p_stratum for r in got.filter("stratum = 'low'").collect()}
    assert low["someaword"] == 0.25 and "all" not in low


def test_rank_correlation_of_two_scorings_is_computed_once(spark):
    one = spark.createDataFrame([(i, (i * 7) % 11 / 3) for i in range(11)], "doc_id long, lead double")
    two = one.withColumn("lead", F.col("lead") * F.col("lead"))
    got = audits.compare_scorings(one, two)
    assert "scalar-subquery" not in plan_of(got)
    row = got.first()
    assert row.n == 11 and abs(row.spearman - 1) < 1e-12
