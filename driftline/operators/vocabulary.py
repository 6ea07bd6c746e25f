"""Document terms, vocabularies and document-term matrices (in long form)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as tx


def term_counts(terms: Column) -> Column:
    """``array<struct<term, cnt>>``: the distinct terms of one array with their counts, by sorting
    it and taking the lengths of its runs."""

    def runs(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), n), lambda i: (i == 0) | (i == n) | (F.get(s, i) != F.get(s, i - 1)))
        lengths = lambda p: F.transform(
            F.slice(p, 1, F.size(p) - 1), lambda i, j: F.struct(F.get(s, i).alias("term"), (F.get(p, j + 1) - i).cast("long").alias("cnt"))
        )
        return F.transform(F.array(starts), lengths)[0]

    # each array is bound once, by a transform of one element
    return F.transform(F.array(F.sort_array(F.array_compact(terms))), runs)[0]


def document_terms(
    docs: DataFrame,
    terms: Column,
    keep: Sequence[str] = ("cls", "filed", "year"),
    key: str = "doc_id",
    unique: bool = False,
) -> DataFrame:
    """One row per (document, term) with its count.

    Terms are counted inside a row.  With ``unique`` a key stands in one row only and that is
    all: no shuffle, and no table of (document, term) in a task's memory.  Otherwise the counts of
    rows with the same key are added up.
    """
    known = docs
    for c in (key, *keep):
        known = known.filter(F.col(c).isNotNull())
    rows = known.select(key, *keep, F.inline(term_counts(terms)))
    return rows if unique else rows.groupBy(key, *keep, "term").agg(F.sum("cnt").alias("cnt"))


def by_term(doc_terms: DataFrame, slices: int | None = None) -> DataFrame:
    """The same rows dealt by term, once: whatever is grouped, windowed or joined by term (and
    class, and period) afterwards happens where the rows are and reads this one exchange, as
    long as it takes the same columns.  A term has one row a document at most, so a frequent
    term is a small part of the rows.  ``slices`` should follow the input, so that a slice is
    sorted in a task's memory however much there is: these rows are ten times what they are when they move."""
    return doc_terms.repartition(slices, "term") if slices else doc_terms.repartition("term")


def build_vocabulary(
    docs: DataFrame,
    doc_terms: DataFrame,
    min_df: int | float = 5,
    max_df: float = 0.5,
    by: Sequence[str] = ("cls",),
) -> DataFrame:
    """Terms with document and term frequency inside the frequency bounds.

    ``min_df`` is a count (int) or a fraction of the documents (float).
    """
    by = list(by)
    freq = doc_terms.groupBy(*by, "term").agg(
        # reads cnt even when only doc_freq is used: same columns, same exchange
        F.count_if(F.col("cnt") > 0).alias("doc_freq"),
        F.sum("cnt").alias("term_freq"),
    )
    if by:
        # a row a class; the vocabulary itself is never dealt by class, of which there are few
        freq = freq.join(F.broadcast(docs.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))), by)
    else:
        freq = freq.withColumn("_n", docs.agg(F.count(F.lit(1))).scalar())
    low = F.lit(min_df) if isinstance(min_df, int) else F.lit(float(min_df)) * F.col("_n")
    kept = freq.filter((F.col("doc_freq") >= low) & (F.col("doc_freq") <= F.col("_n") * max_df))
    size = F.size(F.split("term", " "))
    return kept.select(*by, "term", size.alias("ngram_size"), "doc_freq", "term_freq")


def require_text(docs: DataFrame, text: str = "body") -> DataFrame:
    """Fail early when no document has any text (stops at the first hit)."""
    if docs.filter(F.length(F.coalesce(text, F.lit(""))) > 0).isEmpty():
        raise ValueError("no document has text to tokenise")
    return docs


def sorted_vocabulary(vocab: DataFrame) -> DataFrame:
    return vocab.orderBy("ngram_size", F.desc("doc_freq"), "term")


def top_terms(vocab: DataFrame, k: int = 25, by: Sequence[str] = ()) -> DataFrame:
    """Most frequent ``k`` terms of each n-gram size."""
    w = Window.partitionBy(*by, "ngram_size").orderBy(F.desc("doc_freq"), "term")
    return vocab.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def pool_vocabularies(vocab: DataFrame, floor: int) -> DataFrame:
    """Sum document frequencies over classes and keep the common terms."""
    pooled = vocab.groupBy("term").agg(F.sum("doc_freq").alias("doc_freq"))
    return pooled.filter(F.col("doc_freq") >= floor)


def count_matrix(doc_terms: DataFrame, vocab: DataFrame, by: Sequence[str] = ("cls",)) -> DataFrame:
    return doc_terms.join(vocab.select(*by, "term"), [*by, "term"], "left_semi")


def tfidf_l2(doc_terms: DataFrame, vocab: DataFrame, docs: DataFrame) -> DataFrame:
    """TF-IDF per class: tf = 1 + ln(cnt), idf = ln((1 + n) / (1 + df)) + 1, rows of length 1."""
    n = docs.groupBy("cls").agg(F.count(F.lit(1)).alias("_n"))
    idf = vocab.join(n, "cls").select(
        "cls", "term", (F.log((1 + F.col("_n")) / (1 + F.col("doc_freq"))) + 1).alias("_idf")
    )
    raw = doc_terms.join(idf, ["cls", "term"]).withColumn(
        "_w", (1 + F.log("cnt")) * F.col("_idf")
    )
    # a document's terms are bounded by its length, so this window is safe
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy("doc_id")))
    return raw.withColumn("weight", F.col("_w") / norm).drop("_w", "_idf")


def corpus_tfidf_l2(docs: DataFrame, doc_terms: DataFrame, min_df: int = 5, max_df: float = 0.5) -> DataFrame:
    """:func:`tfidf_l2` with the vocabulary of the documents themselves, whose keys are unique.

    ``doc_terms`` is dealt by term: document frequencies are windows over the rows where they
    lie, which then move to their documents once and are joined to nothing but a row a class.
    """
    n = docs.groupBy("cls").agg(F.count(F.lit(1)).alias("_n"))
    rows = doc_terms.withColumn("_h", F.xxhash64("cls", "term"))
    rows = rows.withColumn("_df", F.count(F.lit(1)).over(Window.partitionBy("_h", "cls", "term"))).join(F.broadcast(n), "cls")
    rows = rows.filter((F.col("_df") >= min_df) & (F.col("_df") <= F.col("_n") * max_df))
    raw = rows.withColumn("_w", (1 + F.log("cnt")) * (F.log((1 + F.col("_n")) / (1 + F.col("_df"))) + 1)).drop("_h", "_df", "_n", "cnt")
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy("doc_id")))
    return raw.withColumn("weight", F.col("_w") / norm).drop("_w")


def template_counts(docs: DataFrame, text: str = "body", key: str = "doc_id", min_len: int = 5):
    """Documents per normalised text, one count per document key."""
    keyed = docs.select(key, tx.template_key(text).alias("template")).distinct()
    keyed = keyed.filter(F.length("template") >= min_len)
    return keyed.groupBy("template").agg(F.count(F.lit(1)).alias("n_copies"))


def outside_share(doc_terms: DataFrame, other: DataFrame) -> DataFrame:
    """Share of each document's term mass that a second vocabulary lacks."""
    marked = doc_terms.join(
        other.select("term", F.lit(True).alias("_known")), "term", "left"
    ).withColumn("_out", F.when(F.col("_known").isNull(), F.col("cnt")).otherwise(0))
    return marked.groupBy("doc_id").agg(
        F.sum("cnt").alias("n_tokens"),
        F.sum("_out").alias("n_outside"),
    ).withColumn("outside_share", F.col("n_outside") / F.col("n_tokens"))
