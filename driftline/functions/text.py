"""Tokenisers and text normalisers as native column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession, functions as F

from .scalars import col

# Analyzer patterns.
CHUNK_SEPARATORS = r'[;,.()\[\]{}"]+'
WORD_PATTERN = r"\b[a-z][a-z'-]{1,}\b"
PLAIN_PATTERN = r"\b[a-z][a-z\-]{2,}\b"
# Letters and digits outside ASCII act as word characters, as they do for a
# Unicode-aware word boundary; mapping them to a digit keeps that without Unicode flags.
FOREIGN_LETTERS = r"[\p{L}\p{N}&&[^\x00-\x7F]]"

# Drafting boilerplate that carries no information.
BOILERPLATE_WORDS = (
    "namely", "viz", "ie", "eg", "et", "al", "consisting", "comprising", "comprised", "containing", "including", "includes",
    "included", "also", "use", "used", "uses", "using", "various", "general", "certain", "providing", "provided", "provides",
    "made", "make", "makes", "form", "forms", "kind", "kinds", "sort", "sorts", "type", "types", "class", "classes", "thereof",
    "therein", "therewith", "wherein", "whereby", "such", "may", "shall", "would", "could", "should", "etc",
)


def default_stopwords(spark: SparkSession, language: str = "english") -> list[str]:
    """Spark's own list for a language plus the boilerplate words."""
    from pyspark.ml.feature import StopWordsRemover

    return sorted(set(StopWordsRemover.loadDefaultStopWords(language)) | set(BOILERPLATE_WORDS))


def ascii_words(text: str | Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), FOREIGN_LETTERS, "0")


def word_chunks(text: str | Column, stopwords: Sequence[str]) -> Column:
    """``array<array<string>>``: kept words of every punctuation-delimited chunk."""
    chunks = F.split(ascii_words(text), CHUNK_SEPARATORS)
    stop = [w for w in stopwords]
    words = lambda c: F.regexp_extract_all(c, F.lit(WORD_PATTERN), F.lit(0))
    if not stop:
        return F.transform(chunks, words)
    return F.transform(chunks, lambda c: F.filter(words(c), lambda w: ~w.isin(stop)))


def ngrams(words: Column, n: int) -> Column:
    """n-grams of one word array, joined with a blank."""
    if n == 1:
        return words
    grams = words
    for shift in range(1, n):
        tail = F.slice(words, F.lit(shift + 1), F.greatest(F.size(words) - shift, F.lit(0)))
        grams = F.zip_with(grams, tail, lambda a, b: F.concat(a, F.lit(" "), b))
        grams = F.filter(grams, lambda g: g.isNotNull())
    return grams


def chunked_terms(
    text: str | Column, stopwords: Sequence[str], ngram_range: tuple[int, int] = (1, 2)
) -> Column:
    """Terms of a document.  Stopwords go first, n-grams never cross a chunk."""
    lo, hi = ngram_range

    def of_chunk(words: Column) -> Column:
        parts = [ngrams(words, n) for n in range(lo, hi + 1)]
        return parts[0] if len(parts) == 1 else F.concat(*parts)

    return F.flatten(F.transform(word_chunks(text, stopwords), of_chunk))


def chunked_lengths(text: str | Column, stopwords: Sequence[str]) -> Column:
    """Lengths of the words and word pairs of :func:`chunked_terms`, in its order; no pair is put together."""
    pairs = lambda ns: F.zip_with(
        F.slice(ns, F.lit(1), F.greatest(F.size(ns) - 1, F.lit(0))), F.slice(ns, F.lit(2), F.size(ns)), lambda a, b: a + b + 1
    )
    lengths = F.transform(word_chunks(text, stopwords), lambda words: F.transform(words, lambda w: F.length(w)))
    return F.flatten(F.transform(lengths, lambda ns: F.concat(ns, pairs(ns))))


def plain_terms(text: str | Column, ngram_range: tuple[int, int] = (1, 2)) -> Column:
    """Second analyzer: no stopwords, n-grams run across punctuation."""
    words = F.regexp_extract_all(ascii_words(text), F.lit(PLAIN_PATTERN), F.lit(0))
    parts = [ngrams(words, n) for n in range(ngram_range[0], ngram_range[1] + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def word_set(text: str | Column, mode: str = "pattern") -> Column:
    """Distinct plain words: ``pattern`` (3+ letters by regex) or ``split``
    (blank-separated, letters only, longer than two)."""
    if mode == "pattern":
        found = F.regexp_extract_all(ascii_words(text), F.lit(r"\b[a-z]{3,}\b"), F.lit(0))
    else:
        found = F.filter(F.split(ascii_words(text), r"\s+"), lambda w: w.rlike("^[a-z]{3,}$"))
    return F.array_sort(F.array_distinct(found))


def template_key(text: str | Column) -> Column:
    """Lower case, anything but letters, digits and blanks to a blank, squeezed."""
    t = F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), "[^a-z0-9 ]", " ")
    return F.trim(F.regexp_replace(t, " +", " "))


def phrase_pattern(phrase: str) -> str:
    """Case-insensitive whole-phrase pattern with flexible white space."""
    import re

    return r"(?i)\b" + r"\s+".join(re.escape(w) for w in phrase.split()) + r"\b"


def has_phrase(text: str | Column, phrase: str) -> Column:
    return col(text).rlike("(?U)" + phrase_pattern(phrase))


def theme_flags(text: str | Column, patterns: dict[str, str]) -> list[Column]:
    """One boolean column per labelled pattern, evaluated in a single pass."""
    return [col(text).rlike(p).alias(label) for label, p in patterns.items()]
