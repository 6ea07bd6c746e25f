"""License scan: ordered signature rules over normalised words.

A text is lower-cased and cut into words.  Each rule of :mod:`license_rules` runs only on
texts that hold one of its keywords.  Where detections overlap, one that lies inside
another goes (of equal ones the rule that stands first stays), and of two that overlap
in part the one whose rule stands first stays.  Base phrases are counted beside the
rules and never suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from .batches import append_columns
from .license_rules import RULES, Rule

# Phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Bytes of words stay (A-Z as a-z, all of UTF-8 beyond ASCII), every other byte parts words.
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

Found = tuple[int, int, int]  # rule, first byte, end


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_KEEP).split()


def compiled(rules: list[Rule]) -> tuple[list[re.Pattern], dict[bytes, list[int]]]:
    """Patterns on whole words, and which rules each keyword opens."""
    gates: dict[bytes, list[int]] = {}
    for i, (_, _, keywords, _) in enumerate(rules):
        for k in keywords:
            gates.setdefault(k.encode(), []).append(i)
    return [re.compile(rf"(?<![^ ])(?:{p})(?![^ ])".encode()) for *_, p in rules], gates


@cache
def _default() -> tuple[list[re.Pattern], dict[bytes, list[int]]]:
    return compiled(RULES)


def resolve(found: list[Found]) -> list[Found]:
    """What stays of overlapping detections, by place.

    Inside another means a part of its interval; longer detections are looked at first, so
    whatever encloses a detection is known before it.
    """
    whole, reach = [], []
    for rule, a, b in sorted(found, key=lambda d: (d[1], -d[2], d[0])):
        # those that start no later and were kept: the one that reaches farthest decides
        if not whole or b > reach[-1]:
            whole.append((rule, a, b))
            reach.append(b)
    out: list[Found] = []
    taken: list[tuple[int, int]] = []
    for rule, a, b in sorted(whole, key=lambda d: (d[0], d[1])):
        at = bisect_left(taken, (a, b))
        if (at < len(taken) and taken[at][0] < b) or (at and taken[at - 1][1] > a):
            continue
        taken.insert(at, (a, b))
        out.append((rule, a, b))
    return sorted(out, key=lambda d: d[1:])


def detections(norm: bytes, rules: tuple[list[re.Pattern], dict[bytes, list[int]]]) -> list[Found]:
    patterns, gates = rules
    open_ = sorted({i for k, opened in gates.items() if k in norm for i in opened})
    return resolve([(i, m.start(), m.end()) for i in open_ for m in patterns[i].finditer(norm)])


def base_places(norm: bytes) -> list[tuple[int, str]]:
    """First byte and label of every place where a base phrase stands, in order."""
    out = []
    for phrase, label in BASE.items():
        if phrase.encode() in norm:
            out += [(m.start(), label) for m in re.finditer(rf"(?<![^ ]){phrase}(?![^ ])".encode(), norm)]
    return sorted(out)


def scan(text: str | None) -> tuple[int, list[tuple[str, int]], list[tuple[str, float, int, int]]]:
    """Words, base places as ``(label, word)``, and detections as ``(label, confidence, first word,
    last word)``, over the whole text; words count from 0."""
    words = words_of(text)
    norm = b" ".join(words)
    base, found = base_places(norm), detections(norm, _default())
    if not base and not found:
        return len(words), [], []
    spaces = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    word = lambda at: int(np.searchsorted(spaces, at, "left"))
    return (
        len(words), [(label, word(a)) for a, label in base],
        [(RULES[i][0], RULES[i][1], word(a), word(b - 1)) for i, a, b in found],
    )


_str, _long = T.StringType(), T.LongType()
BASE_TYPE = T.ArrayType(T.StructType([T.StructField("label", _str), T.StructField("word", _long)]))
FOUND_TYPE = T.ArrayType(T.StructType([
    T.StructField("label", _str), T.StructField("confidence", T.DoubleType()), T.StructField("first_word", _long), T.StructField("last_word", _long),
]))


def find_licenses(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Adds ``n_words``, ``base_places`` (``label, word``) and ``licenses`` (``label, confidence,
    first_word, last_word``).

    Null and empty texts have no words and nothing found.  Each row is scanned by itself, its
    text as a whole however long, in one narrow pass; repeated rows give repeated results.  Equal
    intervals go to the rule that stands first.  A column with the name of a new one is replaced,
    other columns stay.  No rows give no rows.
    """

    def make():
        def run(texts):
            rows = [scan(t) for t in texts]
            named = lambda names, items: [dict(zip(names, x, strict=True)) for x in items]
            return {
                "n_words": [n for n, _, _ in rows],
                "base_places": [named(("label", "word"), b) for _, b, _ in rows],
                "licenses": [named(("label", "confidence", "first_word", "last_word"), f) for _, _, f in rows],
            }

        return run

    return append_columns(docs, ["text"], [("n_words", _long), ("base_places", BASE_TYPE), ("licenses", FOUND_TYPE)], make, keep)


def digest(found: DataFrame, keep: list[str]) -> DataFrame:
    """Counts, places, labels and the highest confidence of :func:`find_licenses`, natively."""
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    words, base = F.col("base_places.word"), F.col("base_places.label")
    return found.select(
        *[found[f"`{c}`"] for c in keep], "n_words", F.size("base_places").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"), joined(base).alias("base_labels"),
        joined(F.concat(base, F.col("licenses.label"))).alias("labels"), F.coalesce(F.array_max("licenses.confidence"), F.lit(0.0)).alias("score"),
    )
