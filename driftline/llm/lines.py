"""Quality rules with a line labeller: counts of words, symbols and repeats, and a
linear-chain conditional random field that marks every line as content or boilerplate.

The field sees what a line looks like (length, case, symbols, repeats, punctuation) and
which label the line before has; Viterbi decoding takes the best sequence for the whole
text.  The share of words in content lines decides whether a document stays.  The field
is trained on a bounded sample of labelled documents: their labels are first spread to
lines by a per-line classifier, then the chain is fitted to the lines' sequence.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .batches import append_columns, thinned

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
FEATURES = (
    "bias", "symbols_some", "symbols_many", "symbols_most", "upper_some", "upper_most", "cries", "repeats_some", "repeats_many",
    "repeats_most", "short", "middle", "long", "ends_sentence", "starts_upper", "digits", "address", "seen_before", "edge",
)
CONTENT, BOILERPLATE = 0, 1


# ------------------------------------------------------------------ base counts


def base_counts(text: str | None) -> dict[str, int]:
    """Counts over the whole text; a word is a run without ASCII white space."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    covered = 0
    if n > 3:
        # two numbers a window, so that any vocabulary fits
        pair = at[:-2] * len(ids) + at[1:-1]
        order = np.lexsort((at[2:], pair))
        a, b = pair[order], at[2:][order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        repeated = np.zeros(n - 2, bool)
        repeated[order[1:][same]] = True
        repeated[order[:-1][same]] = True
        mark = np.zeros(n, bool)
        for i in range(3):
            mark[i : n - 2 + i] |= repeated
        covered = int(mark.sum())
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return {
        "n_words": n, "word_chars": len(text) - sum(map(text.count, WHITE)), "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": covered,
    }


# ------------------------------------------------------------------ lines and the field


def line_features(text: str) -> tuple[np.ndarray, list[int]]:
    """Binary features of every line with a word, and the lines' numbers of words."""
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    out = np.zeros((len(lines), len(FEATURES)), np.float32)
    sizes, seen = [], set()
    for row, line in zip(out, lines, strict=True):
        words = line.split() or [line]
        n = len(words)
        symbols = sum(map(line.count, SYMBOLS)) / n
        upper = sum(map(str.isupper, words)) / n
        fresh = len(set(words)) / n
        bare = line.strip()
        row[:] = (
            1, symbols > 0.1, symbols > 0.3, symbols > 0.6, upper > 0.3, upper > 0.6, line.count("!") > 0.3 * n, n > 4 and fresh < 0.7,
            n > 8 and fresh < 0.4, n > 8 and fresh < 0.2, n < 4, 4 <= n < 25, n >= 25, bare[-1:] in tuple('.!?:;…"»”'), bare[:1].isupper(),
            sum(map(line.count, "0123456789")) > 0.2 * len(line), "://" in line or "www." in line or "@" in line, line in seen, False,
        )
        seen.add(line)
        sizes.append(n)
    if len(out):
        out[[0, -1], -1] = 1
    return out, sizes


@dataclass
class LineField:
    """Emission weights of boilerplate against content, and transition weights."""

    emission: np.ndarray
    transition: np.ndarray

    def decode(self, features: np.ndarray) -> np.ndarray:
        """The best label sequence; ties go to content."""
        if not len(features):
            return np.zeros(0, np.int8)
        score = (features @ self.emission).tolist()
        (cc, cb), (bc, bb) = self.transition.tolist()
        c, b = 0.0, score[0]
        back = []
        for s in score[1:]:
            from_c, from_b = b + bc > c + cc, b + bb > c + cb
            back.append((from_c, from_b))
            c, b = (b + bc if from_c else c + cc), (b + bb if from_b else c + cb) + s
        label = int(b > c)
        labels = [label]
        for from_c, from_b in reversed(back):
            label = int(from_b if label else from_c)
            labels.append(label)
        return np.array(labels[::-1], np.int8)


def _line_weights(x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 1.0, decay: float = 1e-3) -> np.ndarray:
    """Logistic regression by plain gradient steps, both classes given the same weight."""
    w = np.zeros(x.shape[1])
    each = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        w -= rate * (x.T @ (each * (p - y)) + decay * w)
    return w


def log_likelihood(field: LineField, x: np.ndarray, y: np.ndarray, live: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Conditional log-likelihood of padded sequences, and its gradients."""
    docs, steps = y.shape
    e = np.zeros((docs, steps, 2))
    e[:, :, 1] = x @ field.emission
    t = field.transition
    forward, backward = np.zeros((docs, steps, 2)), np.zeros((docs, steps, 2))
    forward[:, 0] = e[:, 0]
    for i in range(1, steps):
        new = np.logaddexp(forward[:, i - 1, 0, None] + t[0], forward[:, i - 1, 1, None] + t[1]) + e[:, i]
        forward[:, i] = np.where(live[:, i, None], new, forward[:, i - 1])
    for i in range(steps - 2, -1, -1):
        ahead = e[:, i + 1] + backward[:, i + 1]
        new = np.logaddexp(t[:, 0] + ahead[:, 0, None], t[:, 1] + ahead[:, 1, None])
        backward[:, i] = np.where(live[:, i + 1, None], new, backward[:, i + 1])
    z = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
    p = np.exp(forward + backward - z[:, None, None])[:, :, 1] * live
    pair_live = live[:, 1:]
    joint = np.exp(
        forward[:, :-1, :, None] + t[None, None] + (e + backward)[:, 1:, None, :] - z[:, None, None, None]
    ) * pair_live[:, :, None, None]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][pair_live], y[:, 1:][pair_live]), 1)
    gold = (e[:, :, 1] * y * live).sum() + (seen * t).sum()
    return float(gold - z.sum()), np.einsum("dsf,ds->f", x, (y - p) * live), seen - joint.sum((0, 1))


def train(texts: Sequence[str], good: Sequence[bool], chain: int = 64, steps: int = 150, decay: float = 1e-3) -> LineField | None:
    """Fit the field to documents labelled as a whole; None without both labels.  All lines
    are used; a document of more than ``chain`` lines gives several sequences."""
    seqs = []
    for t, g in zip(texts, good, strict=True):
        x = line_features(t)[0]
        seqs += [(x[i : i + chain], 0 if g else 1) for i in range(0, len(x), chain)]
    if len({y for _, y in seqs}) < 2:
        return None
    flat = np.concatenate([x for x, _ in seqs]).astype(float)
    weak = np.concatenate([np.full(len(x), y) for x, y in seqs])
    first = _line_weights(flat, weak)
    # a line that looks like content stays content in a bad document, and the other way round
    suspect = flat @ first
    line_labels = np.where(weak == 1, suspect > 0, suspect > 2).astype(np.int64)
    docs, longest = len(seqs), max(len(x) for x, _ in seqs)
    x, y, live = np.zeros((docs, longest, len(FEATURES))), np.zeros((docs, longest), np.int64), np.zeros((docs, longest), bool)
    at = 0
    for i, (s, _) in enumerate(seqs):
        x[i, : len(s)], y[i, : len(s)], live[i, : len(s)] = s, line_labels[at : at + len(s)], True
        at += len(s)
    field, rate, n = LineField(first.copy(), np.zeros((2, 2))), 1.0, live.sum()
    value, grad_e, grad_t = log_likelihood(field, x, y, live)
    value -= 0.5 * decay * n * ((field.emission**2).sum() + (field.transition**2).sum())
    for _ in range(steps):
        step_e, step_t = grad_e / n - decay * field.emission, grad_t / n - decay * field.transition
        new = LineField(field.emission + rate * step_e, field.transition + rate * step_t)
        new_value, ge, gt = log_likelihood(new, x, y, live)
        new_value -= 0.5 * decay * n * ((new.emission**2).sum() + (new.transition**2).sum())
        if new_value > value:
            field, value, grad_e, grad_t, rate = new, new_value, ge, gt, rate * 1.3
        else:
            rate /= 2
    return field


# ------------------------------------------------------------------ jobs


def labelled_sample(docs: DataFrame, labels: DataFrame, per_label: int, max_chars: int) -> list[tuple[int, str, bool]]:
    """``(doc_id, text, good)`` of at most ``per_label`` labelled documents of each quality, the
    first by a hash of their key, with their whole texts; they stop before ``max_chars``
    characters a quality.

    Only labels of documents with a text count.  A document labelled both ways teaches
    nothing; of several texts under one key the smallest is taken.  The chosen keys are few by
    that bound, so they are broadcast to the documents."""
    told = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_low"), F.max("quality").alias("_high"))
        .filter("_low = _high").select("_id", F.col("_low").alias("quality"))
    )
    texts = docs.filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), "text")
    sizes = texts.groupBy("_id").agg(F.max(F.length("text")).cast("long").alias("_size"))
    w = Window.partitionBy("quality").orderBy(F.col("_size") > max_chars, "_hash", "_id")
    chosen = (
        thinned(told.join(sizes, "_id").withColumn("_hash", F.xxhash64("_id")), "quality", "_hash", per_label)
        .withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_label)
        .withColumn("_chars", F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .filter((F.col("_chars") <= max_chars) | (F.col("_n") == 1)).select("_id", "quality")
    )
    rows = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "quality").agg(F.min("text").alias("text"))
    return [(r["_id"], r.text, r.quality == 1) for r in sorted(rows.collect())]


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def assess(
    docs: DataFrame, labels: DataFrame, per_label: int = 500, max_chars: int = 4_000_000, min_words: int = 50, max_repeat_percent: int = 50,
    min_share: float = 0.5, keep: list[str] | None = None,
) -> DataFrame:
    """Adds the base counts, ``base_failed``, ``content_share`` and ``kept``.

    ``labels(doc_id, quality)`` trains the field on the whole texts of at most ``per_label``
    documents and ``max_chars`` characters of each quality; without both qualities every line
    is content.  Conflicting labels of a document are left out, repeated ones count once.
    ``content_share`` is the share of words in content lines, null without a word; a
    document stays if it passes the base rules and the share is at least ``min_share``.  Null
    and empty texts count nothing and fail; very long ones are read whole.  Repeated rows are judged alike; columns named
    like the new ones are replaced; an empty table gives an empty result.
    """
    sample = labelled_sample(docs, labels, per_label, max_chars)
    field = train([t for _, t, _ in sample], [g for *_, g in sample])
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def make():
        decode = shared.value.decode if shared.value else lambda x: np.zeros(len(x), np.int8)

        def run(texts):
            out = {n: [] for n in (*COUNTS, "base_failed", "content_share", "kept")}
            for t in texts:
                counts = base_counts(t)
                for name, value in counts.items():
                    out[name].append(value)
                failed = counts["n_words"] < min_words or 100 * counts["n_repeat_words"] > max_repeat_percent * counts["n_words"]
                features, sizes = line_features(t or "")
                content = (decode(features) == CONTENT) * np.array(sizes, np.int64)
                share = float(content.sum() / sum(sizes)) if sizes else None
                out["base_failed"].append(failed)
                out["content_share"].append(share)
                out["kept"].append(not failed and share is not None and share >= min_share)
            return out

        return run

    fields = [(n, T.LongType()) for n in COUNTS]
    fields += [("base_failed", T.BooleanType()), ("content_share", T.DoubleType()), ("kept", T.BooleanType())]
    return append_columns(docs, ["text"], fields, make, keep)
