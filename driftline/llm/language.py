"""Language identification by prediction by partial matching.

Every language has a variable-order byte context tree.  A byte's probability is
taken at the longest context in which the language has seen it; each longer
context pays its escape probability (method C, with exclusion, so a context's
distribution sums to one and code lengths are exact).  Statistics are frozen
after training, so all trees are compiled into one automaton: a state is the
longest known context, and a table gives the next state and each language's code
length for every byte.  Scoring cuts texts into segments that warm up on the
``order`` bytes before them, and steps through all segments of a batch at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .batches import append_columns, thinned

UNDETERMINED = "und"
ROOT = 0


@dataclass
class ContextModel:
    """Compiled context trees: ``step[state, symbol]`` and ``bits[state, symbol, language]``."""

    languages: list[str]
    order: int
    symbol: np.ndarray  # byte -> symbol; 0 stands for bytes never seen
    step: np.ndarray
    bits: np.ndarray


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    """Codes of all n-grams, eight bits a symbol."""
    code = np.zeros(max(0, len(data) - n + 1), np.int64)
    for i in range(n):
        code = (code << 8) | data[i : len(data) - n + 1 + i]
    return code


def train(samples: dict[str, list[bytes]], order: int = 4, min_count: int = 4) -> ContextModel | None:
    """Count contexts of up to ``order`` bytes (kept from ``min_count`` occurrences in
    some language) and compile them.  None if there is no training byte."""
    languages = sorted(k for k, v in samples.items() if any(v))
    if not languages:
        return None
    joined = {k: np.frombuffer(b"\n".join([b"", *samples[k]]), np.uint8) for k in languages}
    used = np.zeros(256, bool)
    for data in joined.values():
        used[data] = True
    symbol = np.zeros(256, np.uint8)
    symbol[used] = np.arange(1, used.sum() + 1).clip(max=255)
    size = int(symbol.max()) + 1
    texts = {k: symbol[v].astype(np.int64) for k, v in joined.items()}

    # contexts[d]: sorted codes of the contexts of d symbols; a context's prefixes
    # and suffixes occur at least as often, so they are kept as well
    contexts = [np.zeros(1, np.int64)]
    for d in range(1, order + 1):
        found = [np.unique(_grams(t, d), return_counts=True) for t in texts.values()]
        codes = np.unique(np.concatenate([c[n >= (min_count if d > 1 else 1)] for c, n in found]))
        mask = np.isin(codes >> 8, contexts[-1]) & np.isin(codes & ((1 << 8 * (d - 1)) - 1), contexts[-1])
        contexts.append(codes[mask] if d > 1 else codes)
    first = np.cumsum([0, *map(len, contexts)])
    states = int(first[-1])

    step = np.zeros((states, size), np.int32)
    suffix = [np.zeros(0, np.int64)]
    for d, codes in enumerate(contexts):
        if d:
            suffix.append(np.searchsorted(contexts[d - 1], codes & ((1 << 8 * (d - 1)) - 1)))
            step[first[d] : first[d + 1]] = step[first[d - 1] + suffix[d]]
        if d < order:
            below = contexts[d + 1]
            parent = np.searchsorted(codes, below >> 8)
            step[first[d] + parent, below & 255] = first[d + 1] + np.arange(len(below))

    bits = np.zeros((states, size, len(languages)), np.float32)
    for j, k in enumerate(languages):
        counts = []
        for d, codes in enumerate(contexts):
            table = np.zeros((len(codes), size), np.float32)
            grams, n = np.unique(_grams(texts[k], d + 1), return_counts=True)
            row = np.searchsorted(codes, grams >> 8).clip(max=max(0, len(codes) - 1))
            ok = codes[row] == grams >> 8 if len(codes) else np.zeros(len(grams), bool)
            table[row[ok], grams[ok] & 255] = n[ok]
            counts.append(table)
        for d, table in enumerate(counts):
            p = np.zeros_like(table)
            out = np.zeros(table.shape, bool)  # seen in a longer context
            escape = np.ones(len(table), np.float32)
            at = np.arange(len(table))
            for low in range(d, -1, -1):
                seen = counts[low][at]
                fresh = np.where(out, 0, seen)
                total, kinds = fresh.sum(1), (fresh > 0).sum(1)
                some = kinds > 0
                scale = np.where(some, escape / np.maximum(total + kinds, 1), 0)
                p += fresh * scale[:, None]
                escape = np.where(some, kinds * scale, escape)
                out |= seen > 0
                if low:
                    at = suffix[low][at]
            rest = np.maximum(256 - out.sum(1), 1)
            p = np.where(out, p, (escape / rest)[:, None])
            bits[first[d] : first[d + 1], :, j] = -np.log2(np.maximum(p, 1e-30))
    return ContextModel(languages, order, symbol, step, bits)


def code_lengths(model: ContextModel, texts: list[bytes], segment: int = 512, lanes: int = 4096) -> np.ndarray:
    """Bits of every text (rows) under every language (columns)."""
    k, size = len(model.languages), model.step.shape[1]
    total = np.zeros((len(texts), k))
    lengths = np.array([len(t) for t in texts], np.int64)
    data = model.symbol[np.frombuffer(b"".join(texts), np.uint8)]
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    parts = -(-lengths // segment)
    owner = np.repeat(np.arange(len(texts)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    warm = np.where(nth > 0, model.order, 0)
    begin = starts[owner] + nth * segment - warm
    length = np.minimum(segment, lengths[owner] - nth * segment) + warm
    by_length = np.argsort(-length, kind="stable")
    flat_step, flat_bits = model.step.reshape(-1), model.bits.reshape(-1, k)
    for i in range(0, len(owner), lanes):
        lane = by_length[i : i + lanes]
        n, w = length[lane], warm[lane]
        steps = int(n[0])
        at = np.minimum(begin[lane][None, :] + np.arange(steps)[:, None], len(data) - 1)
        symbols = data[at]
        live = np.searchsorted(-n, -np.arange(steps), side="left")  # lanes longer than t
        state = np.zeros(len(lane), np.int64)
        cost = np.zeros((len(lane), k), np.float32)
        for t in range(steps):
            m = live[t]
            cell = state[:m] * size + symbols[t, :m]
            if t < model.order:
                cost[:m] += flat_bits[cell] * (w[:m] <= t)[:, None]
            else:
                cost[:m] += flat_bits.take(cell, axis=0)
            state[:m] = flat_step.take(cell)
        for j in range(k):
            total[:, j] += np.bincount(owner[lane], cost[:, j], minlength=len(texts))
    return total


def training_sample(docs: DataFrame, usable: Column, per_language: int, max_chars: int) -> dict[str, list[bytes]]:
    """At most ``per_language`` labelled documents of each language, the first by a hash of
    their key, with their whole texts; they stop before ``max_chars`` characters a language.
    Texts longer than that alone come last, so one is taken only if its language has no
    other; of several texts under one key the smallest is taken.  Keys are chosen without
    their texts; the chosen ones are few by that bound, so they are broadcast to the documents."""
    rows = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), "text", F.xxhash64(F.col("doc_id").cast("string")).alias("_order")
    )
    sizes = rows.groupBy("lang", "_order").agg(F.max(F.length("text")).cast("long").alias("_size"))
    w = Window.partitionBy("lang").orderBy(F.col("_size") > max_chars, "_order")
    chosen = (
        thinned(sizes, "lang", "_order", per_language)
        .withColumn("_n", F.row_number().over(w))
        .filter(F.col("_n") <= per_language)
        .withColumn("_chars", F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .filter((F.col("_chars") <= max_chars) | (F.col("_n") == 1))
        .select("lang", "_order")
    )
    rows = rows.join(F.broadcast(chosen), ["lang", "_order"]).groupBy("lang", "_order").agg(F.min("text").alias("text"))
    samples: dict[str, list[bytes]] = {}
    for lang, text in sorted((r.lang, r.text) for r in rows.collect()):
        samples.setdefault(lang, []).append(text.encode())
    return samples


def held_out(key: str = "doc_id", folds: int = 5) -> Column:
    """Rows of the fold that training must not see; a null key is in no fold."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == 0, F.lit(False))


def identify(
    docs: DataFrame,
    per_language: int = 400,
    max_chars: int = 8_000_000,
    order: int = 4,
    keep: list[str] | None = None,
) -> DataFrame:
    """Adds ``lang_pred``, ``score`` (the posterior of ``lang_pred`` among the learned
    languages, equal priors) and ``bits_per_byte`` (its code length).

    Trained on the whole texts of a bounded sample (``per_language`` rows and ``max_chars``
    characters a language) of the rows outside the held-out fold with a key, a text and a
    ``lang``.  Whole texts are scored, very long ones in segments of a fixed size.  A null text, a text without a letter, or a corpus without training rows
    gives ``und``, score 0 and null bits.  Ties go to the smaller language name.
    Repeated rows are scored alike; columns named like the new ones are replaced.
    """
    usable = F.col("doc_id").isNotNull() & ~held_out()
    model = train(training_sample(docs, usable, per_language, max_chars), order)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        trees = shared.value

        def score(texts):
            n = len(texts)
            names, scores, rates = [UNDETERMINED] * n, [0.0] * n, [None] * n
            known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if trees else []
            for i in range(0, len(known), 2048):
                part = known[i : i + 2048]
                raw = [texts[x].encode("utf-8", "replace") for x in part]
                lengths = code_lengths(trees, raw)
                best = lengths.argmin(1)
                low = lengths[np.arange(len(part)), best]
                post = 1 / np.exp2(np.maximum(low[:, None] - lengths, -1000)).sum(1)
                for x, b, s, bits, t in zip(part, best, post, low, raw, strict=True):
                    names[x], scores[x], rates[x] = trees.languages[b], float(s), float(bits / len(t))
            return {"lang_pred": names, "score": scores, "bits_per_byte": rates}

        return score

    fields = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("bits_per_byte", T.DoubleType())]
    return append_columns(docs, ["text"], fields, make, keep)


def confident(min_score: float = 0.5, max_bits: float = 7.5) -> Column:
    """Keeps texts that some learned language explains: a letter, a clear winner and
    fewer bits a byte than noise."""
    return (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_score) & (F.col("bits_per_byte") <= max_bits)
