"""Packing token pieces into fixed sequences by a configuration linear program.

A configuration is a multiset of piece lengths that fits one sequence.  The program asks
for the fewest sequences that cover the length histogram, which has at most one entry a
token of capacity however many documents there are.  Multiplicative weights solve it:
lengths that lag behind gain weight, a knapsack dynamic program finds the best
configuration for the current weights, and it is used until one of its lengths has moved
a step on.  Amounts are rounded down, what is left is solved again, and the last few
pieces are packed by best fit.  Spark tokenises, counts, ranks the pieces of each length
and looks up their places; only the histogram and the plan pass through the driver.
"""

from __future__ import annotations

import base64
import json
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..sources.staging import stage
from .batches import append_columns, names_apart

END_OF_TEXT = 2
ROWS_A_SLICE = 2_000
MOST_SLICES = 4_096
# Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PIECES = T.ArrayType(
    T.StructType([
        T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])
)


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def added_tokens(path: str) -> dict[str, int]:
    """Added tokens of the JSON file beside a rank file; it matches them inside a text too."""
    with open(path.removesuffix(".tiktoken") + ".json", encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def encoder(path: str, added: dict[str, int] | None = None):
    """Text -> ids of a byte-level BPE; strings of ``added`` get its ids, without it special
    strings are ordinary text.  The rank file holds the vocabulary of the JSON file of the
    same name, id for id."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    ranks = {t: i for t, i in ranks.items() if t.decode("utf-8", "replace") not in (added or {})}
    made = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added or {})
    return partial(made.encode, allowed_special="all") if added else made.encode_ordinary


def cut(ids: array, capacity: int) -> list[tuple[int, int, int, bytes]]:
    """``(piece, start, length, little-endian ids)``; only a longer document is cut, and its
    first piece takes the odd rest."""
    first = len(ids) % capacity or capacity
    starts = [0, *range(first, len(ids), capacity)]
    ends = [*starts[1:], len(ids)]
    return [(i, a, b - a, ids[a:b].tobytes()) for i, (a, b) in enumerate(zip(starts, ends, strict=True))]


def pieces(docs: DataFrame, capacity: int = 1024, path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """One row per piece: the kept columns of its document, ``piece`` (from 0), ``start``,
    ``length`` and ``ids`` (unsigned 32-bit, little-endian).  A null text counts as empty,
    whose only token is the closing one."""
    path = path or vocabulary_path()

    def make():
        encode = encoder(path, added_tokens(path))

        def run(texts):
            rows = []
            for t in texts:
                ids = array("I", encode(t or ""))
                ids.append(END_OF_TEXT)
                rows.append([dict(zip(("piece", "start", "length", "ids"), p, strict=True)) for p in cut(ids, capacity)])
            return {"_pieces": rows}

        return run

    kept = [c for c in (docs.columns if keep is None else keep) if c not in {"piece", "start", "length", "ids"}]
    apart = names_apart(kept)
    rows = docs.select(*[docs[f"`{c}`"].alias(a) for c, a in apart.items()], docs["text"])
    rows = append_columns(rows, ["text"], [("_pieces", PIECES)], make, list(apart.values()))
    return rows.select(*[rows[f"`{a}`"].alias(c) for c, a in apart.items()], F.inline("_pieces"))


# ------------------------------------------------------------------ the program


def best_configuration(value: np.ndarray, capacity: int) -> tuple[Counter, float]:
    """The multiset of lengths of greatest total value that fits; ``value[l]`` of length ``l``,
    not positive if ``l`` may not be used."""
    gain = np.zeros(capacity + 1)
    take = np.zeros(capacity + 1, np.int64)
    v = value[1 : capacity + 1]
    for c in range(1, capacity + 1):
        options = v[:c] + gain[c - 1 :: -1] if c > 1 else v[:1] + gain[:1]
        best = int(options.argmax())
        if options[best] > gain[c - 1]:
            gain[c], take[c] = options[best], best + 1
        else:
            gain[c] = gain[c - 1]
    found, c = Counter(), capacity
    while c > 0:
        if take[c]:
            found[int(take[c])] += 1
            c -= int(take[c])
        else:
            c -= 1
    return found, float(gain[capacity])


def fractional(need: np.ndarray, capacity: int, step: float = 0.02, rate: float = 50.0, waste: float = 0.0005) -> list[tuple[Counter, float]]:
    """Configurations and amounts that cover ``need`` by multiplicative weights.

    A length's weight is its size times ``exp(-rate * covered share)``, so that coverage
    grows evenly and scarce fillers are not spent early.  Ends early at a configuration
    that wastes more than ``waste`` of a sequence.
    """
    lengths = np.nonzero(need)[0]
    share = np.zeros(len(need))
    plan: list[tuple[Counter, float]] = []
    while True:
        open_ = lengths[share[lengths] < 1]
        if not len(open_):
            return plan
        value = np.full(len(need), -1.0)
        value[open_] = open_ * np.exp(-rate * (share[open_] - share[open_].min()))
        config, _ = best_configuration(value, capacity)
        if plan and sum(x * n for x, n in config.items()) < (1 - waste) * capacity:
            return plan  # what is left is solved afresh, with even shares
        amount = min(need[x] * min(step, 1 - share[x] + 1e-9) / n for x, n in config.items())
        for x, n in config.items():
            share[x] += n * amount / need[x]
        plan.append((config, amount))


def best_fit(need: np.ndarray, capacity: int) -> list[tuple[Counter, int]]:
    """Largest piece first, then the piece or pair that fills the rest exactly, else the
    largest that fits."""
    left, made = need.copy(), []
    while True:
        some = np.nonzero(left)[0]
        if not len(some):
            return made
        config, space = Counter(), capacity
        while space:
            options = np.nonzero(left[: space + 1])[0]
            if not len(options):
                break
            pick = [int(options[-1])]
            if pick[0] != space and config:
                other = space - options
                pair = options[(left[other] > (other == options)) & (other > 0)]
                pick = [int(pair[-1]), int(space - pair[-1])] if len(pair) else pick
            for x in pick:
                left[x] -= 1
                config[x] += 1
                space -= x
        times = 1 + min(int(left[x]) // n for x, n in config.items())
        for x, n in config.items():
            left[x] -= n * (times - 1)
        made.append((config, times))


def configurations(histogram: dict[int, int], capacity: int, phases: int = 4) -> list[tuple[Counter, int]]:
    """Whole numbers of configurations that use every piece of the histogram exactly once."""
    left = np.zeros(capacity + 1, np.int64)
    for x, n in histogram.items():
        left[x] = n
    made = [(Counter([capacity]), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    for _ in range(phases):
        before = int(left.sum())
        # with few pieces of each length the amounts would all round to nothing
        if before < 20 * np.count_nonzero(left) or not before:
            break
        for config, amount in fractional(left.astype(float), capacity):
            times = min([int(amount + 0.5), *(int(left[x]) // n for x, n in config.items())])
            if times:
                for x, n in config.items():
                    left[x] -= times * n
                made.append((config, times))
        if left.sum() > 0.9 * before:
            break
    return made + best_fit(left, capacity)


@dataclass
class Plan:
    """Where the piece of each rank goes: sorted ``key = length << 40 | first rank`` with the
    sequence of that rank and the offset in it."""

    key: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wanted = (length.astype(np.int64) << 40) | rank
        at = np.searchsorted(self.key, wanted, side="right") - 1
        return self.sequence[at] + wanted - self.key[at], self.offset[at]


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    taken: Counter = Counter()
    rows, base = [], 0
    for config, times in configurations(histogram, capacity):
        offset = 0
        for x in sorted(config.elements(), reverse=True):
            rows.append((x << 40 | taken[x], base, offset))
            taken[x] += times
            offset += x
        base += times
    assert dict(taken) == {x: n for x, n in histogram.items() if n}
    table = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return Plan(*table.T.copy())


def pack(cut_pieces: DataFrame, capacity: int = 1024, tie: list[str] | None = None) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with ``length`` from 1 to ``capacity``.

    Every row is placed once, a sequence is filled from 0 without a gap.  ``tie`` names the
    columns that order pieces of equal length (all others by default); rows equal in all of
    them are alike, so that a recomputed task places the same rows.
    """
    columns = [c for c in cut_pieces.columns if c not in ("sequence_id", "offset")]
    apart = names_apart(columns, {"length"})
    rows = stage(cut_pieces.select(*[cut_pieces[f"`{c}`"].alias(a) for c, a in apart.items()]), "pack-pieces")
    counted = rows.groupBy(F.col("length").cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n")).collect()
    histogram = {r.length: r.n for r in counted}  # at most one entry a token of capacity
    found = rows.sparkSession.sparkContext.broadcast(plan(histogram, capacity))
    slices = min(MOST_SLICES, -(-max(histogram.values(), default=1) // ROWS_A_SLICE))

    # the rank of a row among those of its length: within its slice, plus the slices before
    tie = [f"`{apart[c]}`" for c in tie or [c for c in columns if c != "length"]]
    rows = rows.withColumn("_slice", F.pmod(F.xxhash64(*tie), F.lit(slices)).cast("int"))
    before = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    firsts = rows.groupBy("length", "_slice").agg(F.count(F.lit(1)).alias("n")).select(
        "length", "_slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first")
    )
    w = Window.partitionBy("length", "_slice").orderBy(*tie)
    ranked = rows.withColumn("_n", F.row_number().over(w) - 1).join(firsts, ["length", "_slice"])
    ranked = ranked.withColumn("_rank", (F.col("_n") + F.col("_first")).cast("long"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = found.value.place(length.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    out = ranked.withColumn("_place", place(F.col("length").cast("long"), F.col("_rank")))
    return out.select(*[out[f"`{a}`"].alias(c) for c, a in apart.items()], "_place.sequence_id", "_place.offset")


def pack_documents(docs: DataFrame, capacity: int = 1024, path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Tokenises, cuts and packs ``docs``: one row per piece with its ids, ``sequence_id`` and
    ``offset``.

    Null and empty texts are one closing token.  Repeated rows are packed each by itself, an
    empty table gives an empty result, other columns ride along and are replaced if they
    are named like a new one.
    """
    return pack(pieces(docs, capacity, path, keep), capacity)
