"""SimHash fingerprints and their exact neighbours, compared tile by tile.

Distinct fingerprints are grouped into cells by the population counts of ``blocks``
equal parts of the word, and cells are cut into tiles of bounded size.  Two words
within ``radius`` bits differ by at most ``radius`` in the sum of those counts'
differences, so only tile pairs whose counts are that close are compared, each with
one exclusive-or and bit count of numpy.  A pair of tiles reports a spanning forest of
its links, never more rows than it has words; components are found in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product
from operator import and_

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..sources.staging import stage
from .batches import append_columns, names_apart
from .components import components

WIDTH = 64


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included, as a signed
    64-bit value.  Words are runs without ASCII white space, A-Z in lower case; fewer
    words than a shingle hash as one sequence; no word gives zero."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    flat = b" ".join(tokens)
    n = max(1, len(tokens) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    first = [0, *(ends[: n - 1] + 1).tolist()]
    last = ends[min(words, len(tokens)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(WIDTH, np.int64)
    for i in range(0, n, 1 << 16):
        h = np.array([digest(flat[a:b], seed) for a, b in zip(first[i : i + (1 << 16)], last[i : i + (1 << 16)])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, keep: list[str] | None = None) -> DataFrame:
    """Adds ``fp``, the signed 64-bit fingerprint of the whole text (null or blank: 0)."""
    make = lambda: lambda texts: {"fp": [fingerprint(t, words) for t in texts]}
    return append_columns(docs, ["text"], [("fp", T.LongType())], make, keep)


def as_hex(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _near(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of ``a`` x ``b`` within ``radius`` bits, a cache-sized strip at a time."""
    a, b = a.view(np.uint64), b.view(np.uint64)  # numpy counts the bits of a signed number's magnitude
    rows = max(1, (1 << 16) // max(1, len(b)))
    for i in range(0, len(a), rows):
        x, y = np.nonzero(np.bitwise_count(a[i : i + rows, None] ^ b[None, :]) <= radius)
        x += i
        if same:
            x, y = x[x < y], y[x < y]
        if len(x):
            yield x, y


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def spanning_links(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> np.ndarray:
    """Links that connect what the close pairs of two tiles connect: every word to the
    smallest word of its group, at most one link a word."""
    words = a if same else np.concatenate([a, b])
    parent = np.arange(len(words))
    for x, y in _near(a, b, radius, same):
        y = y if same else y + len(a)
        while True:
            p, q = parent[x], parent[y]
            open_ = p != q
            if not open_.any():
                break
            x, y, p, q = x[open_], y[open_], p[open_], q[open_]
            np.minimum.at(parent, np.maximum(p, q), np.minimum(p, q))
            parent = _roots(parent)
    least = np.full(len(words), np.iinfo(np.int64).max)
    np.minimum.at(least, parent, words)
    top = least[parent]
    moved = top != words
    return np.stack([words[moved], top[moved]], axis=1)


def _cell(fp: Column, blocks: int) -> Column:
    """Population counts of the parts, as one number."""
    width = WIDTH // blocks
    part = lambda i: F.bit_count(F.shiftrightunsigned(fp, i * width).bitwiseAND(F.lit((1 << width) - 1)))
    if blocks == 1:
        return F.bit_count(fp).cast("long")
    return sum((part(i).cast("long") * (width + 1) ** i for i in range(blocks)), F.lit(0).cast("long"))


def _neighbour_cells(cell: str, blocks: int, radius: int) -> Column:
    """All cells whose counts differ by at most ``radius`` in total; each unordered pair
    of cells is named by its smaller cell."""
    width = WIDTH // blocks
    parts = [F.pmod(F.floor(F.col(cell) / F.lit((width + 1) ** i)), F.lit(width + 1)) for i in range(blocks)]
    steps = [s for s in product(range(-radius, radius + 1), repeat=blocks) if sum(map(abs, s)) <= radius]
    options = []
    for step in steps:
        jump = sum(d * (width + 1) ** i for i, d in enumerate(step))
        if jump >= 0:
            inside = [p.between(max(0, -d), min(width, width - d)) for p, d in zip(parts, step, strict=True)]
            options.append(F.when(reduce(and_, inside), F.col(cell) + F.lit(jump)))
    return F.array_compact(F.array(*options))


def links(words: DataFrame, radius: int = 3, tile: int = 4096, blocks: int | None = None) -> DataFrame:
    """Spanning links ``(a, b)`` of the distinct values ``fp``: two values are connected by
    them exactly if a chain of values, each within ``radius`` bits of the next, joins them.

    ``blocks`` (1, 2 or 4) sets how finely population counts skip tile pairs, ``tile`` the
    size of a tile; neither changes the result.  By default finer cells are taken as the
    number of words grows.
    """
    words = words.select("fp")
    n = words.count()
    blocks = blocks or (1 if n < 20_000 else 2 if n < 5_000_000 else 4)
    celled = words.withColumn("cell", _cell(F.col("fp"), blocks))
    sizes = celled.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("parts"))
    # at most 33**2 or 17**4 cells, whatever the number of words
    sizes = stage(sizes, "simhash-cells")
    tiles = (
        celled.join(sizes, "cell")
        .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts").cast("long")).cast("int"))
        .groupBy("cell", "part")
        .agg(F.collect_list("fp").alias("words"))
    )
    tiles = stage(tiles, "simhash-tiles")
    near = (
        sizes.select("cell", "parts", F.explode(_neighbour_cells("cell", blocks, radius)).alias("other"))
        .join(sizes.select(F.col("cell").alias("other"), F.col("parts").alias("other_parts")), "other")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("other_part", F.explode(F.sequence(F.lit(0), F.col("other_parts") - 1)))
        .filter("cell < other OR part <= other_part")
        .select("cell", "part", "other", "other_part")
    )
    right = tiles.select(F.col("cell").alias("other"), F.col("part").alias("other_part"), F.col("words").alias("more"))
    pairs = near.join(tiles, ["cell", "part"]).join(right, ["other", "other_part"])
    pairs = pairs.select(
        "words", "more", ((F.col("cell") == F.col("other")) & (F.col("part") == F.col("other_part"))).alias("same")
    )
    # a pair of full tiles is work for a whole core: deal the pairs out one by one
    cores = words.sparkSession.sparkContext.defaultParallelism
    pairs = pairs.repartition(max(4 * cores, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def compare(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in it:
            for a, b, same in zip(frame["words"], frame["more"], frame["same"], strict=True):
                found = spanning_links(np.asarray(a, np.int64), np.asarray(b, np.int64), radius, bool(same))
                if len(found):
                    yield pd.DataFrame(found, columns=["a", "b"])

    return pairs.mapInPandas(compare, "a long, b long")


def groups(docs: DataFrame, radius: int = 3, words: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row per row of ``docs``.

    Rows whose fingerprints are joined by a chain of steps of at most ``radius`` bits form a
    group; ``component_id`` is its smallest ``doc_id``.  Null and blank texts have
    fingerprint 0 and link like any other.  A null ``doc_id`` keeps its row and links, but
    never names a group (null if the whole group has none).  Repeated rows repeat in the
    result; an empty table gives an empty one; other columns are not looked at.
    """
    keyed = stage(fingerprints(docs.select("doc_id", "text"), words, keep=["doc_id"]), "simhash-fp")
    distinct = stage(keyed.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-words")
    found = components(links(distinct, radius), "simhash-links")
    placed = distinct.join(found, distinct.fp == found.node, "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    by_word = stage(placed.join(named, "component").select("fp", "component_id"), "simhash-groups")
    return keyed.join(by_word, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, radius: int = 3, words: int = 3) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` names their group, with all their columns.

    Rows that repeat a key are decided together, and of exact repeats one stays.  Of a group
    without any key, one row of each distinct content stays.
    """
    apart = names_apart(docs.columns, {"doc_id", "text"})
    docs = docs.select(*[docs[f"`{c}`"].alias(a) for c, a in apart.items()])
    light = groups(docs, radius, words)
    kept = (
        light.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows"))
        .select(F.col("doc_id").alias("_key"), F.col("_rows"))
    )
    rows = docs.join(kept, docs["doc_id"].eqNullSafe(kept["_key"]))
    once = rows.filter("_rows = 1 AND _key IS NOT NULL").drop("_key", "_rows")
    again = rows.filter("_rows > 1 OR _key IS NULL").drop("_key", "_rows").dropDuplicates()
    out = once.unionByName(again)
    return out.select(*[out[f"`{a}`"].alias(c) for c, a in apart.items()])
