"""Hard negatives by inner product, with coordinate pruning in length buckets.

Rows are cut into buckets of similar length, longest first; a bucket holds its vectors
and, for every coordinate, its rows sorted by that coordinate of their directions.  An
anchor that looks for scores of at least ``t`` skips a bucket whose longest row cannot
reach it; else ``t`` bounds the angle between the anchor and what it looks for, and the
angle bounds every coordinate of a candidate's direction.  The feasible range of one of the
anchor's largest (focus) coordinates is read from its sorted list, the ranges of the
others cut it down, and only what is left is scored exactly.  While an anchor has
all it wants, the score of the last one is its new ``t``.

Blocks of anchors meet groups of buckets; a group's buckets pass one anchor block in one
task, and each task gives a few rows an anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.staging import stage

BUCKET_ROWS = 4_096
GROUP_BUCKETS = 8
ANCHOR_ROWS = 2_048
FOCUS = 4
SLACK = 1e-9


def usable(vector: str) -> Column:
    """Not null, and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite, F.lit(False))


class Bucket:
    """Rows of similar length: ids, labels, integer vectors, directions and sorted coordinate lists."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, order: np.ndarray):
        self.ids, self.labels, self.x, self.order = ids, labels, x, order
        self.flat = x.astype(np.float64)
        length = np.sqrt((self.flat**2).sum(1))
        self.longest = length.max(initial=0.0)
        self.unit = self.flat / np.where(length > 0, length, 1)[:, None]
        self.sorted = np.take_along_axis(self.unit, order, 0).T if len(x) else self.unit.T
        self.largest = np.abs(self.flat).max(initial=0.0)

    @staticmethod
    def orders(x: np.ndarray) -> np.ndarray:
        """Row numbers by coordinate of the direction, one column a coordinate."""
        flat = x.astype(np.float64)
        length = np.sqrt((flat**2).sum(1))
        return np.argsort(flat / np.where(length > 0, length, 1)[:, None], axis=0, kind="stable").astype(np.uint16)

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact integer inner products; doubles hold them as long as no sum can leave their integers."""
        if self.largest * float(np.abs(q).max(initial=0)) * max(len(q), 1) < 2.0**53:
            return (self.flat[rows] @ q.astype(np.float64)).astype(np.int64)
        return self.x[rows].astype(np.int64) @ q.astype(np.int64)


def candidates(bucket: Bucket, q: np.ndarray, threshold: int, focus: int = FOCUS) -> np.ndarray:
    """Rows of the bucket that may score ``threshold`` or more with ``q``: no other one does."""
    everything = np.arange(len(bucket.ids))
    q = q.astype(np.float64)
    length = np.sqrt((q**2).sum())
    if threshold <= 0:
        return everything
    if length * bucket.longest * (1 + SLACK) < threshold:
        return everything[:0]
    angle = np.arccos(min(1.0, threshold / (length * bucket.longest)))
    unit = q / length
    picked = np.argsort(-np.abs(unit), kind="stable")[:focus]
    own = np.arccos(np.clip(unit[picked], -1, 1))
    low = np.cos(np.minimum(np.pi, own + angle)) - SLACK
    high = np.cos(np.maximum(0.0, own - angle)) + SLACK
    lists = [bucket.sorted[f] for f in picked]
    starts = [np.searchsorted(v, a, "left") for v, a in zip(lists, low, strict=True)]
    stops = [np.searchsorted(v, b, "right") for v, b in zip(lists, high, strict=True)]
    first = min(range(len(picked)), key=lambda i: stops[i] - starts[i])
    found = bucket.order[starts[first] : stops[first], picked[first]].astype(np.int64)
    for i in range(len(picked)):
        if i != first and len(found) and stops[i] - starts[i] < len(everything):
            v = bucket.unit[found, picked[i]]
            found = found[(v >= low[i]) & (v <= high[i])]
    return found


def search(bucket: Bucket, q: np.ndarray, own_id: int, label: str, same: bool, wanted: list[list], k: int) -> None:
    """Merge a bucket into ``wanted``: lists ``[lowest, highest, found]`` of the ``k`` best rows of
    other ids (of the anchor's label if ``same``, else of other labels) whose score lies between
    the two; ``found`` holds ``(-score, id)`` in order; ``lowest`` rises once there are ``k``."""
    rows = candidates(bucket, q, min(w[0] for w in wanted))
    if not len(rows):
        return
    score = bucket.scores(rows, q)
    good = (score >= min(w[0] for w in wanted)) & (bucket.ids[rows] != own_id) & ((bucket.labels[rows] == label) == same)
    rows, score = rows[good], score[good]
    ids = bucket.ids[rows]
    order = np.lexsort((ids, -score))
    falling, ids = -score[order], ids[order]
    for w in wanted:
        at = np.searchsorted(falling, -w[1], "left")
        new = [(int(s), int(i)) for s, i in zip(falling[at : at + k], ids[at : at + k], strict=True) if -s >= w[0]]
        if new:
            w[2] = sorted(w[2] + new)[:k]
            if len(w[2]) == k:
                w[0] = max(w[0], -w[2][-1][0])


NOWHERE = -(2**63)  # below every score


def length_buckets(rows: DataFrame) -> DataFrame:
    """``(dim, bucket, longest, ids, labels, vectors, orders)`` from ``(id, label, _v, dim)``."""

    def cut(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held = TaskContext.get().partitionId() << 32, None
        parts = (g for frame in it for _, g in frame.groupby("dim", sort=False))
        for part in parts:
            if held is not None and held["dim"].iloc[0] != part["dim"].iloc[0]:
                yield made(held, number)
                held, number = None, number + 1
            held = part if held is None else pd.concat([held, part])
            while len(held) >= BUCKET_ROWS:
                yield made(held[:BUCKET_ROWS], number)
                held, number = held[BUCKET_ROWS:], number + 1
            held = held if len(held) else None
        if held is not None:
            yield made(held, number)

    def made(frame: pd.DataFrame, number: int) -> pd.DataFrame:
        dim = int(frame["dim"].iloc[0])
        x = np.array(frame["_v"].tolist(), np.int64).reshape(len(frame), dim)
        return pd.DataFrame({
            "dim": [dim], "bucket": [number], "longest": [float(np.sqrt((x.astype(float) ** 2).sum(1)).max())],
            "ids": [frame["id"].to_numpy("<i8").tobytes()], "labels": [frame["label"].tolist()], "vectors": [packed(x)], "orders": [Bucket.orders(x).astype("<u2").tobytes()],
        })

    length = F.aggregate("_v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    keys = ["dim", F.col("_length").desc(), "id"]
    ordered = rows.withColumn("_length", length).repartitionByRange(*keys).sortWithinPartitions(*keys).select("dim", "id", "label", "_v")
    return ordered.mapInPandas(cut, "dim int, bucket long, longest double, ids binary, labels array<string>, vectors binary, orders binary")


def packed(x: np.ndarray) -> bytes:
    """Integers in two bytes each where they fit, else in eight."""
    small = len(x) == 0 or np.abs(x).max(initial=0) < 2**15 - 1
    return (b"2" if small else b"8") + x.astype("<i2" if small else "<i8").tobytes()


def unpacked(data: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<i2" if data[:1] == b"2" else "<i8", offset=1).reshape(n, dim)


def best_of_buckets(anchors: DataFrame, buckets: DataFrame, same: bool, k: int) -> DataFrame:
    """``(anchor_id, anchor, lowest, highest, id, score)``: for every ``(lowest, highest)`` in ``bounds`` of
    ``anchors`` (``dim, id, anchor, label, _v, bounds``) the ``k`` best rows, by score and then by id."""
    blocks = lambda df, size: {r.dim: -(-r.n // size) for r in df.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    groups, parts = blocks(buckets, GROUP_BUCKETS), blocks(anchors, ANCHOR_ROWS)

    def per_dim(counts: dict[int, int]) -> Column:
        pairs = [F.lit(v) for p in counts.items() for v in p]
        return F.coalesce(F.element_at(F.create_map(*pairs), F.col("dim")), F.lit(1)) if pairs else F.lit(1)

    schema = "dim int, part long, ids binary, keys binary, labels array<string>, vectors binary, bounds array<string>"

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        dim = int(frame["dim"].iloc[0])
        return pd.DataFrame({
            "dim": [dim], "part": [frame["part"].iloc[0]], "ids": [frame["id"].to_numpy("<i8").tobytes()], "keys": [frame["anchor"].to_numpy("<i8").tobytes()],
            "labels": [frame["label"].tolist()], "vectors": [packed(np.array(frame["_v"].tolist(), np.int64).reshape(len(frame), dim))],
            "bounds": [frame["bounds"].tolist()],
        })

    spread = lambda name, counts: F.explode(F.sequence(F.lit(0).cast("long"), (per_dim(counts) - 1).cast("long"))).alias(name)
    asking = (
        anchors.withColumn("part", F.pmod("anchor", per_dim(parts).cast("long"))).groupBy("dim", "part").applyInPandas(gather, schema)
    )
    asking = asking.select("*", spread("grp", groups))
    dealt = buckets.withColumn("grp", F.pmod(F.xxhash64("bucket"), per_dim(groups).cast("long"))).select("*", spread("part", parts))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            r = left.iloc[0]
            dim, ids, keys = int(r["dim"]), np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["keys"], "<i8")
            x = unpacked(r["vectors"], len(ids), dim)
            wanted = [[[int(a), int(b), []] for a, b in (pair.split(":") for pair in text.split(","))] for text in r["bounds"]]
            limits = [[tuple(w[:2]) for w in own] for own in wanted]
            for b in right.sort_values(["longest", "bucket"], ascending=[False, True]).itertuples(index=False):
                n = len(b.ids) // 8
                bucket = Bucket(
                    np.frombuffer(b.ids, "<i8"), np.array(list(b.labels), str), unpacked(b.vectors, n, dim),
                    np.frombuffer(b.orders, "<u2").reshape(n, dim),
                )
                for i in range(len(ids)):
                    search(bucket, x[i], ids[i], r["labels"][i], same, wanted[i], k)
            out = [
                (int(ids[i]), int(keys[i]), low, high, v, -s)
                for i, own in enumerate(wanted) for (low, high), w in zip(limits[i], own, strict=True) for s, v in w[2]
            ]
        return pd.DataFrame(out, columns=["anchor_id", "anchor", "lowest", "highest", "id", "score"]).astype("int64")

    by = ["dim", "part", "grp"]
    found = asking.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInPandas(
        compare, "anchor_id long, anchor long, lowest long, highest long, id long, score long"
    )
    best = Window.partitionBy("anchor_id", "anchor", "lowest", "highest").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    A component ``x`` becomes ``floor(256 * x)``; scores are integer inner products, exact in 64
    bits.  An anchor's positives are its ``positives`` best other rows of its label; each
    gets the ``negatives`` best rows of other labels whose score is ``low`` to ``high`` percent of
    its own (none for a negative score).  Ties go to the smaller key; fewer rows than asked
    give all there are.

    Rows with a null key, label or vector, or with a null or non-finite component, take no part;
    vectors meet those of their own length only.  Exact repeats of a key, label and vector count
    once; different rows under one key are rows of their own, and none meets its own key.  Extra
    columns are not looked at, whatever their names.  No usable row gives an empty result.
    """
    rows = (
        vectors.select(
            vectors[f"`{key}`"].cast("long").alias("id"), label.cast("string").alias("label"),
            vectors[f"`{vector}`"].cast("array<double>").alias("_x"), F.coalesce(is_anchor, F.lit(False)).alias("asks"),
        )
        .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable("_x"))
        .select("id", "label", F.transform("_x", lambda x: F.floor(x * 256)).alias("_v"), "asks")
        .dropDuplicates(["id", "label", "_v"])
        .withColumn("dim", F.size("_v"))
        .withColumn("anchor", F.xxhash64("id", "label", "_v"))
    )
    rows = stage(rows, "integer-vectors")
    buckets = stage(length_buckets(rows), "length-buckets")
    anchors = rows.filter("asks").select("dim", "id", "anchor", "label", "_v")
    first = best_of_buckets(anchors.withColumn("bounds", F.lit(f"{NOWHERE}:{-NOWHERE - 1}")), buckets, True, positives)
    first = stage(first.select("anchor_id", "anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    wide = "CAST(positive_score AS DECIMAL(20, 0))"
    lowest = F.expr(f"({wide} * {low} + 99) div 100")
    highest = F.expr(f"least({wide} * {high}, {-NOWHERE - 1}BD * 100) div 100")
    limits = first.filter("positive_score >= 0").select("*", lowest.alias("lowest"), highest.alias("highest")).filter("lowest <= highest")
    bounds = limits.groupBy("anchor_id", "anchor").agg(
        F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "lowest", "highest"))), ",").alias("bounds")
    )
    looking = anchors.join(bounds.withColumnRenamed("anchor_id", "id"), ["id", "anchor"])
    found = best_of_buckets(looking.select("dim", "id", "anchor", "label", "_v", "bounds"), buckets, False, negatives)
    found = found.select("anchor_id", "anchor", "lowest", "highest", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return limits.join(found, ["anchor_id", "anchor", "lowest", "highest"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
