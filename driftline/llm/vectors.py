"""Nearest vectors by inner product over randomly rotated one-bit codes.

Every vector is centred, rotated by one random orthogonal matrix and kept as the sign
bits of its direction, packed into words, with two correction scalars: its distance to
the centre and the inner product of its direction with its own code.  A query is cut
into four bit planes; population counts of planes and codes estimate its inner product
with every vector, and the scalars give a bound on the estimate's error.  Vectors whose
upper bound reaches the best proven ones are ranked again by exact inner products.

Queries meet all rows in blocks of bounded size; each pair of blocks gives at most ``k``
rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.staging import stage

PLANES = 4
STRIP = 128  # queries compared at a time
BLOCK_ROWS = 8_192
QUERY_ROWS = 1_024


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def pack_bits(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    width = -(-bits.shape[1] // 64) * 8
    packed = np.packbits(bits, axis=1, bitorder="little")
    return np.pad(packed, ((0, 0), (0, width - packed.shape[1]))).view("<u8")


def encode(x: np.ndarray, center: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, distances to the centre, and inner products of directions with their codes."""
    r = (x - center) @ turn.T
    norm = np.linalg.norm(r, axis=1)
    unit = r / np.where(norm > 0, norm, 1)[:, None]
    aligned = np.abs(unit).sum(1) / np.sqrt(x.shape[1])
    return pack_bits(unit > 0), norm, np.where(norm > 0, aligned, 1.0)


def bounds(
    queries: np.ndarray, codes: np.ndarray, norm: np.ndarray, aligned: np.ndarray, center: np.ndarray, turn: np.ndarray, epsilon: float,
) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of all inner products and how far they may be off; the latter holds with a
    probability that ``epsilon`` sets, over the choice of the rotation."""
    dim = queries.shape[1]
    q = queries @ turn.T
    low, high = q.min(1), q.max(1)
    step = np.where(high > low, (high - low) / (2**PLANES - 1), 1.0)
    level = np.rint((q - low[:, None]) / step[:, None]).astype(np.uint8)
    rounded = low[:, None] + step[:, None] * level
    counts = np.zeros((len(q), len(codes)), np.float32)
    for j in range(PLANES):
        plane = pack_bits(level >> j & 1)
        for w in range(codes.shape[1]):
            counts += np.float32(1 << j) * np.bitwise_count(plane[:, w, None] & codes[None, :, w])
    ones = np.bitwise_count(codes).sum(1, dtype=np.int64).astype(np.float32)
    with_code = (2 * (low[:, None] * ones + step[:, None] * counts) - rounded.sum(1)[:, None]) / np.sqrt(dim)
    estimate = (queries @ center)[:, None] + norm * with_code / aligned
    length = np.linalg.norm(q, axis=1)[:, None]
    spread = np.sqrt(np.maximum(1 - aligned**2, 0)) / aligned / np.sqrt(max(dim - 1, 1))
    rounding = np.abs(q - rounded).sum(1)[:, None] / (np.sqrt(dim) * aligned)
    return estimate, norm * (epsilon * spread * length + rounding + 1e-5 * length) + 1e-9


def nearest(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, code, center, turn, k: int, epsilon: float,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query index, row index, score)``: each query's ``k`` nearest rows of other ids in one
    block, ties to the smaller id."""
    found = []
    n = min(k, len(ids))
    for i in range(0, len(queries), STRIP):
        part = queries[i : i + STRIP]
        estimate, error = bounds(part, *code, center, turn, epsilon)
        own = query_ids[i : i + STRIP, None] == ids[None, :]
        estimate[own] = -np.inf
        # the most promising rows prove a score that the k-th nearest reaches
        first = np.argpartition(-estimate, n - 1, axis=1)[:, :n]
        estimate += error
        for j, q in enumerate(part):
            picked = first[j][~own[j, first[j]]]
            proven = (rows[picked] @ q).min() if len(picked) == k else -np.inf
            chosen = np.nonzero((estimate[j] >= proven) & ~own[j])[0]
            quick = rows[chosen] @ q
            if len(chosen) > k:  # what is at least about the k-th
                chosen = chosen[quick >= np.partition(quick, len(quick) - k)[len(quick) - k] - 1e-9 * (1 + abs(proven))]
            # equal vectors have equal sums here, wherever they stand in the block
            score = (rows[chosen] * q).sum(1)
            order = np.lexsort((ids[chosen], -score))[:k]
            found.append((np.full(len(order), i + j), chosen[order], score[order]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def usable(vector: str = "_v") -> Column:
    """Neither null, empty nor zero, and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(values, dim: int) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in values]).reshape(-1, dim)


def search(
    vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", epsilon: float = 2.0, seed: int = 11,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows found for every row that
    ``is_query`` holds for, by inner product, ties to the smaller key.

    Vectors that are null, empty, zero or hold a null or non-finite component, and rows without
    a key, take no part.  Vectors are compared with those of their own length only.
    Exact repeats of a key and vector count once; a query never finds its own key.  A
    query with fewer candidates than ``k`` gets all; no usable row gives an empty result.
    """
    rows = (
        vectors.filter(F.col(key).isNotNull())
        .select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("_v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
        .filter(usable())
        .dropDuplicates(["id", "_v"])
        .withColumn("dim", F.size("_v"))
    )
    rows = stage(rows, "vectors")
    sizes = {r.dim: (r.n, r.q) for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q")).collect()}
    center_rows = rows.select("dim", F.posexplode("_v").alias("i", "x")).groupBy("dim", "i").agg(F.avg("x").alias("m")).collect()
    centers = {d: np.zeros(d) for d in sizes}
    for r in center_rows:  # one number a component
        centers[r.dim][r.i] = r.m
    shared = rows.sparkSession.sparkContext.broadcast({d: (c, rotation(d, seed)) for d, c in centers.items()})

    blocks = {d: max(1, -(-n // BLOCK_ROWS)) for d, (n, _) in sizes.items()}
    asked = {d: max(1, -(-q // QUERY_ROWS)) for d, (_, q) in sizes.items()}
    pick = lambda counts: F.coalesce(F.element_at(F.create_map(*[F.lit(v) for p in counts.items() for v in p]), F.col("dim")), F.lit(1)) if counts else F.lit(1)

    def index(frame: pd.DataFrame) -> pd.DataFrame:
        dim = int(frame["dim"].iloc[0])
        x = _matrix(frame["_v"], dim)
        codes, norm, aligned = encode(x, *shared.value[dim])
        return pd.DataFrame({
            "dim": [dim], "block": [frame["block"].iloc[0]], "ids": [frame["id"].to_numpy("<i8").tobytes()], "codes": [codes.tobytes()],
            "norm": [norm.tobytes()], "aligned": [aligned.tobytes()], "rows": [x.astype("<f8").tobytes()],
        })

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        dim = int(frame["dim"].iloc[0])
        return pd.DataFrame({
            "dim": [dim], "part": [frame["part"].iloc[0]], "query_ids": [frame["id"].to_numpy("<i8").tobytes()],
            "queries": [_matrix(frame["_v"], dim).tobytes()],
        })

    slot = lambda counts: F.pmod(F.xxhash64("id"), pick(counts).cast("long")).cast("int")
    indexed = stage(
        rows.withColumn("block", slot(blocks)).groupBy("dim", "block")
        .applyInPandas(index, "dim int, block int, ids binary, codes binary, norm binary, aligned binary, rows binary"), "vector-codes",
    )
    wanted = stage(
        rows.filter("asks").withColumn("part", slot(asked)).groupBy("dim", "part")
        .applyInPandas(gather, "dim int, part int, query_ids binary, queries binary"), "vector-queries",
    )
    pairs = wanted.withColumn("block", F.explode(F.sequence(F.lit(0), pick(blocks) - 1))).join(indexed, ["dim", "block"])

    def compare(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in it:
            for r in frame.itertuples(index=False):
                center, turn = shared.value[r.dim]
                ids, query_ids = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.query_ids, "<i8")
                x = np.frombuffer(r.rows, "<f8").reshape(len(ids), r.dim)
                q = np.frombuffer(r.queries, "<f8").reshape(len(query_ids), r.dim)
                code = (np.frombuffer(r.codes, "<u8").reshape(len(ids), -1), np.frombuffer(r.norm), np.frombuffer(r.aligned))
                a, b, score = nearest(query_ids, q, ids, x, code, center, turn, k, epsilon)
                yield pd.DataFrame({"query_id": query_ids[a], "vec_id": ids[b], "score": score})

    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        pairs.mapInPandas(compare, "query_id long, vec_id long, score double")
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
