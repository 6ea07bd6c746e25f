"""Mixing sources to target weights over a tree of groups, with native operations only.

A token budget flows from the root down the tree.  Siblings share their parent's budget
by weight, no child gets more than its subtree can give in ``max_epochs``, and what one
child cannot use goes to its siblings; because a node's capacity is that of everything
below it, a shortage leaves a subtree only when all of the subtree is used up.  Each
leaf then gives whole epochs and, of the next one, the documents that come first in a
seeded order, cut at the token where the budget ends.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.staging import stage
from .batches import names_apart

BUCKETS = 4096
BROADCAST_LEAVES = 20_000
SLICES = 64


def word_tokens(text: str = "text") -> Column:
    """Runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_key(seed: int, epoch: Column, key: str = "doc_id") -> Column:
    """The place of a document in an epoch's order; a null key counts as empty."""
    parts = [F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(key).cast("string"), F.lit(""))]
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def _weight(level: str, weights: Mapping[str, int], default: int) -> Column:
    out = F.lit(default)
    for value, weight in weights.items():
        out = F.when(F.col(level) == value, F.lit(int(weight))).otherwise(out)
    return F.coalesce(out, F.lit(default)).cast("double")


def _same(a: DataFrame, b: DataFrame, levels: Sequence[str]) -> Column:
    out = F.lit(True)
    for x in levels:
        out = out & a[x].eqNullSafe(b[f"_{x}"])
    return out


def share(nodes: DataFrame, parents: Sequence[str], level: str) -> DataFrame:
    """Budgets of siblings: by ``weight``, none above ``capacity``, the rest of a full one
    to its siblings.  ``nodes`` has ``weight, capacity, parent_budget``; whole tokens, rounded
    down.  Filled siblings are a prefix in the order of capacity by weight, so one pass of
    running sums finds them.
    """
    nodes = nodes.withColumn("_ratio", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")))
    whole = Window.partitionBy(*parents)
    order = whole.orderBy(F.col("_ratio").asc_nulls_last(), F.col(level).asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    room = F.col("parent_budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))
    nodes = nodes.withColumn(
        "_full", F.coalesce(F.col("_ratio") <= room / F.nullif(F.sum("weight").over(after), F.lit(0.0)), F.lit(False))
    )
    used = F.coalesce(F.sum(F.when(F.col("_full"), F.col("capacity"))).over(whole), F.lit(0))
    rest = F.sum(F.when(~F.col("_full"), F.col("weight")).otherwise(0.0)).over(whole)
    nodes = nodes.withColumn("_unit", (F.col("parent_budget") - used) / F.nullif(rest, F.lit(0.0)))
    part = F.least(F.col("capacity"), F.coalesce(F.floor(F.col("weight") * F.col("_unit")), F.lit(0)).cast("long"))
    return nodes.withColumn("budget", F.when(F.col("_full"), F.col("capacity")).otherwise(part)).drop("_ratio", "_full", "_unit")


def budgets(
    leaves: DataFrame, levels: Sequence[str], weights: Sequence[Mapping[str, int]], total: tuple[int, int],
    max_epochs: int, default: int = 1,
) -> DataFrame:
    """Adds ``budget`` to ``leaves(levels..., tokens)``; the root has ``total[0] / total[1]`` of all tokens."""
    leaves = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    root = Window.partitionBy()
    above = None
    for i, level in enumerate(levels):
        path = list(levels[: i + 1])
        nodes = leaves.groupBy(*path).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
        nodes = nodes.withColumn("weight", _weight(level, weights[i], default))
        if above is None:  # a row a value of the first level
            nodes = nodes.withColumn(
                "parent_budget", F.floor(F.sum("tokens").over(root) * total[0] / total[1]).cast("long")
            )
        else:
            up = above.select(*[F.col(x).alias(f"_{x}") for x in path[:-1]], F.col("budget").alias("parent_budget"))
            nodes = nodes.join(up, _same(nodes, up, path[:-1])).drop(*[f"_{x}" for x in path[:-1]])
        above = share(nodes, path[:-1], level)
    return above.select(*levels, "tokens", "budget")


def _with_leaf(rows: DataFrame, leaves: DataFrame, levels: Sequence[str], few: bool) -> DataFrame:
    """Rows joined to their leaf.  A checked small leaf table is broadcast; a larger one is
    repeated over slices, so that the rows of one leaf meet it in many tasks."""
    right = leaves.select(*[F.col(x).alias(f"_{x}") for x in levels], *[c for c in leaves.columns if c not in levels])
    drop = [f"_{x}" for x in levels]
    if few:
        return rows.join(F.broadcast(right), _same(rows, right, levels)).drop(*drop)
    rows = rows.withColumn("_slice", F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)))
    right = right.withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)))).withColumn("_at", F.col("_at").cast("long"))
    return rows.join(right, _same(rows, right, levels) & (rows["_slice"] == right["_at"])).drop("_slice", "_at", *drop)


def mix(
    docs: DataFrame,
    levels: Mapping[str, Column],
    weights: Sequence[Mapping[str, int]],
    total: tuple[int, int] = (1, 2),
    max_epochs: int = 2,
    seed: int = 7,
    tokens: Column | None = None,
) -> DataFrame:
    """The rows of ``docs`` chosen for the mix, with ``<levels>``, ``epoch`` (from 0), ``n_tokens``
    and ``tokens_taken``; a row chosen in several epochs repeats.

    ``levels`` names the tree's columns from the root down, ``weights`` gives the weights of
    their values (whole numbers, 1 for a value that is not listed, 0 to leave one out).  A null
    value is a node of its own.  The budget is ``total`` of all tokens; budgets are whole tokens
    rounded down at each node.  A leaf's last document is cut by ``tokens_taken``; rows that
    repeat a key share their place in the order and are taken together.  A null key has the
    place of an empty one.  Columns named like the new ones are replaced; an empty table
    gives an empty mix.
    """
    names = list(levels)
    made = {**levels, "n_tokens": word_tokens() if tokens is None else tokens}
    clash = {*made, "epoch", "tokens_taken"}
    kept = [c for c in docs.columns if c not in clash]
    apart = names_apart(kept, {"doc_id"})
    full = docs.select(*[docs[f"`{c}`"].alias(a) for c, a in apart.items()], *[e.alias(n) for n, e in made.items()])
    light = stage(full.select("doc_id", *names, "n_tokens"), "mix-tokens")

    leaves = light.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"))
    leaves = budgets(leaves, names, weights, total, max_epochs)
    leaves = leaves.withColumn("epochs", F.coalesce(F.floor(F.col("budget") / F.nullif("tokens", F.lit(0))), F.lit(0)).cast("int"))
    leaves = stage(leaves.withColumn("left", F.col("budget") - F.col("epochs") * F.col("tokens")), "mix-leaves")
    few = leaves.count() <= BROADCAST_LEAVES

    # where the last epoch ends: first the bucket of the order, then the document within it
    key = order_key(seed, F.col("epochs"))
    bucket = F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * BUCKETS / (1 << 32)).cast("int")
    placed = (
        _with_leaf(light, leaves.filter("left > 0"), names, few)
        .withColumn("_key", key).withColumn("_bucket", bucket)
    )
    w = Window.partitionBy(*names).orderBy("_bucket")
    per_bucket = placed.groupBy(*names, "_bucket").agg(F.sum("n_tokens").alias("t"), F.first("left").alias("left"))
    ends = (
        per_bucket.withColumn("_before", F.sum("t").over(w) - F.col("t"))
        .filter("_before < left AND left <= _before + t")
        .select(*names, F.col("_bucket").alias("_end"), "_before")
    )
    inner = Window.partitionBy(*names).orderBy("_key")
    last = (
        _with_leaf(placed.drop("left"), leaves.select(*names, "left").join(
            ends.select(*[F.col(x).alias(f"_{x}") for x in names], "_end", "_before"),
            [leaves[x].eqNullSafe(F.col(f"_{x}")) for x in names],
        ).drop(*[f"_{x}" for x in names]), names, few)
        .filter("_bucket = _end")
        .groupBy(*names, "_key").agg(F.sum("n_tokens").alias("t"), F.first("left").alias("left"), F.first("_before").alias("_before"))
        .withColumn("_upto", F.col("_before") + F.sum("t").over(inner))
        .filter("_upto - t < left AND left <= _upto")
        .select(*names, F.col("_key").alias("_last"), (F.col("left") - F.col("_upto") + F.col("t")).alias("_cut"))
    )
    cuts = leaves.select(*names, "epochs").join(
        last.select(*[F.col(x).alias(f"_{x}") for x in names], "_last", "_cut"),
        [leaves[x].eqNullSafe(F.col(f"_{x}")) for x in names], "left",
    ).drop(*[f"_{x}" for x in names])
    cuts = stage(cuts, "mix-cuts")

    rows = _with_leaf(full, cuts, names, few).withColumn("_key", key)
    in_last = F.coalesce(F.col("_key") <= F.col("_last"), F.lit(False))
    whole = F.when(F.col("epochs") > 0, F.sequence(F.lit(0), F.col("epochs") - 1)).otherwise(F.array().cast("array<int>"))
    chosen = F.concat(whole, F.when(in_last, F.array("epochs")).otherwise(F.array().cast("array<int>")))
    cut_here = (F.col("epoch") == F.col("epochs")) & (F.col("_key") == F.col("_last"))
    return (
        rows.withColumn("epoch", F.explode(chosen))
        .withColumn("tokens_taken", F.when(cut_here, F.least("n_tokens", "_cut")).otherwise(F.col("n_tokens")))
        .select(*[F.col(f"`{a}`").alias(c) for c, a in apart.items()], *names, "epoch", "n_tokens", "tokens_taken")
    )
