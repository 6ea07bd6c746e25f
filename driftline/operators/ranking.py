"""Exact ranks, quantiles and running totals that stay distributed.

A plain window sorts a whole group in one task, and ``percentile`` keeps all
distinct values of a group in one buffer.  Both are used only after the largest
group was counted and found to have at most ``split_rows`` rows.  Beyond that a
group is cut at *splitters* (a hash sample of its own rows, a few for each slice),
each slice is ordered on its own, and the slice totals are prefixed and joined back.
The number of slices follows the largest group, so that a slice stays near
``split_rows`` rows however many there are.  Splitters steer the balance, never the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import clip, correlation

SPLITS = 64  # slices of a large group, at least
DRAWS = 15  # sampled rows a slice
SPLIT_ROWS = 1_000_000


def _keys(by: Sequence[str]) -> list[str]:
    return list(by)


def with_stats(df: DataFrame, by: Sequence[str], **aggs: Column) -> DataFrame:
    """Attach group aggregates by joining the aggregate back.

    Unlike a window it never moves the rows of a group into one task: the
    aggregate combines map-side and adaptive execution broadcasts or splits
    the join.  ``by=[]`` attaches global aggregates as scalar subqueries.
    """
    if not by:
        for name, agg in aggs.items():
            df = df.withColumn(name, df.agg(agg.alias(name)).scalar())
        return df
    stats = df.groupBy(*by).agg(*[a.alias(n) for n, a in aggs.items()])
    return df.join(stats, list(by), "left")


def largest_group(df: DataFrame, by: Sequence[str] = ()) -> int:
    """Rows of the largest group: one counting job, combined map-side."""
    if not by:
        return df.count()
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.max("_n")).first()[0] or 0


def running_total(
    df: DataFrame,
    order: Sequence[str],
    weight: Column | None = None,
    by: Sequence[str] = (),
    out: str = "before",
    split_rows: int = SPLIT_ROWS,
    small: bool | None = None,
) -> DataFrame:
    """Add the exclusive running total of ``weight`` inside each group.

    ``order`` must be unique inside a group (end it with a key) and ascending.
    ``small`` skips the size check when the caller has made it.
    """
    weight = F.lit(1).cast("long") if weight is None else weight
    lit_key = not by
    by = _keys(by)
    largest = largest_group(df, by) if small is None or not small else 0
    if small is None:
        small = largest <= split_rows
    if small:
        before = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)
        before = before.rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.coalesce(F.sum(weight).over(before), F.lit(0).cast("long")))
    src = df.withColumn("_w", weight)
    if lit_key:
        src, by = src.withColumn("_all", F.lit(1)), ["_all"]
    hot = src.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > split_rows)
    hot = hot.select(*by)
    slices_wanted = max(SPLITS, -(-largest // split_rows))
    size, step = slices_wanted * DRAWS, DRAWS
    # a hash threshold draws the sample; a group as large as the largest gives ``size`` rows
    place = F.pmod(F.xxhash64(*order), F.lit(1 << 40)) / float(1 << 40)
    sample = src.select(*by, *order).join(hot, by, "left_semi").filter(place * largest <= size)
    cuts = sample.groupBy(*by).agg(
        F.filter(
            F.array_sort(F.collect_list(F.struct(*order))),
            lambda _x, i: F.pmod(i, F.lit(step)) == step - 1,
        ).alias("_cuts")
    )
    row = F.struct(*order)
    sliced = src.join(cuts, by, "left").withColumn(
        "_slice", F.coalesce(F.size(F.filter("_cuts", lambda c: c < row)), F.lit(0))
    )
    slices = (
        sliced.filter(F.col("_cuts").isNotNull())
        .groupBy(*by, "_slice")
        .agg(F.sum("_w").alias("_sw"))
    )
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_off", F.sum("_sw").over(earlier)).drop("_sw")
    inside = Window.partitionBy(*by, "_slice").orderBy(*order)
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    return (
        sliced.drop("_cuts")
        .withColumn("_in", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
        .join(slices, by + ["_slice"], "left")
        .withColumn(out, F.col("_in") + F.coalesce("_off", F.lit(0)))
        .drop("_in", "_off", "_slice", "_w", "_all")
    )


def sequence_number(
    df: DataFrame,
    order: Sequence[str],
    by: Sequence[str] = (),
    out: str = "seq",
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """1-based position of each row in its group (an exact ``row_number``)."""
    return running_total(df, order, None, by, out, split_rows).withColumn(out, F.col(out) + 1)


def value_positions(
    df: DataFrame, value: str, by: Sequence[str] = (), split_rows: int = SPLIT_ROWS
) -> DataFrame:
    """Distinct values with ``cnt`` (ties) and ``below`` (rows strictly smaller)."""
    rows = df.filter(F.col(value).isNotNull())
    small = largest_group(rows, by) <= split_rows
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("cnt"))
    return running_total(counts, [value], F.col("cnt"), by, "below", split_rows, small or None)


def quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    names: Sequence[str] | None = None,
    method: str = "linear",
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """Exact quantiles per group, one column each.

    ``linear`` interpolates between order statistics, ``nearest`` takes the
    element at ``round(p * (n - 1))``.
    """
    names = list(names or [f"q{i + 1}" for i in range(len(probs))])
    rows = df.select(*by, F.col(value).cast("double").alias(value)).filter(F.col(value).isNotNull())
    if method == "linear" and largest_group(rows, by) <= split_rows:
        cuts = F.percentile(value, F.array(*[F.lit(float(p)) for p in probs])).alias("_q")
        packed = rows.groupBy(*by).agg(cuts) if by else rows.agg(cuts)
        return packed.select(*by, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    pos = value_positions(rows, value, by, split_rows)
    pos = with_stats(pos, by, _n=F.sum("cnt"))

    def at(index: Column) -> Column:
        inside = (F.col("below") <= index) & (index < F.col("below") + F.col("cnt"))
        return F.max(F.when(inside, F.col(value)))

    aggs, outs = [F.max("_n").alias("_n")], []
    for name, p in zip(names, probs):
        where = F.lit(float(p)) * (F.col("_n") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        if method == "nearest":
            aggs.append(at(F.round(where).cast("long")).alias(f"_lo_{name}"))
            outs.append(lo.alias(name))
        else:
            aggs.append(at(F.floor(where)).alias(f"_lo_{name}"))
            aggs.append(at(F.ceil(where)).alias(f"_hi_{name}"))
            outs.append((lo + (hi - lo) * (where - F.floor(where))).alias(name))
    grouped = pos.groupBy(*by).agg(*aggs) if by else pos.agg(*aggs)
    return grouped.select(*by, *outs)


def with_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    names: Sequence[str],
    by: Sequence[str] = (),
    where: Column | None = None,
) -> DataFrame:
    """Attach exact quantiles of ``value`` (over the rows matching ``where``)."""
    base = df if where is None else df.filter(where)
    cuts = quantiles(base, value, probs, by, names)
    if by:
        return df.join(cuts, list(by), "left")
    packed = cuts.select(F.struct(*names)).scalar()
    df = df.withColumn("_cuts", packed)
    for n in names:
        df = df.withColumn(n, F.col("_cuts").getField(n))
    return df.drop("_cuts")


def quantile_bin(
    df: DataFrame,
    value: str,
    k: int = 5,
    by: Sequence[str] = (),
    out: str = "bin",
    where: Column | None = None,
) -> DataFrame:
    """Bin 1..k = 1 + number of cut points strictly below the value, so a value
    equal to a cut falls low and ties never straddle a boundary."""
    names = [f"_c{i}" for i in range(1, k)]
    df = with_quantiles(df, value, [i / k for i in range(1, k)], names, by, where)
    above = sum(((F.col(value) > F.col(n)).cast("int") for n in names), F.lit(1))
    return df.withColumn(out, F.when(F.col(value).isNotNull(), above)).drop(*names)


def ordinal_bin(
    df: DataFrame,
    value: str,
    key: str,
    k: int = 5,
    by: Sequence[str] = (),
    out: str = "bin",
    ties: str = "ordinal",
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """Bin 0..k-1 = floor((rank - 1) * k / n) inside the group.

    ``ordinal`` breaks ties by ``key``; ``min`` keeps tied rows together.  A row without
    a value (``min``) or group has a NULL bin.
    """
    sized = with_stats(df, by, _n=F.count(F.lit(1)))
    if ties == "ordinal":
        ranked = running_total(sized, [value, key], None, by, "_before", split_rows)
    else:
        pos = value_positions(df, value, by, split_rows)
        pos = pos.select(*by, value, F.col("below").alias("_before"))
        ranked = sized.join(pos, [*by, value], "left")  # rows without a value or group keep a NULL bin
    return ranked.withColumn(out, F.floor(F.col("_before") * k / F.col("_n")).cast("int")).drop(
        "_before", "_n"
    )


def percent_bin(
    df: DataFrame, value: str, key: str, k: int, by: Sequence[str] = (), out: str = "bin"
) -> DataFrame:
    """Bin by position: int(rank / n * k) clipped to 0..k-1, first-come ranks."""
    sized = with_stats(df, by, _n=F.count(F.lit(1)))
    ranked = running_total(sized, [value, key], None, by, "_before")
    raw = F.floor((F.col("_before") + 1) * k / F.col("_n")).cast("int")
    return ranked.withColumn(out, clip(raw, 0, k - 1)).drop("_before", "_n")


def average_rank(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """Mid-rank of each row (ties share the mean position); NULL without a value or group."""
    pos = value_positions(df, value, by)
    pos = pos.select(*by, value, (F.col("below") + (F.col("cnt") + 1) / 2).alias(out))
    return df.join(pos, [*by, value], "left")


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = (), out: str = "rho") -> DataFrame:
    """Rank correlation per group, with the number of pairs."""
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    ranked = average_rank(average_rank(pairs, x, by, "_rx"), y, by, "_ry")
    aggs = [F.count(F.lit(1)).alias("n"), correlation("_rx", "_ry").alias(out)]
    return ranked.groupBy(*by).agg(*aggs) if by else ranked.agg(*aggs)


def neighbours(
    df: DataFrame, by: Sequence[str], order: Sequence[str], fields: Sequence[str], shift: int = 1
) -> DataFrame:
    """Values of the row ``shift`` places earlier in the group (a ``lag`` that
    joins on the position, so a long group is never gathered in one task)."""
    ranked = sequence_number(df, order, by, "seq")
    prior = ranked.select(
        *by,
        (F.col("seq") + shift).alias("seq"),
        *[F.col(f).alias(f"prev_{f}") for f in fields],
    )
    return ranked.join(prior, [*by, "seq"], "left")
