"""Entity-year panels: lags, expansions, returns, margins.

Panels hold one row per entity and year, so windows over an entity see at most
as many rows as there are years.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import ratio


def expand_events(
    events: DataFrame, panel: DataFrame, entity: str, lo: int, hi: int, event_year: str = "event_year"
) -> DataFrame:
    """Panel rows at relative years lo..hi around each entity's event."""
    rel = events.withColumn("rel", F.explode(F.sequence(F.lit(lo), F.lit(hi))))
    rel = rel.withColumn("year", F.col(event_year) + F.col("rel"))
    return rel.join(panel, [entity, "year"])


def lagged(panel: DataFrame, entity: str, fields: Sequence[str], k: int) -> DataFrame:
    """Attach values of ``k`` years earlier by joining the shifted panel."""
    past = panel.select(
        entity, (F.col("year") + k).alias("year"), *[F.col(f).alias(f"{f}_lag{k}") for f in fields]
    )
    return panel.join(past, [entity, "year"])


def consecutive_shift(
    panel: DataFrame,
    entity: str,
    field: str,
    lags: Sequence[int] = (1,),
    leads: Sequence[int] = (1,),
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Lagged and led values, kept only where the years are that far apart."""
    w = Window.partitionBy(entity).orderBy("year")
    cols = []
    for k in lags:
        ok = F.lag("year", k).over(w) == F.col("year") - k
        cols.append((f"{field}_lag{k}", F.when(ok, F.lag(field, k).over(w))))
    for k in leads:
        ok = F.lead("year", k).over(w) == F.col("year") + k
        cols.append((f"{field}_lead{k}", F.when(ok, F.lead(field, k).over(w))))
    names = names or [n for n, _ in cols]
    return panel.select("*", *[c.alias(n) for n, (_, c) in zip(names, cols)])


def trailing_mean(panel: DataFrame, entity: str, field: str, years: int, out: str) -> DataFrame:
    w = Window.partitionBy(entity).orderBy("year").rangeBetween(-(years - 1), 0)
    return panel.withColumn(out, F.avg(field).over(w))


def chain_returns(panel: DataFrame, entity: str, ret: str, out: str) -> DataFrame:
    w = Window.partitionBy(entity).orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    return panel.withColumn(out, F.exp(F.sum(F.log1p(ret)).over(w)) - 1)


def year_end(rows: DataFrame, entity: str, price: str, order: Sequence[str]) -> DataFrame:
    """Last price of each entity-year."""
    return rows.groupBy(entity, "year").agg(F.max_by(price, F.struct(*order)).alias("price"))


def forward_returns(prices: DataFrame, entity: str, horizons: Sequence[int]) -> DataFrame:
    base = prices.select(entity, F.col("year").alias("base_year"), F.col("price").alias("_p"))
    out, cols = base, []
    for k in horizons:
        ahead = prices.select(
            entity, (F.col("year") - k).alias("base_year"), F.col("price").alias(f"_p{k}")
        )
        out = out.join(ahead, [entity, "base_year"], "left")
        cols.append((ratio(F.col(f"_p{k}"), F.col("_p")) - 1).alias(f"ret_{k}y"))
    return out.select(entity, "base_year", *cols)


def sum_if_complete(wide: DataFrame, columns: Sequence[str], out: str) -> DataFrame:
    """Row-wise sum, NULL unless every column is present."""
    total = F.col(f"`{columns[0]}`")
    for c in columns[1:]:
        total = total + F.col(f"`{c}`")
    return wide.withColumn(out, total)


def derive_margin(
    wide: DataFrame, revenue: Sequence[str], cost: Sequence[str], profit: Sequence[str]
) -> DataFrame:
    """First available revenue and cost tag, gross profit (stated or derived), margin."""
    first = lambda tags: F.coalesce(*[F.col(f"`{t}`") for t in tags])
    out = wide.withColumn("revenue", first(revenue)).withColumn("cogs", first(cost))
    derived = F.col("revenue") - F.col("cogs")
    stated = F.coalesce(first(profit), derived) if profit else derived
    out = out.withColumn("gross_profit", stated)
    out = out.withColumn("gross_margin", ratio(F.col("gross_profit"), F.col("revenue")))
    return out.filter(F.col("revenue").isNotNull())
