"""Run a function over Arrow batches while the other columns ride along."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.staging import stage


def names_apart(columns: list[str], needed: set[str] = frozenset()) -> dict[str, str]:
    """A name for each column that no operator uses within, so that columns of any name ride along;
    ``needed`` columns keep theirs."""
    return {c: c if c in needed else f"~{i}" for i, c in enumerate(columns)}


def thinned(keys: DataFrame, group: str, order: str, wanted: int) -> DataFrame:
    """The keys of each group with the smallest hashes ``order``: about four times ``wanted``,
    all of a smaller group, so that what is ranked afterwards does not grow with the table.
    The counts are written, so Spark knows their size and broadcasts them only if they are small."""
    counts = stage(keys.groupBy(group).agg(F.count(F.lit(1)).alias("_of")), "group-counts")
    place = F.pmod(F.col(order), F.lit(1 << 30)) / float(1 << 30)
    return keys.join(counts, group).filter(place * F.col("_of") <= 4 * wanted).drop("_of")


def append_columns(
    df: DataFrame,
    inputs: list[str],
    fields: list[tuple[str, T.DataType]],
    make: Callable[[], Callable[..., dict[str, list]]],
    keep: list[str] | None = None,
) -> DataFrame:
    """Add ``fields`` computed from ``inputs``, batch by batch, in one narrow pass.

    ``make`` runs once a task and gives a function from one Python list per input
    column to one sequence per new field.  ``keep`` lists the columns that stay
    (all by default); a column with the name of a new field is replaced.
    """
    new = {name for name, _ in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    source = df.select(*[df[f"`{c}`"] for c in dict.fromkeys([*kept, *inputs])])
    schema = T.StructType(
        [T.StructField(f.name, f.dataType, True) for f in (source.schema[c] for c in kept)]
        + [T.StructField(n, t, True) for n, t in fields]
    )
    kinds = [(n, to_arrow_type(t)) for n, t in fields]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in it:
            if not batch.num_rows:
                continue
            made = fn(*[batch.column(c).to_pylist() for c in inputs])
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pa.array(made[n], k) for n, k in kinds],
                names=[*kept, *(n for n, _ in kinds)],
            )

    return source.mapInArrow(run, schema)
