"""Stage tables: the boundary between an expensive step and its many readers."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import forget_folder, shared_folder


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back.

    Exact quantiles and regressions pass over their input several times; over a
    stage table each pass is a narrow columnar scan instead of a recomputation,
    and a lost executor costs a re-read only.
    """
    path = shared_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    # no job that reads the schema back
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the folder of a stage table that nothing reads any more; other tables stay."""
    forget_folder({f.rsplit("/", 2)[-2] for f in df.inputFiles()})


def drop_shuffles(df: DataFrame) -> None:
    """Let Spark remove the shuffle files of tables that nothing refers to any more.  It does so when
    the driver collects its garbage, which in a loop of large passes can be long after the disks are full."""
    df.sparkSession._jvm.System.gc()
