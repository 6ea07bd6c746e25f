"""Session settings the operators are tuned for.

A cluster normally supplies its own session; this builder is used by the tests
and the bench.  Nothing in the package changes settings of a running session.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", name: str = "driftline", **extra: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder that every executor can reach, removed when the driver ends.

    It lies under ``spark.checkpoint.dir`` when the cluster names one.  Only a local
    master, whose tasks all run on this machine, may do without: elsewhere each executor
    would write its own disk and reads would miss what the others wrote.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(remove_made)
    _made.append((spark, path))
    return path


def remove_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget_folder(names: set[str]) -> None:
    """Delete now those folders of :func:`shared_folder` whose last part is one of ``names``."""
    for made in [m for m in _made if m[1].rsplit("/", 1)[-1] in names]:
        remove_folder(*made)
        _made.remove(made)


def remove_made() -> None:
    """Delete the folders of :func:`shared_folder`; tables read from them are gone then."""
    while _made:
        spark, path = _made.pop()
        with contextlib.suppress(Exception):  # the session may have ended
            remove_folder(spark, path)
