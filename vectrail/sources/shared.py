"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  A local session that has none gets a temporary
    folder of its own; on a cluster a missing setting is an error, for a folder
    of one machine would be lost with it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vectrail-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_KEPT: ContextVar[list[str] | None] = ContextVar("kept", default=None)


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables that are written inside are deleted at the end, when
    results that read them must have been written or collected."""
    paths: list[str] = []
    token = _KEPT.set(paths)
    try:
        yield
    finally:
        _KEPT.reset(token)
        for path in paths:
            drop_table(spark, path)


def drop_table(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` there and read it back: lineage ends here, and a lost
    executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if (kept := _KEPT.get()) is not None:
        kept.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
