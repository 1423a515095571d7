"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import shared_dir, written

__all__ = ["replacing", "shared_dir", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def replacing(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without its own columns of these names (any case): an operator's
    output columns take the place of an input's columns of the same name."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])
