"""Streams of changes into a store, and windowed counts of a stream."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store


def ingest(changes: DataFrame, store: Store, checkpoint: str, available_now: bool = True, flush_every: int = 1) -> StreamingQuery:
    """Apply a stream of (seq, op, record columns) batch by batch: each goes to
    the store's log, and after every ``flush_every`` batches a version is
    written.  A batch that is replayed after a failure gives the same state, as
    the last entry of an id decides."""

    def apply(batch: DataFrame, epoch: int) -> None:
        store.append_log(batch)
        if (epoch + 1) % flush_every == 0:
            store.flush()

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def deduplicated(stream: DataFrame, key: str, time_col: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key; state older than ``late`` is dropped."""
    return stream.withWatermark(time_col, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time_col: str, size: str, keys: list[str], late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(window_start, keys, ``n``) of tumbling or sliding windows."""
    w = F.window(time_col, size, slide) if slide else F.window(time_col, size)
    return stream.withWatermark(time_col, late).groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *keys, "n")


def embedded(rows: DataFrame, embed: Callable[[list[str]], list], text_col: str = "text", out_col: str = "vector", kind: str = "array<float>") -> DataFrame:
    """``rows`` with the embedding function applied to batches of texts."""

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        found = embed(texts.fillna("").tolist())
        if len(found) != len(texts):
            raise ValueError("the embedding function gave a different number of rows")
        return pd.Series(list(found))

    return rows.withColumn(out_col, run(F.col(text_col)))
