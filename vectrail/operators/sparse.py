"""Exact sparse search: postings joined with the query and summed."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.vectors import sparse_literal
from .dense import PLACES, Held, for_blocks, predicate, query_values


def postings(records: DataFrame, id_col: str = "id", sparse_col: str = "sparse") -> DataFrame:
    """(dim, id, weight): the inverted form.  Written sorted or bucketed by
    ``dim`` it answers a query from few row groups."""
    return records.select(id_col, F.explode(sparse_col).alias("p")).select(F.col("p.dim").alias("dim"), id_col, F.col("p.weight").alias("weight"))


def replace_postings(index: DataFrame, records: DataFrame, id_col: str = "id", sparse_col: str = "sparse") -> DataFrame:
    """The index with the postings of ``records`` in place of their old ones."""
    kept = index.join(records.select(id_col).distinct(), id_col, "left_anti")
    return kept.select("dim", id_col, "weight").unionByName(postings(records, id_col, sparse_col))


def remove_postings(index: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    return index.join(ids.select(id_col).distinct(), id_col, "left_anti")


def search_postings(index: DataFrame, query: Mapping[int, float] | Iterable[tuple[int, float]], k: int, matching: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """(id, ``score``, ``distance``) of the k largest dot products among records
    that share a dimension; scores of 0 and below count.  ``matching``: the ids
    to choose from.  The query is a literal, so that its dimensions are pushed
    to the scan as a filter."""
    if k <= 0:
        raise ValueError("k must be positive")
    pairs = sparse_literal(query)
    weight = F.lit(None).cast("double")
    for d, w in pairs:
        weight = F.when(F.col("dim") == d, w).otherwise(weight) if len(pairs) <= 64 else weight
    hit = index.filter(F.col("dim").isin([d for d, _ in pairs]))
    if len(pairs) > 64:
        table = F.create_map(*[F.lit(x) for d, w in pairs for x in (d, w)])
        weight = F.try_element_at(table, F.col("dim"))
    if matching is not None:
        hit = hit.join(matching.select(id_col).distinct(), id_col, "left_semi")
    scores = hit.groupBy(id_col).agg(F.sum(F.col("weight").cast("double") * weight).alias("score"))
    return scores.orderBy(F.desc("score"), F.asc(id_col)).limit(k).select(id_col, "score", (-F.col("score")).alias("distance"))


def search_sparse(records: DataFrame, query, k: int, where: Mapping[str, Any] | Column | None = None, id_col: str = "id", sparse_col: str = "sparse") -> DataFrame:
    """Over records; the filter comes before the top k, so that k matching
    records are found if there are so many."""
    condition = predicate(records, where)
    return search_postings(postings(records if condition is None else records.filter(condition), id_col, sparse_col), query, k, id_col=id_col)


def batch_search(index: DataFrame, queries: DataFrame, k: int, id_col: str = "id", query_id: str = "query_id", sparse_col: str = "sparse") -> DataFrame:
    """(query_id, id, ``score``, ``rank``) for every query row, from stored
    postings: for dimensions that are rare in the index."""
    q = postings(queries, query_id, sparse_col).withColumnRenamed("weight", "__w")
    scores = index.join(q, "dim").groupBy(query_id, id_col).agg(F.sum(F.col("weight").cast("double") * F.col("__w").cast("double")).alias("score"))
    return _ranked(scores, k, id_col, query_id)


def _ranked(scores: DataFrame, k: int, id_col: str, query_id: str) -> DataFrame:
    # A sum's last bits follow the order of its terms.
    w = Window.partitionBy(query_id).orderBy(F.desc(F.round("score", PLACES)), F.asc(id_col))
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def batch_top_k(records: DataFrame, queries: DataFrame, k: int, id_col: str = "id", query_id: str = "query_id", sparse_col: str = "sparse", max_query_pairs: int = 500_000) -> DataFrame:
    """The same from the records: queries go to the scan tasks in blocks of at
    most ``max_query_pairs`` pairs, which multiply them with the batches over the
    block's dimensions and send k rows a query and task.  No pair of a record
    and a query is shuffled unless it is among them, however common a dimension.
    What a task holds follows the block and k, not the tables."""
    if k <= 0:
        raise ValueError("k must be positive")
    schema = T.StructType([T.StructField(query_id, queries.schema[query_id].dataType), T.StructField(id_col, records.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]
    asked = queries.select(query_id, *_pairs(sparse_col))
    pairs = query_values(asked)
    held = for_blocks(records.filter(F.size(sparse_col) > 0).select(id_col, *_pairs(sparse_col)), pairs, max_query_pairs)

    def scan(names: pa.Array, ends: np.ndarray, dim: np.ndarray, weight: np.ndarray) -> DataFrame:
        dims, at = np.unique(dim, return_inverse=True)
        block = records.sparkSession.sparkContext.broadcast((names, ends, dims, at.astype(np.int32), weight))  # at most max_query_pairs pairs, or one query

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, ends, dims, at, weight = block.value
            step = max(1, min(2048, 1_000_000 // max(1, len(dims))))
            some = max(1, min(256, 1_000_000 // max(1, len(dims))))
            best, edge = Held(len(names), k, kinds[1]), np.full(len(names), -np.inf)
            for b in batches:
                for first in range(0, b.num_rows, step):
                    part = b.slice(first, step)
                    ids = part.column(0).cast(kinds[1])
                    x, there = _matrix(part.column(1), part.column(2), dims)
                    for q in range(0, len(names), some):
                        bounds = ends[q : q + some + 1]
                        n, own = len(bounds) - 1, slice(bounds[0], bounds[-1])
                        row = np.repeat(np.arange(n), np.diff(bounds))
                        y, has = np.zeros((n, len(dims))), np.zeros((n, len(dims)), np.float32)
                        y[row, at[own]], has[row, at[own]] = weight[own], 1
                        score = y @ x.T
                        score[(has @ there.T == 0) | np.isnan(score)] = -np.inf
                        if score.shape[1] >= k:
                            kth = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
                            edge[q : q + n] = np.maximum(edge[q : q + n], kth)
                        low = edge[q : q + n]
                        # Ties, to the places that count and to rounding, all stay.
                        i, j = np.nonzero((score >= (low - 2 * 10.0**-PLACES - 1e-9 * np.abs(np.nan_to_num(low, neginf=0.0)))[:, None]) & (score > -np.inf))
                        if best.push(q + i, -score[i, j], ids.take(pa.array(j))):
                            full, d = best.kth()
                            edge[full] = np.maximum(edge[full], -d)
            yield from best.batches(names, schema.names, -1.0)

        return held.mapInArrow(run, schema)

    out = None
    for names, ends, dim, weight in _query_blocks(asked, kinds[0], max_query_pairs):
        part = scan(names, ends, dim, weight)
        out = part if out is None else out.unionAll(part)
    return _ranked(out, k, id_col, query_id)


def _pairs(sparse_col: str) -> list[Column]:
    """Dimensions and weights as lists."""
    return [F.transform(sparse_col, lambda p: p["dim"].cast("bigint")).alias("d"), F.transform(sparse_col, lambda p: p["weight"].cast("double")).alias("w")]


def _query_blocks(queries: DataFrame, kind: pa.DataType, most: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, where their pairs begin and end, dimensions, weights), block by block;
    one empty block if there are no queries.  A dimension keeps its first weight."""
    schema = T.StructType([T.StructField("names", T.ArrayType(queries.schema[0].dataType)), *[T.StructField(c, T.BinaryType()) for c in ("size", "d", "w")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists = [b.column(i).fill_null([]) if b.column(i).null_count else b.column(i) for i in (1, 2)]
            size = np.diff(lists[0].offsets.to_numpy())
            row = np.repeat(np.arange(len(size)), size)
            d, w = lists[0].flatten().to_numpy(zero_copy_only=False), lists[1].flatten().to_numpy(zero_copy_only=False)
            order = np.lexsort((np.arange(len(d)), d, row))
            row, d, w = row[order], d[order], w[order]
            first = np.ones(len(d), bool)
            first[1:] = (row[1:] != row[:-1]) | (d[1:] != d[:-1])
            row, d, w = row[first], d[first].astype(np.int64), w[first].astype(float)
            names, size = b.column(0).cast(kind), np.bincount(row, minlength=len(size)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), *[pa.array([v.tobytes()], pa.binary()) for v in (size, d, w)]], names=schema.names)

    names, sizes, parts = [], [np.zeros(0, np.int64)], [(np.zeros(0, np.int64), np.zeros(0))]
    for r in queries.mapInArrow(run, schema).toLocalIterator():
        d, w = np.frombuffer(r["d"], np.int64), np.frombuffer(r["w"])
        if (d < 0).any() or not np.isfinite(w).all():
            raise ValueError("sparse vector: dimensions from 0 and finite weights")
        names.extend(r["names"])
        sizes.append(np.frombuffer(r["size"], np.int64))
        parts.append((d, w))
        size = np.concatenate(sizes)
        ends = np.concatenate(([0], np.cumsum(size)))
        if ends[-1] <= most:
            continue
        d, w = (np.concatenate(x) for x in zip(*parts))
        begin = 0
        while ends[-1] - ends[begin] > most and len(names) - begin > 1:
            end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + most, "right")) - 1)
            own = slice(ends[begin], ends[end])
            yield pa.array(names[begin:end], kind), ends[begin : end + 1] - ends[begin], d[own].copy(), w[own].copy()
            begin = end
            if begin == len(names):
                break
        names, sizes, parts = names[begin:], [size[begin:]], [(d[ends[begin] :].copy(), w[ends[begin] :].copy())]
    d, w = (np.concatenate(x) for x in zip(*parts))
    yield pa.array(names, kind), np.concatenate(([0], np.cumsum(np.concatenate(sizes)))), d, w


def _matrix(dim: pa.Array, weight: pa.Array, dims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of a batch over some dimensions, and which are there."""
    row = np.repeat(np.arange(len(dim)), np.diff(dim.offsets.to_numpy()))
    d, w = dim.flatten().to_numpy(), weight.flatten().to_numpy(zero_copy_only=False)
    at = np.minimum(np.searchsorted(dims, d), max(0, len(dims) - 1))
    ok = dims[at] == d if len(dims) else np.zeros(len(d), bool)
    x, there = np.zeros((len(dim), len(dims))), np.zeros((len(dim), len(dims)), np.float32)
    x[row[ok], at[ok]], there[row[ok], at[ok]] = w[ok], 1
    return x, there
