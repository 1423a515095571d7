"""Late interaction: MaxSim, fixed-dimensional encodings and token pooling."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import dot_product, vector


@dataclass(frozen=True)
class EncodingConfig:
    """``partition_bits``: hyperplanes a repetition, so 2**bits buckets;
    ``projection``: dimension that tokens are projected to, or None."""

    repetitions: int = 8
    partition_bits: int = 4
    projection: int | None = 16
    seed: int = 42
    pool_factor: int | None = None
    max_tokens: int | None = None

    @classmethod
    def fast(cls) -> EncodingConfig:
        return cls(5, 3)

    @classmethod
    def compact(cls) -> EncodingConfig:
        return cls(pool_factor=2)

    @classmethod
    def quality(cls) -> EncodingConfig:
        return cls(10, 4, 32)

    def dimension(self, token_dim: int) -> int:
        return self.repetitions * 2**self.partition_bits * (self.projection or token_dim)


# -------------------------------------------------------------------- MaxSim


def tokens_literal(query: Sequence[Sequence[float]]) -> Column:
    return F.array(*[vector(t) for t in query])


def maxsim(query: Column, doc: Column) -> Column:
    """The sum over query tokens of the best dot product; 0 if a side is empty."""
    best = F.transform(query, lambda q: F.coalesce(F.array_max(F.transform(doc, lambda d: dot_product(q, d))), F.lit(0.0)))
    return F.coalesce(F.aggregate(best, F.lit(0.0), lambda s, x: s + x), F.lit(0.0))


def maxsim_explain(query: Column, doc: Column) -> Column:
    """struct<score, matches, sub_scores>: the first best document token of each
    query token, and its similarity."""
    best = F.transform(query, lambda q: F.array_max(F.transform(doc, lambda d, i: F.struct(dot_product(q, d).alias("s"), (-i).alias("i")))))
    return F.transform(
        F.array(best),
        lambda b: F.struct(
            F.aggregate(b, F.lit(0.0), lambda s, x: s + F.coalesce(x["s"], F.lit(0.0))).alias("score"),
            F.transform(b, lambda x: -x["i"]).alias("matches"), F.transform(b, lambda x: x["s"]).alias("sub_scores"),
        ),
    )[0]


def check_tokens(query: Sequence[Sequence[float]], token_dim: int | None = None) -> np.ndarray:
    if not len(query):
        raise ValueError("a multi-vector query needs a token")
    if len({len(t) for t in query}) > 1 or (token_dim is not None and len(query[0]) != token_dim):
        raise ValueError("query tokens have the wrong dimension")
    q = np.array(query, float)
    if not np.isfinite(q).all():
        raise ValueError("query holds NaN or Infinity")
    return q


def _matrices(column: pa.Array) -> list[np.ndarray]:
    """The token matrices of a list<list<float>> column; null is empty."""
    column = column.fill_null([]) if column.null_count else column
    outer = column.offsets.to_numpy() - column.offsets[0].as_py()
    inner = column.flatten()
    flat = inner.flatten().to_numpy(zero_copy_only=False).astype(float)
    edges = inner.offsets.to_numpy() - inner.offsets[0].as_py() if len(inner) else np.zeros(1, int)
    return [flat[edges[a] : edges[b]].reshape(b - a, -1) if b > a else np.zeros((0, 0)) for a, b in zip(outer, outer[1:])]


def maxsim_scores(records: DataFrame, query: Sequence[Sequence[float]], id_col: str = "id", multi_col: str = "multi") -> DataFrame:
    """(id, ``score``) of every record that has tokens: a matrix product each,
    over Arrow batches."""
    q = check_tokens(query)
    schema = T.StructType([T.StructField(id_col, records.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [float((q @ d.T).max(1).sum()) if len(d) else 0.0 for d in _matrices(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=schema.names)

    return records.filter(F.size(multi_col) > 0).select(id_col, multi_col).mapInArrow(run, schema)


def maxsim_top_k(records: DataFrame, query: Sequence[Sequence[float]], k: int, max_distance: float | None = None, explain: bool = False, id_col: str = "id", multi_col: str = "multi") -> DataFrame:
    """(id, ``score``, ``distance``[, ``explanation``]) of the k best, exactly;
    ``distance`` = -score."""
    if k <= 0:
        raise ValueError("k must be positive")
    best = maxsim_scores(records, query, id_col, multi_col).orderBy(F.desc("score"), F.asc(id_col)).limit(k).withColumn("distance", -F.col("score"))
    if max_distance is not None:
        best = best.filter(F.col("distance") <= max_distance)
    if explain:
        why = records.select(id_col, maxsim_explain(tokens_literal(query), F.col(multi_col)).alias("explanation"))
        best = why.join(F.broadcast(best), id_col).select(id_col, "score", "distance", "explanation").orderBy(F.desc("score"), F.asc(id_col))
    return best


# -------------------------------------------------- fixed-dimensional encoding


class Encoder:
    """Buckets tokens by the signs of random projections (in Gray code, so that
    neighbouring buckets differ by one sign) and adds up, for a query, or
    averages, for a document, what falls into each."""

    def __init__(self, token_dim: int, config: EncodingConfig = EncodingConfig()) -> None:
        if config.projection is not None and config.projection > token_dim:
            raise ValueError("the projection must not exceed the token dimension")
        self.config, self.token_dim = config, token_dim
        self.planes = [np.random.default_rng(config.seed + r).standard_normal((token_dim, config.partition_bits)) for r in range(config.repetitions)]
        d = config.projection
        self.down = None if d is None else np.random.default_rng(config.seed + 1_000_000).standard_normal((token_dim, d)) / math.sqrt(d)

    def encode(self, tokens: np.ndarray, query: bool) -> np.ndarray:
        return self.encode_many(tokens, np.zeros(len(tokens), int), 1, query)[0]

    def encode_many(self, tokens: np.ndarray, owner: np.ndarray, n: int, query: bool) -> np.ndarray:
        """A row for each of n records; ``owner``: the record of each token."""
        c = self.config
        width, buckets = c.projection or self.token_dim, 2**c.partition_bits
        out = np.zeros((n, c.repetitions, buckets, width))
        if len(tokens):
            x = tokens if self.down is None else tokens @ self.down
            power = 1 << np.arange(c.partition_bits - 1, -1, -1)
            for r, planes in enumerate(self.planes):
                code = ((tokens @ planes) > 0) @ power
                bucket = code ^ (code >> 1)
                # Tokens by bucket, in their own order; sums of the runs.
                at = owner * buckets + bucket
                order = np.argsort(at, kind="stable")
                start = np.flatnonzero(np.concatenate(([True], np.diff(at[order]) > 0)))
                total = np.add.reduceat(x[order], start, axis=0)
                if not query:
                    total /= np.diff(np.append(start, len(at)))[:, None]
                out[owner[order[start]], r, bucket[order[start]]] = total
        return out.reshape(n, -1)


def encode_documents(records: DataFrame, token_dim: int, config: EncodingConfig = EncodingConfig(), multi_col: str = "multi", out_col: str = "fde") -> DataFrame:
    """``records`` with their encodings, made in slices of about 1,000,000
    numbers, so that a task's memory follows neither Arrow's batches nor the
    encodings' width.  A single record is not cut."""
    encoder = Encoder(token_dim, config)
    step = max(1, 1_000_000 // config.dimension(token_dim))

    @F.arrow_udf("array<float>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            for first in range(0, len(b), step):
                tokens = _matrices(b.slice(first, step))
                owner = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
                some = [t.reshape(-1, token_dim) for t in tokens if len(t)]
                codes = encoder.encode_many(np.concatenate(some) if some else np.zeros((0, token_dim)), owner, len(tokens), False)
                ends = np.arange(len(tokens) + 1, dtype=np.int32) * np.int32(codes.shape[1])
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(codes.astype(np.float32).ravel()))

    return records.withColumn(out_col, encode(F.col(multi_col)))


def encoded_top_k(encoded: DataFrame, query: Sequence[Sequence[float]], k: int, encoder: Encoder, rerank: int | None = 20, share: float = 0.0, id_col: str = "id", multi_col: str = "multi", fde_col: str = "fde") -> DataFrame:
    """The k best by the encodings' inner product; with ``rerank``, the k * rerank
    best of these, or where that is more this ``share`` of all records, in the
    order of their MaxSim."""
    from .dense import top_k

    q = check_tokens(query, encoder.token_dim)
    if rerank is not None and rerank <= 0:
        raise ValueError("rerank must be positive")
    if not 0 <= share <= 1:
        raise ValueError("share must be from 0 to 1")
    if rerank is not None and share > 0:
        rough = encoded.filter(F.col(fde_col).isNotNull()).withColumn("__rough", dot_product(F.col(fde_col), vector(encoder.encode(q, True))))
        # A cut-off in place of a sort: the share grows with the table.
        n, cut = rough.agg(F.count("*"), F.percentile_approx("__rough", 1 - share, 100_000)).first()
        if n * share > k * rerank:
            return maxsim_top_k(rough.filter(F.col("__rough") >= cut), query, k, id_col=id_col, multi_col=multi_col)
    near = top_k(encoded, encoder.encode(q, True), k * (rerank or 1), "dot", id_col=id_col, vector_col=fde_col)
    if rerank is None:
        return near.select(id_col, (-F.col("distance")).alias("score"), "distance")
    few = encoded.join(F.broadcast(near.select(id_col)), id_col, "left_semi")
    return maxsim_top_k(few, query, k, id_col=id_col, multi_col=multi_col)


# ------------------------------------------------------------------- pooling


def cluster_tokens(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Cluster of each token: k-means from a farthest-first start at the token
    of largest norm.  Ends when nothing moves, or when after three rounds no
    fewer tokens move than before; empty clusters vanish."""
    centers = [int(np.argmax((x * x).sum(1)))]
    far = ((x - x[centers[0]]) ** 2).sum(1)
    while len(centers) < k:
        centers.append(int(np.argmax(far)))
        far = np.minimum(far, ((x - x[centers[-1]]) ** 2).sum(1))
    c, at, moved = x[centers].copy(), np.full(len(x), -1), len(x) + 1
    for step in range(rounds):
        new = ((x[:, None, :] - c[None]) ** 2).sum(2).argmin(1)
        n = int((new != at).sum())
        at = new
        if n == 0 or (step > 2 and n >= moved):
            break
        moved = n
        for j in range(k):
            if (at == j).any():
                c[j] = x[at == j].mean(0)
    return np.unique(at, return_inverse=True)[1]


def pool_matrix(x: np.ndarray, factor: int) -> np.ndarray:
    """Means of ceil(n / factor) clusters; x itself where there is nothing to
    pool."""
    n = len(x)
    k = math.ceil(n / factor) if factor else n
    if n < 2 or n <= k:
        return x
    at = cluster_tokens(x, k)
    return np.array([x[at == j].mean(0) for j in range(at.max() + 1)])


def pool_tokens(records: DataFrame, factor: int, max_tokens: int | None = None, multi_col: str = "multi") -> DataFrame:
    """``records`` with pooled tokens; an error at run time where more than
    ``max_tokens`` remain.  A null stays null."""

    @F.pandas_udf("array<array<float>>")
    def pool(tokens: pd.Series) -> pd.Series:
        def one(t):
            if t is None or not len(t):
                return t
            y = pool_matrix(np.array(list(t), float), factor)
            if max_tokens is not None and len(y) > max_tokens:
                raise ValueError(f"{len(y)} tokens, at most {max_tokens} are allowed")
            return [r.astype(np.float32) for r in y]

        return tokens.map(one)

    return records.withColumn(multi_col, pool(F.col(multi_col)))
