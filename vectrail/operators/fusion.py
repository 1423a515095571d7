"""Reciprocal rank fusion and the hybrid searches built on it."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import dense, multivector, sparse, text


def check_hybrid(k: int, alpha: float, rrf_k: int) -> None:
    if k <= 0:
        raise ValueError("k must be positive")
    if not 0 <= alpha <= 1:
        raise ValueError("alpha lies between 0 and 1")
    if rrf_k <= 0:
        raise ValueError("rrf_k must be positive")


def _ranked(df: DataFrame, order: list[Column], name: str, id_col: str) -> DataFrame:
    # At most the fetched k rows: one partition is right for so few.
    return df.withColumn(f"__{name}", F.row_number().over(Window.orderBy(*order, F.asc(id_col))) - 1)


def fuse(vectors: DataFrame, keywords: DataFrame, k: int, alpha: float = 0.5, rrf_k: int = 60, subscores: bool = False, id_col: str = "id") -> DataFrame:
    """(id, ``score``[, ``keyword_score``, ``semantic_score``]) of the k best.

    ``vectors`` has (id, distance), ``keywords`` (id, score); both are ranked
    from 0, and each list gives its weight (alpha, 1 - alpha) over rrf_k + rank +
    1.  Alpha beyond [0, 1] is cut to it.  A score of a list that lacks the id is
    null.
    """
    alpha = min(1.0, max(0.0, alpha))
    a = _ranked(vectors.select(id_col, "distance"), [F.asc("distance")], "v", id_col)
    b = _ranked(keywords.select(id_col, F.col("score").alias("__s")), [F.desc("__s")], "t", id_col)
    part = lambda c, w: F.coalesce(F.lit(w) / (F.col(c) + rrf_k + 1), F.lit(0.0))
    both = a.join(b, id_col, "full_outer").withColumn("score", part("__v", alpha) + part("__t", 1 - alpha))
    cols = [id_col, "score"]
    if subscores:
        both = both.withColumnsRenamed({"__s": "keyword_score", "distance": "semantic_score"})
        cols += ["keyword_score", "semantic_score"]
    return both.orderBy(F.desc("score"), F.asc(id_col)).limit(k).select(*cols)


def hybrid_text(
    records: DataFrame, query: Sequence[float], words: str, k: int, where: Mapping[str, Any] | Column | None = None, alpha: float = 0.5,
    rrf_k: int = 60, subscores: bool = False, metric: str = "l2", tokenizer: str = "default",
    id_col: str = "id", vector_col: str = "vector", text_col: str = "text",
) -> DataFrame:
    """Vectors and BM25, fused.  Each side gives 2k hits, 4k under a filter,
    which the text side applies to its hits."""
    check_hybrid(k, alpha, rrf_k)
    fetch = k * (2 if where is None else 4)
    near = dense.top_k(records, query, fetch, metric, where, id_col=id_col, vector_col=vector_col)
    found = text.bm25(records, words, fetch, tokenizer, id_col=id_col, text_col=text_col)
    if where is not None:
        ok = records.filter(dense.predicate(records, where)).select(id_col)
        found = ok.join(F.broadcast(found), id_col)  # at most 4k rows
    return fuse(near, found, k, alpha, rrf_k, subscores, id_col)


def hybrid_sparse(
    records: DataFrame, query: Sequence[float], terms: Mapping[int, float] | Iterable[tuple[int, float]], k: int, alpha: float = 0.5,
    where: Mapping[str, Any] | Column | None = None, metric: str = "l2", id_col: str = "id", vector_col: str = "vector", sparse_col: str = "sparse",
) -> DataFrame:
    """Vectors and sparse weights, 4k hits each, fused with rrf_k 60; alpha 0
    leaves out the vectors, alpha 1 the weights.  ``distance`` = -score."""
    check_hybrid(k, alpha, 60)
    none = lambda name: records.select(id_col, F.lit(0.0).alias(name)).filter("false")
    near = none("distance") if alpha == 0 else dense.top_k(records, query, 4 * k, metric, where, id_col=id_col, vector_col=vector_col)
    found = none("score") if alpha == 1 else sparse.search_sparse(records, terms, 4 * k, where, id_col, sparse_col)
    return fuse(near, found, k, alpha, 60, id_col=id_col).withColumn("distance", -F.col("score"))


def text_rerank(records: DataFrame, words: str, query: Sequence[Sequence[float]], k: int, candidates: int = 10_000, tokenizer: str = "default", id_col: str = "id", text_col: str = "text", multi_col: str = "multi") -> DataFrame:
    """BM25 candidates that have tokens, in the order of their MaxSim."""
    found = text.bm25(records, words, candidates, tokenizer, id_col=id_col, text_col=text_col).select(id_col)
    return multivector.maxsim_top_k(records.join(F.broadcast(found), id_col, "left_semi"), query, k, id_col=id_col, multi_col=multi_col)


def sparse_rerank(records: DataFrame, terms, query: Sequence[Sequence[float]], k: int, candidates: int = 10_000, id_col: str = "id", sparse_col: str = "sparse", multi_col: str = "multi") -> DataFrame:
    """Sparse candidates that have tokens, in the order of their MaxSim."""
    found = sparse.search_sparse(records, terms, candidates, None, id_col, sparse_col).select(id_col)
    return multivector.maxsim_top_k(records.join(F.broadcast(found), id_col, "left_semi"), query, k, id_col=id_col, multi_col=multi_col)
