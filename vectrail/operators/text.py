"""BM25 search as a relational plan."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokenizers import query_terms, tokens
from ..sources.shared import written
from .dense import predicate


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.2
    b: float = 0.75


def bm25(
    docs: DataFrame, query: str, k: int, tokenizer: str = "default", where: Mapping[str, Any] | Column | None = None,
    id_col: str = "id", text_col: str = "text", params: Bm25 = Bm25(),
) -> DataFrame:
    """(id, ``score``) of the k best documents that hold every query term, best
    first, ties by id.  Frequencies count over all documents; the filter only
    chooses among hits.  A blank query or k of 0 finds nothing.

    Two scans, of the figures and of the hits: each cuts the texts and only
    counts of the query's terms leave the projection, so nothing is exploded; the
    corpus figures are one partial aggregate.  For many queries, ``index_terms``.
    """
    terms = query_terms(query, tokenizer)
    if not terms or k <= 0:
        return docs.select(id_col, F.lit(0.0).alias("score")).filter("false")
    condition = predicate(docs, where)

    def frequency(t: Column, term: str) -> Column:
        return F.size(F.filter(t, lambda x: x == term))

    words = F.transform(F.array(tokens(F.col(text_col), tokenizer)), lambda t: F.struct(F.size(t).alias("n"), *[frequency(t, x).alias(f"t{i}") for i, x in enumerate(terms)]))
    base = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col), (F.lit(True) if condition is None else condition).alias("__ok"), F.explode(words).alias("w"))
    figures = base.agg(F.count("*").alias("n"), F.avg("w.n").alias("avg"), *[F.count_if(F.col(f"w.t{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    hits = base.filter("__ok")
    for i in range(len(terms)):
        hits = hits.filter(F.col(f"w.t{i}") > 0)
    score = F.lit(0.0)
    for i in range(len(terms)):
        df, tf = F.col(f"df{i}"), F.col(f"w.t{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (params.k1 + 1) / (tf + params.k1 * (1 - params.b + params.b * F.col("w.n") / F.col("avg")))
    # One row of corpus figures.
    return hits.crossJoin(F.broadcast(figures)).select(id_col, score.alias("score")).orderBy(F.desc("score"), F.asc(id_col)).limit(k)


def index_terms(docs: DataFrame, tokenizer: str = "default", id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(term, id, tf, doc_len): a stored index for many queries."""
    t = docs.filter(F.col(text_col).isNotNull()).select(id_col, tokens(F.col(text_col), tokenizer).alias("t"))
    return t.select(id_col, F.size("t").alias("doc_len"), F.explode("t").alias("term")).groupBy("term", id_col).agg(F.count("*").alias("tf"), F.first("doc_len").alias("doc_len"))


def batch_bm25(index: DataFrame, n_docs: int, average: float, queries: DataFrame, k: int, id_col: str = "id", query_id: str = "query_id", terms_col: str = "terms", params: Bm25 = Bm25()) -> DataFrame:
    """(query_id, id, ``score``, ``rank``) against a stored index; ``terms`` are
    the queries' distinct terms, all of which must occur.  Scores that agree to
    nine places are ties, by id: a sum's last bits follow the order of its terms."""
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    q = queries.select(query_id, F.array_distinct(terms_col).alias("__t")).select(query_id, F.size("__t").alias("need"), F.explode("__t").alias("term")).join(df, "term")
    # All terms must occur: only the documents of a query's rarest are looked at.
    rarest = Window.partitionBy(query_id).orderBy("df", "term")
    lead = q.withColumn("__n", F.row_number().over(rarest)).filter("__n = 1").select(query_id, "term")
    asked = index.join(lead, "term").select(query_id, id_col).join(q, query_id)
    tf, idf = F.col("tf"), F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * tf * (params.k1 + 1) / (tf + params.k1 * (1 - params.b + params.b * F.col("doc_len") / average))
    scores = index.join(asked, ["term", id_col]).groupBy(query_id, id_col).agg(F.sum(part).alias("score"), F.count("*").alias("got"), F.first("need").alias("need")).filter("got = need")
    w = Window.partitionBy(query_id).orderBy(F.desc(F.round("score", 9)), F.asc(id_col))
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(query_id, id_col, "score", "rank")


def batch_bm25_docs(docs: DataFrame, queries: DataFrame, k: int, tokenizer: str = "default", id_col: str = "id", text_col: str = "text", query_id: str = "query_id", terms_col: str = "terms", params: Bm25 = Bm25(), broadcast_terms: int = 500_000) -> DataFrame:
    """``batch_bm25`` without a stored index: only terms that are asked are
    counted, so that the rest of the texts' words is never shuffled.  Up to
    ``broadcast_terms`` distinct terms go to the scan tasks; more are joined."""
    t = docs.filter(F.col(text_col).isNotNull()).select(id_col, tokens(F.col(text_col), tokenizer).alias("t"))
    figures = t.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("a")).first()
    asked = written(queries.select(F.explode(terms_col).alias("term")).distinct(), "text-terms")
    few = F.broadcast(asked) if asked.count() <= broadcast_terms else asked
    cut = t.select(id_col, F.size("t").alias("doc_len"), F.explode("t").alias("term")).join(few, "term", "left_semi")
    index = written(cut.groupBy("term", id_col).agg(F.count("*").alias("tf"), F.first("doc_len").alias("doc_len")), "text-index")
    return batch_bm25(index, figures["n"], figures["a"] or 1.0, queries, k, id_col, query_id, terms_col, params)
