"""The registered queries over the driver's tables, and their SQL.

Every query reads whole tables; a limit is a top k and nothing else.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filters, tokenizers
from ..functions import vectors as V
from ..operators import dense, fusion, graph, multivector, mutations, sparse, text
from ..sources.shared import shared_dir
from ..sources.store import CollectionSchema, Store
from ..streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "embeddings").withColumnsRenamed({"vec_id": "id", "embedding": "vector"})


def _first(spark: SparkSession, d: str) -> list[float]:
    return list(_table(spark, d, "embeddings").filter("vec_id = 0").first()["embedding"])


def _round(df: DataFrame, *cols: str) -> DataFrame:
    # 0.0 + turns -0.0 into 0.0, which other engines print differently.
    return df.withColumns({c: F.round(F.col(c), 6) + F.lit(0.0) for c in cols})


_Q = "q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)"
_E = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
_L2 = "list_distance(e.v, q.v)"


# --------------------------------------------------------------------- dense


@_register(f"WITH {_Q}, {_E} SELECT id, round({_L2}, 6) AS distance, round(1 / (1 + {_L2}), 6) AS score FROM e, q ORDER BY {_L2}, id LIMIT 10")
def dense_topk_l2(spark: SparkSession, d: str) -> DataFrame:
    return _round(dense.top_k(_vectors(spark, d), _first(spark, d), 10), "distance", "score")


@_register(f"WITH {_Q}, {_E} SELECT id, round(list_cosine_distance(e.v, q.v), 6) + 0.0 AS distance, round(1 - list_cosine_distance(e.v, q.v), 6) AS score FROM e, q ORDER BY list_cosine_distance(e.v, q.v), id LIMIT 10")
def dense_topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _round(dense.top_k(_vectors(spark, d), _first(spark, d), 10, "cosine"), "distance", "score")


@_register(f"WITH {_Q}, {_E} SELECT id, round(-list_inner_product(e.v, q.v), 6) AS distance, round(list_inner_product(e.v, q.v), 6) AS score FROM e, q ORDER BY list_inner_product(e.v, q.v) DESC, id LIMIT 10")
def dense_topk_dot(spark: SparkSession, d: str) -> DataFrame:
    return _round(dense.top_k(_vectors(spark, d), _first(spark, d), 10, "dot"), "distance", "score")


@_register(f"WITH {_Q}, {_E} SELECT id, round({_L2}, 6) AS distance, round(1 / (1 + {_L2}), 6) AS score FROM e, q WHERE label >= 3 AND label <> 5 ORDER BY {_L2}, id LIMIT 10")
def dense_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _round(dense.top_k(_vectors(spark, d), _first(spark, d), 10, where={"label": {"$gte": 3, "$ne": 5}}), "distance", "score")


@_register(f"WITH {_Q}, {_E}, t AS (SELECT id, {_L2} AS x FROM e, q ORDER BY x, id LIMIT 50) SELECT id, round(x, 6) AS distance, round(1 / (1 + x), 6) AS score FROM t WHERE x <= 1.0")
def dense_max_distance(spark: SparkSession, d: str) -> DataFrame:
    return _round(dense.top_k(_vectors(spark, d), _first(spark, d), 50, max_distance=1.0), "distance", "score")


def _batch_sql(distance: str, where: str = "true", cut: str = "true") -> str:
    return f"""
    WITH p AS (
      SELECT a.vec_id AS query_id, b.vec_id AS id, {distance} AS x
      FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) a,
           (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE {where}) b),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(x, 9), id) AS rank FROM p)
    SELECT query_id, id, round(x, 6) + 0.0 AS distance, rank FROM r WHERE rank <= 10 AND {cut}"""


def _every(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@_register(_batch_sql("list_distance(a.v, b.v)"))
def dense_batch_l2(spark: SparkSession, d: str) -> DataFrame:
    return _round(dense.batch_top_k(_vectors(spark, d), _every(spark, d), 10), "distance")


@_register(_batch_sql("list_cosine_distance(a.v, b.v)"))
def dense_batch_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _round(dense.batch_top_k(_vectors(spark, d), _every(spark, d), 10, "cosine"), "distance")


@_register(_batch_sql("list_distance(a.v, b.v)", "label IN (1, 2)", "x <= 1.2"))
def dense_batch_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _round(dense.batch_top_k(_vectors(spark, d), _every(spark, d), 10, where={"label": {"$in": [1, 2]}}, max_distance=1.2), "distance")


@_register("""
    WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, lead(embedding::DOUBLE[]) OVER (ORDER BY vec_id) AS w FROM embeddings)
    SELECT id, round(sqrt(list_inner_product(v, v)), 6) AS norm, round(list_inner_product(v, w), 6) + 0.0 AS dot,
           round(list_distance(v, w) ^ 2, 6) AS decomposed, round(list_distance(v, w), 6) AS compared,
           round(list_distance(v, w), 6) AS l2, round(list_cosine_distance(v, w), 6) + 0.0 AS cosine,
           round(list_inner_product(v, v) / sqrt(list_inner_product(v, v)) / sqrt(list_inner_product(v, v)), 6) AS unit
    FROM e WHERE w IS NOT NULL""")
def vector_functions(spark: SparkSession, d: str) -> DataFrame:
    """Every vector against the next one by id."""
    e = _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    # Ids are consecutive: the next is a join, not a window in one partition.
    e = e.join(e.select((F.col("id") - 1).alias("id"), F.col("v").alias("w")), "id")
    v, w = F.col("v"), F.col("w")
    out = e.select("id", V.l2_norm(v).alias("norm"), V.dot_product(v, w).alias("dot"), V.l2_distance(V.checked(v, w), w).alias("l2"), V.cosine_distance(v, w).alias("cosine"), V.norm_squared(V.normalize(v)).alias("unit"), V.l2_squared_decomposed(v, w, V.norm_squared(v), V.norm_squared(w)).alias("decomposed"), V.comparison_to_actual("l2", V.distance_for_comparison("l2", v, w)).alias("compared"))
    return _round(out, "norm", "dot", "l2", "cosine", "unit", "decomposed", "compared")


_SQ8 = """
    x AS (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings),
    s AS (SELECT list_sort(list(x)) AS l, count(*) AS n FROM x),
    p AS (SELECT l[1 + floor(n * 0.01)::BIGINT] AS lo, l[1 + least(n - 1, floor(n * 0.99)::BIGINT)] AS hi FROM s),
    c AS (SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda v: round(least(greatest((v - lo) / ((hi - lo) / 255), 0), 255))) AS q, lo, hi FROM embeddings, p)"""


def _params(spark: SparkSession, d: str) -> V.ScalarParams:
    return V.train_scalar(_vectors(spark, d))


@_register(f"WITH {_SQ8} SELECT id, list_sum(q)::BIGINT AS code_sum, round(list_sum(list_transform(q, lambda v: (v * (hi - lo) / 255 + lo) ^ 2)), 4) AS norm2 FROM c")
def scalar_codes(spark: SparkSession, d: str) -> DataFrame:
    p = _params(spark, d)
    q = V.quantize(F.col("vector"), p)
    return _vectors(spark, d).select("id", V.quantized_sum(q).alias("code_sum"), F.round(V.dequantized_norm_squared(q, p), 4).alias("norm2"))


@_register(_SQL["dense_topk_l2"])
def dense_rescored(spark: SparkSession, d: str) -> DataFrame:
    return _round(dense.rescored_top_k(_vectors(spark, d), _first(spark, d), 10, _params(spark, d)), "distance", "score")


@_register(_SQL["dense_topk_l2"])
def dense_cells(spark: SparkSession, d: str) -> DataFrame:
    """The cells that may hold one of the closest; exact."""
    v = _vectors(spark, d)
    c = dense.train_cells(v, 16)
    return _round(dense.probe_top_k(dense.assign_cells(v, c), _first(spark, d), 10, c, None), "distance", "score")


# ------------------------------------------------------------------- filters


@_register("""
    SELECT event_type, count(*) AS n FROM events
    WHERE json_type(props, '$.k') IN ('BIGINT', 'UBIGINT', 'DOUBLE') AND (props->>'$.k')::DOUBLE >= 20
      AND NOT coalesce((props->>'$.k')::DOUBLE IN (33, 44), false) GROUP BY event_type""")
def filter_json(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "events")
    cond = filters.compile_filter({"k": {"$gte": 20}, "$not": {"k": {"$in": [33, 44]}}, "missing": {"$ne": 1}}, filters.JsonFields(F.col("props")))
    return e.filter(cond).groupBy("event_type").agg(F.count("*").alias("n"))


@_register("""
    SELECT p_partkey, p_name, p_size FROM part
    WHERE (p_size > 40 OR contains(p_type, 'ECON')) AND p_retailprice < 1500 AND p_brand <> 'Brand#2'""")
def filter_columns(spark: SparkSession, d: str) -> DataFrame:
    p = _table(spark, d, "part")
    cond = filters.compile_filter({"$or": [{"p_size": {"$gt": 40}}, {"p_type": {"$contains": "ECON"}}], "p_retailprice": {"$lt": 1500}, "p_brand": {"$ne": "Brand#2"}}, filters.ColumnFields(p))
    return p.filter(cond).select("p_partkey", "p_name", "p_size")


@_register("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def count_by_filter(spark: SparkSession, d: str) -> DataFrame:
    o = _table(spark, d, "orders")
    return o.filter(dense.predicate(o, {"o_orderstatus": "F", "o_totalprice": {"$gt": 100000}})).agg(F.count("*").alias("n"))


# -------------------------------------------------------------------- sparse

_SPARSE_SQL = """
    sv AS (SELECT vec_id AS id, unnest(range(64)) AS dim, unnest(embedding) AS weight FROM embeddings),
    s AS (SELECT id, dim, weight::DOUBLE AS w FROM sv WHERE (id + dim) % 3 > 0)"""


def _sparse(spark: SparkSession, d: str) -> DataFrame:
    """Two thirds of every embedding's values, small and negative ones too, as a
    sparse vector."""
    pairs = F.transform(F.col("embedding"), lambda x, i: F.struct(i.cast("bigint").alias("dim"), x.alias("weight")))
    return _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.filter(pairs, lambda p: (F.col("vec_id") + p["dim"]) % 3 > 0).alias("sparse"), "label")


def _sparse_query(spark: SparkSession, d: str) -> list[tuple[int, float]]:
    return [(p["dim"], p["weight"]) for p in _sparse(spark, d).filter("id = 0").first()["sparse"]]


@_register(f"WITH {_SPARSE_SQL}, t AS (SELECT s.id, sum(s.w * q.w) AS score FROM s JOIN s q ON s.dim = q.dim AND q.id = 0 GROUP BY s.id ORDER BY score DESC, s.id LIMIT 10) SELECT id, round(score, 6) AS score, round(-score, 6) AS distance FROM t")
def sparse_topk(spark: SparkSession, d: str) -> DataFrame:
    return _round(sparse.search_sparse(_sparse(spark, d), _sparse_query(spark, d), 10), "score", "distance")


@_register(f"WITH {_SPARSE_SQL}, t AS (SELECT s.id, sum(s.w * q.w) AS score FROM s JOIN s q ON s.dim = q.dim AND q.id = 0 JOIN embeddings e ON e.vec_id = s.id AND e.label = 2 GROUP BY s.id ORDER BY score DESC, s.id LIMIT 10) SELECT id, round(score, 6) AS score, round(-score, 6) AS distance FROM t")
def sparse_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _round(sparse.search_sparse(_sparse(spark, d), _sparse_query(spark, d), 10, {"label": 2}), "score", "distance")


@_register(f"WITH {_SPARSE_SQL}, t AS (SELECT q.id AS query_id, s.id, sum(s.w * q.w) AS score FROM s JOIN s q USING (dim) GROUP BY q.id, s.id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM t) SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 5")
def sparse_batch(spark: SparkSession, d: str) -> DataFrame:
    s = _sparse(spark, d)
    return _round(sparse.batch_top_k(s, s.select(F.col("id").alias("query_id"), "sparse"), 5), "score")


@_register(f"WITH {_SPARSE_SQL}, t AS (SELECT id, count(*) AS nnz, max(dim) + 1 AS dims, sum(w * w) AS self FROM s GROUP BY id) SELECT id, nnz::INT AS nnz, dims, round(self, 6) AS self FROM t")
def sparse_functions(spark: SparkSession, d: str) -> DataFrame:
    s = _sparse(spark, d).select("id", V.sparse_from_pairs(F.concat("sparse", "sparse")).alias("s")).filter(F.size("s") > 0)
    return _round(s.select("id", V.sparse_nnz(F.col("s")).alias("nnz"), V.sparse_dim(F.col("s")).alias("dims"), V.sparse_dot(F.col("s"), F.col("s")).alias("self")), "self")


@_register("""
    WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)
    SELECT id, len(v)::INT AS nnz, len(v)::BIGINT AS dims, round(list_inner_product(v, v), 6) AS self, round(v[1], 6) + 0.0 AS lowest FROM e""")
def sparse_constructed(spark: SparkSession, d: str) -> DataFrame:
    """From parallel arrays, and from a map of the same."""
    at = F.sequence(F.lit(0), F.size("embedding") - 1)
    e = _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), V.sparse(at, F.col("embedding")).alias("a"), V.sparse_from_map(F.map_from_arrays(at, "embedding")).alias("b"))
    return _round(e.select("id", V.sparse_nnz(F.col("a")).alias("nnz"), V.sparse_dim(F.col("b")).alias("dims"), V.sparse_dot(F.col("a"), F.col("b")).alias("self"), F.col("b")[0]["weight"].cast("double").alias("lowest")), "self", "lowest")


@_register(f"WITH {_SPARSE_SQL}, o AS (SELECT id, dim, CASE WHEN id % 2 = 0 THEN 2 * w ELSE w END AS w FROM s WHERE id % 5 > 0) SELECT dim, count(*) AS n, round(sum(w), 4) + 0.0 AS total FROM o GROUP BY dim")
def sparse_postings(spark: SparkSession, d: str) -> DataFrame:
    """Postings of all records; those of every second replaced, those of every
    fifth removed."""
    r = _sparse(spark, d).select("id", "sparse")
    twice = r.filter("id % 2 = 0").withColumn("sparse", F.transform("sparse", lambda p: F.struct(p["dim"].alias("dim"), (p["weight"] * 2).alias("weight"))))
    index = sparse.remove_postings(sparse.replace_postings(sparse.postings(r), twice), r.filter("id % 5 = 0").select("id"))
    return index.groupBy("dim").agg(F.count("*").alias("n"), (F.round(F.sum(F.col("weight").cast("double")), 4) + 0.0).alias("total"))


# ---------------------------------------------------------------------- text

_TOK = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
_BM25_TERMS = ("with", "for")


def _bm25_sql(limit: int) -> str:
    t = "".join(f", len(list_filter(w, lambda x: x = '{x}')) AS t{i}" for i, x in enumerate(_BM25_TERMS))
    df = "".join(f", count(*) FILTER (t{i} > 0) AS df{i}" for i in range(len(_BM25_TERMS)))
    part = lambda i: f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * m / a))"
    return f"""
    k AS (SELECT doc_id AS id, len(w) AS m{t} FROM (SELECT doc_id, {_TOK} AS w FROM documents)),
    g AS (SELECT count(*) AS n, avg(m) AS a{df} FROM k),
    b AS (SELECT id, {" + ".join(part(i) for i in range(len(_BM25_TERMS)))} AS score FROM k, g WHERE {" AND ".join(f"t{i} > 0" for i in range(len(_BM25_TERMS)))} ORDER BY score DESC, id LIMIT {limit})"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").withColumnRenamed("doc_id", "id")


@_register(f"WITH {_bm25_sql(20)} SELECT id, round(score, 6) AS score FROM b")
def text_bm25(spark: SparkSession, d: str) -> DataFrame:
    return _round(text.bm25(_docs(spark, d), " ".join(_BM25_TERMS), 20), "score")


@_register(f"""
    WITH w AS (SELECT doc_id AS id, {_TOK} AS t FROM documents), g AS (SELECT count(*) AS n, avg(len(t)) AS a FROM w),
    x AS (SELECT id, len(t) AS m, unnest(t) AS term FROM w), i AS (SELECT term, id, count(*) AS tf, any_value(m) AS m FROM x GROUP BY term, id),
    f AS (SELECT term, count(*) AS df FROM i GROUP BY term),
    q AS (SELECT item_id AS query_id, list_distinct({_TOK}) AS t FROM benchmark),
    u AS (SELECT query_id, len(t) AS need, unnest(t) AS term FROM q),
    s AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * m / a))) AS score, count(*) AS got, any_value(need) AS need
          FROM u JOIN f USING (term) JOIN i USING (term), g GROUP BY query_id, id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s WHERE got = need)
    SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""")
def text_batch_bm25(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark item as a query."""
    q = _table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), tokenizers.tokens(F.col("text")).alias("terms"))
    return _round(text.batch_bm25_docs(_docs(spark, d), q, 10), "score")


_HUMPS = "regexp_replace(regexp_replace(text, '(\\p{Lu}+)(\\p{Lu}\\p{Ll})', '\\1 \\2', 'g'), '(\\p{Ll})(\\p{Lu})', '\\1 \\2', 'g')"


@_register(f"SELECT doc_id AS id, len(regexp_extract_all(lower({_HUMPS}), '[\\p{{L}}\\p{{N}}]+'))::INT AS n_code, md5(array_to_string(regexp_extract_all(lower({_HUMPS}), '[\\p{{L}}\\p{{N}}]+'), ' ')) AS code, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE 1 END::INT AS n_raw FROM documents")
def text_tokens_code(spark: SparkSession, d: str) -> DataFrame:
    """The code and the raw tokenizer."""
    t = _docs(spark, d).select("id", tokenizers.tokens(F.col("text"), "code").alias("c"), tokenizers.tokens(F.col("text"), "raw").alias("r"))
    return t.select("id", F.size("c").alias("n_code"), F.md5(F.array_join("c", " ")).alias("code"), F.size("r").alias("n_raw"))


@_register(f"SELECT doc_id AS id, len({_TOK})::INT AS n_tokens, len(list_distinct({_TOK}))::INT AS n_distinct FROM documents")
def text_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = tokenizers.tokens(F.col("text"))
    return _docs(spark, d).select("id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"))


# -------------------------------------------------------------------- hybrid


def _both(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the embedding of the same number, where there is one."""
    e = _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return _docs(spark, d).join(e, "id", "left")


def _hybrid_sql(fetch: int, where: str = "true") -> str:
    return f"""
    WITH {_Q}, e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings JOIN documents ON vec_id = doc_id WHERE {where}),
    a AS (SELECT id, {_L2} AS x FROM e, q ORDER BY x, id LIMIT {fetch}),
    va AS (SELECT id, x, row_number() OVER (ORDER BY x, id) - 1 AS r FROM a), {_bm25_sql(fetch)},
    ob AS (SELECT b.* FROM b JOIN documents ON b.id = doc_id WHERE {where}),
    tb AS (SELECT id, score AS s, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM ob),
    f AS (SELECT coalesce(va.id, tb.id) AS id, coalesce(0.5 / (va.r + 61), 0) + coalesce(0.5 / (tb.r + 61), 0) AS score, s, x FROM va FULL JOIN tb ON va.id = tb.id)"""


@_register(_hybrid_sql(20) + "SELECT id, round(score, 6) AS score, round(s, 6) AS keyword_score, round(x, 6) AS semantic_score FROM f ORDER BY f.score DESC, id LIMIT 10")
def hybrid_text(spark: SparkSession, d: str) -> DataFrame:
    return _round(fusion.hybrid_text(_both(spark, d), _first(spark, d), " ".join(_BM25_TERMS), 10, subscores=True), "score", "keyword_score", "semantic_score")


@_register(_hybrid_sql(40, "lang = 'en'") + "SELECT id, round(score, 6) AS score FROM f ORDER BY f.score DESC, id LIMIT 10")
def hybrid_text_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _round(fusion.hybrid_text(_both(spark, d), _first(spark, d), " ".join(_BM25_TERMS), 10, where={"lang": "en"}), "score")


@_register(f"""
    WITH {_Q}, {_E}, {_SPARSE_SQL}, a AS (SELECT id, {_L2} AS x FROM e, q ORDER BY x, id LIMIT 40),
    va AS (SELECT id, row_number() OVER (ORDER BY x, id) - 1 AS r FROM a),
    b AS (SELECT s.id, sum(s.w * o.w) AS score FROM s JOIN s o ON s.dim = o.dim AND o.id = 0 GROUP BY s.id ORDER BY score DESC, s.id LIMIT 40),
    tb AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM b),
    f AS (SELECT coalesce(va.id, tb.id) AS id, coalesce(0.3 / (va.r + 61), 0) + coalesce(0.7 / (tb.r + 61), 0) AS score FROM va FULL JOIN tb ON va.id = tb.id)
    SELECT id, round(score, 6) AS score, round(-score, 6) AS distance FROM f ORDER BY f.score DESC, id LIMIT 10""")
def hybrid_sparse(spark: SparkSession, d: str) -> DataFrame:
    return _round(fusion.hybrid_sparse(_sparse(spark, d), _first(spark, d), _sparse_query(spark, d), 10, 0.3), "score", "distance")


# -------------------------------------------------------------- multi-vector

_MULTI = """
    t AS (SELECT vec_id AS id, label, unnest([0, 1, 2, 3]) AS k, embedding::DOUBLE[] AS v FROM embeddings),
    m AS (SELECT id, label, k, v[k * 16 + 1 : k * 16 + 16] AS x FROM t),
    p AS (SELECT d.id, q.k, max(list_inner_product(q.x, d.x)) AS s, arg_max(d.k, (list_inner_product(q.x, d.x), -d.k)) AS hit FROM m d, m q WHERE q.id = 0 GROUP BY d.id, q.k)"""


def _multi(spark: SparkSession, d: str) -> DataFrame:
    """Every embedding cut into four tokens of 16."""
    parts = F.array(*[F.slice("embedding", 1 + 16 * k, 16) for k in range(4)])
    return _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), parts.alias("multi"), "label")


def _multi_query(spark: SparkSession, d: str) -> list[list[float]]:
    v = _first(spark, d)
    return [v[16 * k : 16 * k + 16] for k in range(4)]


@_register(f"WITH {_MULTI}, s AS (SELECT id, sum(s) AS score FROM p GROUP BY id) SELECT id, round(score, 6) AS score, round(-score, 6) AS distance FROM s ORDER BY s.score DESC, id LIMIT 10")
def maxsim_topk(spark: SparkSession, d: str) -> DataFrame:
    return _round(multivector.maxsim_top_k(_multi(spark, d), _multi_query(spark, d), 10), "score", "distance")


@_register(f"WITH {_MULTI} SELECT id, round(sum(s), 6) AS score, array_to_string(list(hit ORDER BY k), ',') AS matches FROM p GROUP BY id")
def maxsim_explained(spark: SparkSession, d: str) -> DataFrame:
    why = multivector.maxsim_explain(multivector.tokens_literal(_multi_query(spark, d)), F.col("multi"))
    return _multi(spark, d).select("id", why.alias("w")).select("id", F.round("w.score", 6).alias("score"), F.array_join(F.transform("w.matches", lambda x: x.cast("string")), ",").alias("matches"))


#: Tokens of 16 dimensions are added up as they are; of the records a fifth goes
#: on to MaxSim, by which recall doesn't fall as the table grows.
ENCODING, CANDIDATES = multivector.EncodingConfig(20, 2, None), 0.2


@_register()
def maxsim_encoded(spark: SparkSession, d: str) -> DataFrame:
    """Approximate: encodings first, then MaxSim of the best."""
    docs = multivector.encode_documents(_multi(spark, d), 16, ENCODING)
    return _round(multivector.encoded_top_k(docs, _multi_query(spark, d), 10, multivector.Encoder(16, ENCODING), share=CANDIDATES), "score", "distance")


def _reranked(found: str) -> str:
    return f"""
    SELECT id, round(score, 6) AS score, round(-score, 6) AS distance FROM (
      SELECT id, sum(s) AS score FROM p JOIN ({found}) USING (id) GROUP BY id) t ORDER BY t.score DESC, id LIMIT 10"""


@_register(f"WITH {_MULTI}, {_bm25_sql(10_000)} " + _reranked("SELECT id FROM b"))
def text_rerank(spark: SparkSession, d: str) -> DataFrame:
    """BM25 of the documents, then MaxSim of the embeddings of their number."""
    both = _docs(spark, d).join(_multi(spark, d).select("id", "multi"), "id", "left")
    return _round(fusion.text_rerank(both, " ".join(_BM25_TERMS), _multi_query(spark, d), 10), "score", "distance")


@_register(f"WITH {_MULTI}, {_SPARSE_SQL}, b AS (SELECT s.id, sum(s.w * q.w) AS score FROM s JOIN s q ON s.dim = q.dim AND q.id = 0 GROUP BY s.id ORDER BY score DESC, s.id LIMIT 100) " + _reranked("SELECT id FROM b"))
def sparse_rerank(spark: SparkSession, d: str) -> DataFrame:
    both = _sparse(spark, d).join(_multi(spark, d).select("id", "multi"), "id")
    return _round(fusion.sparse_rerank(both, _sparse_query(spark, d), _multi_query(spark, d), 10, 100), "score", "distance")


@_register()
def token_pooling(spark: SparkSession, d: str) -> DataFrame:
    return multivector.pool_tokens(_multi(spark, d), 2).select("id", F.size("multi").alias("n_tokens"), "multi")


# ----------------------------------------------------------------- mutations


def _records(spark: SparkSession, d: str, name: str, key: str, prefix: str, meta: list[str]) -> DataFrame:
    t = _table(spark, d, name)
    return t.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.to_json(F.struct(*meta)).alias("metadata"), F.col(meta[0]).cast("double").alias("amount"))


@_register("""
    WITH n AS (SELECT o_custkey AS k, max(o_totalprice) AS amount FROM orders GROUP BY o_custkey)
    SELECT 'c' || coalesce(c_custkey, k) AS id, coalesce(amount, c_acctbal) AS amount, k IS NOT NULL AS changed FROM customer FULL JOIN n ON c_custkey = k""")
def upsert_records(spark: SparkSession, d: str) -> DataFrame:
    """Customers, changed by their orders; of each customer's changes the one
    of the largest price is the last."""
    old = _records(spark, d, "customer", "c_custkey", "c", ["c_acctbal", "c_name"])
    new = _table(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("id"), F.lit('{"changed":true}').alias("metadata"), F.col("o_totalprice").alias("amount"))
    out = mutations.upsert(old, new, F.col("amount"))
    return out.select("id", "amount", filters.JsonFields(F.col("metadata")).equals("changed", True).alias("changed"))


@_register("SELECT c_custkey::VARCHAR AS id, c_acctbal AS amount FROM customer UNION ALL SELECT s_suppkey::VARCHAR, s_acctbal FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)")
def merge_records(spark: SparkSession, d: str) -> DataFrame:
    a = _records(spark, d, "customer", "c_custkey", "", ["c_acctbal"])
    return mutations.merge(a, _records(spark, d, "supplier", "s_suppkey", "", ["s_acctbal"])).select("id", "amount")


@_register("SELECT o_orderkey AS id, o_totalprice FROM orders WHERE NOT (o_orderstatus = 'O' AND o_totalprice < 200000)")
def delete_records(spark: SparkSession, d: str) -> DataFrame:
    o = _table(spark, d, "orders").withColumnRenamed("o_orderkey", "id")
    return mutations.delete_by_filter(o, {"o_orderstatus": "O", "o_totalprice": {"$lt": 200000}}).select("id", "o_totalprice")


@_register("SELECT o_orderkey AS position, o_custkey AS id, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def lookup_records(spark: SparkSession, d: str) -> DataFrame:
    c = _table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    return mutations.lookup(c, _table(spark, d, "orders").select(F.col("o_orderkey").alias("position"), F.col("o_custkey").alias("id"))).select("position", "id", "c_name")


_LOG = "e AS (SELECT user_id AS id, event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, value FROM events)"


@_register(f"WITH {_LOG}, x AS (SELECT id, coalesce(max(seq) FILTER (op = 'delete'), -1) AS dead FROM e GROUP BY id) SELECT id, arg_max(value, seq) AS amount FROM e JOIN x USING (id) WHERE seq > dead GROUP BY id")
def replay_log(spark: SparkSession, d: str) -> DataFrame:
    """All events as a change log: errors delete, other events upsert."""
    e = _table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), F.col("value").alias("amount"))
    return mutations.apply_log(spark.createDataFrame([], "id bigint, amount double"), e)


@_register("SELECT count(*) AS records, count(embedding) AS vectors, sum(len(embedding) * 4)::BIGINT AS vector_bytes FROM embeddings")
def store_statistics(spark: SparkSession, d: str) -> DataFrame:
    return mutations.statistics(_vectors(spark, d))


@_register("SELECT 'c' || c_custkey AS id, c_acctbal AS amount FROM customer UNION ALL SELECT 's' || s_suppkey, s_acctbal FROM supplier")
def insert_records(spark: SparkSession, d: str) -> DataFrame:
    a, b = _records(spark, d, "customer", "c_custkey", "c", ["c_acctbal"]), _records(spark, d, "supplier", "s_suppkey", "s", ["s_acctbal"])
    return mutations.insert(a, b).select("id", "amount")


@_register("SELECT 'c' || c_custkey AS id, CASE WHEN c_custkey = 7 THEN '{\"seen\":true}' ELSE '{\"c_name\":\"' || c_name || '\"}' END AS metadata FROM customer")
def update_record(spark: SparkSession, d: str) -> DataFrame:
    return mutations.update(_records(spark, d, "customer", "c_custkey", "c", ["c_name"]), "c7", metadata='{"seen":true}').select("id", "metadata")


_CREDIT = "SELECT 'c' || c_custkey FROM customer WHERE c_acctbal < 0"


@_register(f"SELECT 'record' AS kind, 'c' || c_custkey AS a, '' AS b FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 'edge', 'o' || o_orderkey, 'c' || o_custkey FROM orders WHERE 'c' || o_custkey NOT IN ({_CREDIT})")
def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Customers in debt are deleted, and their orders' edges with them."""
    c = _records(spark, d, "customer", "c_custkey", "c", ["c_acctbal"])
    e = _table(spark, d, "orders").select(_name("o", "o_orderkey").alias("from_id"), _name("c", "o_custkey").alias("to_id"), F.lit("by").alias("edge_type"))
    kept, edges = mutations.delete(c, c.filter("amount < 0").select("id"), e)
    return kept.select(F.lit("record").alias("kind"), F.col("id").alias("a"), F.lit("").alias("b")).unionAll(edges.select(F.lit("edge"), "from_id", "to_id"))


def _store(spark: SparkSession, d: str) -> Store:
    """A store in memory of all embeddings, with their labels as metadata."""
    db = Store(spark, CollectionSchema(dense=0, graph=True))
    db.set(_vectors(spark, d).select(F.col("id").cast("string").alias("id"), "vector", F.to_json(F.struct("label")).alias("metadata")))
    return db


@_register("SELECT vec_id::VARCHAR AS id, label::BIGINT AS label, round(embedding[1]::DOUBLE, 6) + 0.0 AS x FROM embeddings WHERE label <> 3 AND vec_id <> 1 UNION ALL SELECT 'new', 3, 0.5")
def store_changes(spark: SparkSession, d: str) -> DataFrame:
    """Set, delete by filter and by id, and set again, through the log."""
    db = _store(spark, d)
    db.delete_by_filter({"label": 3})
    db.delete(["1"])
    width = db.schema.dense
    db.set("new", [0.5] * width, {"label": 3})
    label = F.get_json_object("metadata", "$.label").cast("bigint")
    return _round(db.records.select("id", label.alias("label"), F.col("vector")[0].cast("double").alias("x")), "x")


@_register(f"WITH {_Q}, e AS (SELECT vec_id::VARCHAR AS id, embedding::DOUBLE[] AS v, label FROM embeddings) SELECT id, round({_L2}, 6) AS distance, round(1 / (1 + {_L2}), 6) AS score FROM e, q WHERE label IN (1, 4) ORDER BY {_L2}, id LIMIT 10")
def store_search(spark: SparkSession, d: str) -> DataFrame:
    found = _store(spark, d).search(_first(spark, d), 10, {"label": {"$in": [1, 4]}})
    return _round(found.select("id", "distance", "score"), "distance", "score")


@_register(f"WITH {_Q}, e AS (SELECT vec_id::VARCHAR AS id, embedding::DOUBLE[] AS v FROM embeddings) SELECT id, round({_L2}, 6) AS distance, round(1 / (1 + {_L2}), 6) AS score FROM e, q ORDER BY {_L2}, id LIMIT 10")
def store_index(spark: SparkSession, d: str) -> DataFrame:
    """By the store's cells, all of them probed, so that the result is exact."""
    db = _store(spark, d)
    made = db.build_index(cells=12)
    return _round(db.search_index(_first(spark, d), 10, nprobe=int(made["cells"])).select("id", "distance", "score"), "distance", "score")


@_register("SELECT i AS position, CASE WHEN vec_id IS NOT NULL THEN i::VARCHAR END AS id, label::BIGINT AS label FROM range(0, 1000000, 40) t(i) LEFT JOIN embeddings ON vec_id = i WHERE i <= 400")
def store_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A batch of ids in order, with nulls where there is no record."""
    asked = range(0, 401, 40)
    rows = _store(spark, d).get_batch([str(i) for i in asked])
    return spark.createDataFrame([(i, r and r["id"], None if r is None else json.loads(r["metadata"])["label"]) for i, r in zip(asked, rows)], "position bigint, id string, label bigint")


@_register("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts by a stream over the events, run to its end."""
    kind = _table(spark, d, "events").schema
    # A stream reads folders: that of the table, or the one that holds its file.
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    single = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    reader = spark.readStream.schema(kind)
    stream = reader.option("pathGlobFilter", "events.parquet").parquet(d) if single else reader.parquet(f"{d}/events.parquet")
    name = f"stream_counts_{uuid.uuid4().hex}"
    counts = ingest.windowed_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", ["event_type"], late="36500 days")
    counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", f"{shared_dir(spark)}/{name}").start().awaitTermination()
    return spark.table(name).select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n")


# --------------------------------------------------------------------- graph


def _name(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """order - customer - nation - region, and nations in a ring."""
    parts = [
        ("nation", _name("n", "n_nationkey"), _name("r", "n_regionkey"), "in"),
        ("customer", _name("c", "c_custkey"), _name("n", "c_nationkey"), "in"),
        ("supplier", _name("s", "s_suppkey"), _name("n", "s_nationkey"), "in"),
        ("orders", _name("o", "o_orderkey"), _name("c", "o_custkey"), "by"),
        ("nation", _name("n", "n_nationkey"), F.concat(F.lit("n"), ((F.col("n_nationkey") + 1) % 25).cast("string")), "next"),
    ]
    out = None
    for table, a, b, kind in parts:
        e = _table(spark, d, table).select(a.alias("from_id"), b.alias("to_id"), F.lit(kind).alias("edge_type"), F.lit(1.0).cast("float").alias("weight"))
        out = e if out is None else out.unionAll(e)
    return out


_EDGES = """
    e AS (SELECT 'n' || n_nationkey AS a, 'r' || n_regionkey AS b, 'in' AS t FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'in' FROM customer
          UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'in' FROM supplier UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'by' FROM orders
          UNION ALL SELECT 'n' || n_nationkey, 'n' || (n_nationkey + 1) % 25, 'next' FROM nation)"""
_WALK = _EDGES + ", w AS (SELECT 'r0' AS id, 0 AS depth UNION SELECT e.a, depth + 1 FROM w JOIN e ON e.b = w.id WHERE depth < 2)"


@_register(f"WITH RECURSIVE {_WALK} SELECT id, min(depth) AS depth FROM w GROUP BY id HAVING min(depth) > 0")
def graph_traverse(spark: SparkSession, d: str) -> DataFrame:
    return graph.traverse(_edges(spark, d), "r0", 2, "incoming")


@_register(f"""
    WITH RECURSIVE {_WALK}, m AS (SELECT id, min(depth) AS depth FROM w GROUP BY id)
    SELECT m.id, m.depth, (min({{'a': e.a, 'b': e.b, 't': e.t}})).a || '>' || (min({{'a': e.a, 'b': e.b, 't': e.t}})).b AS via
    FROM m JOIN e ON e.a = m.id JOIN m p ON p.id = e.b AND p.depth = m.depth - 1 WHERE m.depth > 0 GROUP BY m.id, m.depth""")
def graph_traverse_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.traverse_edges(_edges(spark, d), "r0", 2, "incoming").select("id", "depth", F.concat("edge.from_id", F.lit(">"), "edge.to_id").alias("via"))


@_register(f"""
    WITH RECURSIVE {_EDGES}, w AS (SELECT 'n0' AS id, ['n0'] AS path UNION SELECT e.b, list_append(path, e.b) FROM w JOIN e ON e.a = w.id AND e.t = 'next' WHERE len(path) <= 10),
    p AS (SELECT path FROM w WHERE id = 'n7' ORDER BY len(path), path LIMIT 1)
    SELECT array_to_string(path, '>') AS path, (len(path) - 1)::INT AS steps, true AS linked FROM p""")
def graph_path(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    path = graph.shortest_path(e, "n0", "n7", 10, edge_type="next")
    return spark.createDataFrame([(">".join(path), len(path) - 1, graph.has_path(e, "n0", "n7", 7, edge_type="next"))] if path else [], "path string, steps int, linked boolean")


_TOUCHING = "a = 'n3' OR b = 'n3'"


@_register(f"""
    WITH {_EDGES} SELECT 'all' AS kind, a AS from_id, b AS to_id, t AS edge_type FROM e WHERE {_TOUCHING}
    UNION ALL SELECT 'in', a, b, t FROM e WHERE b = 'n3' AND t = 'in' UNION ALL SELECT 'out', a, b, t FROM e WHERE a = 'n3'
    UNION ALL SELECT 'one', a, b, t FROM e WHERE a = 'n3' AND b = 'n4' AND t = 'next'""")
def graph_edges_of(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    parts = [("all", graph.edges_involving(e, "n3")), ("in", graph.get_edges(e, "n3", "incoming", "in")), ("out", graph.get_edges(e, "n3", "outgoing")), ("one", graph.get_edge(e, "n3", "n4", "next"))]
    out = None
    for kind, part in parts:
        part = part.select(F.lit(kind).alias("kind"), *graph.KEY)
        out = part if out is None else out.unionAll(part)
    return out


@_register(f"WITH {_EDGES} SELECT a AS id FROM e WHERE b = 'n3' UNION ALL SELECT b FROM e WHERE a = 'n3'")
def graph_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbors(_edges(spark, d), "n3", "both")


@_register(f"WITH {_EDGES} SELECT a AS from_id, b AS to_id, t AS edge_type, CASE WHEN t = 'next' THEN 2.0 ELSE 1.0 END AS weight FROM e WHERE NOT ({_TOUCHING}) UNION ALL SELECT 'x', 'y', 'next', 2.0")
def graph_changed(spark: SparkSession, d: str) -> DataFrame:
    """A node's edges removed, the ring's edges set anew, and one added."""
    e = _edges(spark, d)
    ring = e.filter("edge_type = 'next'").withColumn("weight", F.lit(2.0).cast("float"))
    new = ring.unionByName(spark.createDataFrame([("x", "y", "next", 2.0)], ring.schema))
    out = graph.remove_node(graph.add_edges(e, new), "n3")
    return out.select(*graph.KEY, F.col("weight").cast("double").alias("weight"))


@_register(f"WITH RECURSIVE {_EDGES}, w AS (SELECT unnest(['r1', 'r2']) AS id, 0 AS depth UNION SELECT e.a, depth + 1 FROM w JOIN e ON e.b = w.id WHERE depth < 1) SELECT DISTINCT id FROM w")
def graph_expand_seeds(spark: SparkSession, d: str) -> DataFrame:
    return graph.subgraph(_edges(spark, d), ["r1", "r2"], 1, "incoming")[0]


@_register(f"WITH {_EDGES} SELECT a AS id FROM e UNION SELECT b FROM e")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.node_ids(_edges(spark, d))


@_register(f"WITH {_EDGES}, u AS (SELECT a AS id, a, b, t FROM e UNION SELECT b, a, b, t FROM e) SELECT id, count(*) AS degree FROM u GROUP BY id")
def graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(_edges(spark, d))


@_register(f"WITH RECURSIVE {_WALK}, m AS (SELECT DISTINCT id FROM w) SELECT DISTINCT a AS from_id, b AS to_id, t AS edge_type FROM e WHERE a IN (SELECT id FROM m) AND b IN (SELECT id FROM m)")
def graph_subgraph(spark: SparkSession, d: str) -> DataFrame:
    return graph.subgraph(_edges(spark, d), ["r0"], 2, "incoming")[1].select(*graph.KEY)


@_register("SELECT 'c' || c_custkey AS id FROM customer UNION SELECT 'n' || c_nationkey FROM customer")
def graph_expand(spark: SparkSession, d: str) -> DataFrame:
    return graph.expand(_edges(spark, d), _table(spark, d, "customer").select(_name("c", "c_custkey").alias("id")))


@_register(f"WITH {_EDGES} SELECT t AS edge_type, count(*) AS n, count(DISTINCT a) AS sources FROM e GROUP BY t")
def graph_types(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).groupBy("edge_type").agg(F.count("*").alias("n"), F.countDistinct("from_id").alias("sources"))


@_register(f"WITH {_EDGES}, live AS (SELECT 'c' || c_custkey AS id FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'o' || o_orderkey FROM orders) SELECT a AS from_id, b AS to_id, t AS edge_type FROM e WHERE a IN (SELECT id FROM live) AND b IN (SELECT id FROM live)")
def graph_live_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges left after all but orders and customers in credit are deleted."""
    live = _table(spark, d, "customer").filter("c_acctbal > 0").select(_name("c", "c_custkey").alias("id")).unionAll(_table(spark, d, "orders").select(_name("o", "o_orderkey").alias("id")))
    return graph.drop_orphans(_edges(spark, d), live).select(*graph.KEY)
