from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
import pytest

from vectrail.operators import dense, fusion, multivector, sparse, text


def golden(i, dim=64):
    return [math.sin((i + k) * 0.1337) for k in range(dim)]


@pytest.fixture(scope="module")
def five(spark):
    rows = [(f"vec{i}", [0.1 * i] * 128, json.dumps({"label": "ABCAB"[i - 1], "value": i})) for i in range(1, 6)]
    return spark.createDataFrame(rows, "id string, vector array<float>, metadata string")


def ids(df):
    return [r["id"] for r in df.collect()]


def test_order_filter_and_limit(five):
    assert ids(dense.top_k(five, [0.1] * 128, 3)) == ["vec1", "vec2", "vec3"]
    assert ids(dense.top_k(five, [0.1] * 128, 5, where={"label": "A"})) == ["vec1", "vec4"]
    assert ids(dense.top_k(five, [0.1] * 128, 5, where={"value": {"$gt": 3}})) == ["vec4", "vec5"]
    assert ids(dense.top_k(five, [0.1] * 128, 5, max_distance=0.001)) == ["vec1"]
    assert ids(dense.top_k(five, [0.1] * 128, 1, "dot")) == ["vec5"]


def test_golden_filtered(spark):
    df = spark.createDataFrame([(f"id_{i}", golden(i), json.dumps({"cat": "even" if i % 2 == 0 else "odd", "val": i})) for i in range(100)], "id string, vector array<float>, metadata string")
    got = dense.top_k(df, golden(42), 10, where={"cat": "even"}, keep=["metadata"]).collect()
    assert len(got) == 10 and got[0]["id"] == "id_42" and all(json.loads(r["metadata"])["cat"] == "even" for r in got)


@pytest.mark.parametrize("query, k, metric, words", [([0.0] * 128, 1, "cosine", "zero vector"), ([float("nan")] * 128, 1, "l2", "NaN or Infinity"), ([1.0] * 128, 0, "l2", "k=0"), ])
def test_bad_queries(five, query, k, metric, words):
    with pytest.raises(ValueError, match=words):
        dense.top_k(five, query, k, metric)
    with pytest.raises(ValueError):
        dense.top_k(five, [0.0] * 128, 3, max_distance=-1)
    with pytest.raises(ValueError):
        dense.top_k(five, [0.0] * 128, 3, ef=2)


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_batch_equals_single_and_join(spark, metric):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8)).round(1)  # rounding makes ties
    x[7] = x[9]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id int, vector array<double>")
    q = df.filter("id < 10").selectExpr("id as query_id", "vector as q")
    a = {(r.query_id, r["rank"]): (r.id, round(r.distance, 9)) for r in dense.batch_top_k(df, q, 5, metric).collect()}
    b = {(r.query_id, r["rank"]): (r.id, round(r.distance, 9)) for r in dense.batch_top_k(df, q, 5, metric, max_query_values=0).collect()}
    assert a == b and len(a) == 50
    one = [(r.id, round(r.distance, 9)) for r in dense.top_k(df, x[3], 5, metric).collect()]
    assert one == [a[3, k] for k in range(1, 6)]


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_batch_with_few_finite_distances(spark, metric):
    rows = [(i, [float("nan"), 1.0] if i >= 5 else [float(i), 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, vector array<double>").coalesce(1)
    q = spark.createDataFrame([("a", [1.0, 1.0])], "query_id string, q array<double>")
    for k in (3, 8):
        one = [r.id for r in dense.top_k(df, [1.0, 1.0], k, metric).collect()]
        assert [r.id for r in dense.batch_top_k(df, q, k, metric).orderBy("rank").collect()] == one and len(one) == k


def test_batch_over_many_arrow_batches_and_large_norms(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 6)).round(1) * 1e9
    df = spark.createDataFrame([(f"v{i:04}", v.tolist()) for i, v in enumerate(x)], "id string, vector array<double>").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        q = df.limit(20).selectExpr("id as query_id", "vector as q")
        got = [(r.query_id, r.id) for r in dense.batch_top_k(df, q, 7).orderBy("query_id", "rank").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    d = np.sqrt(((x[:, None] - x[None, :20]) ** 2).sum(2))
    assert got == [(f"v{j:04}", f"v{i:04}") for j in range(20) for i in sorted(range(3000), key=lambda i: (d[i, j], i))[:7]]


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_batch_ties_to_nine_places(spark, metric):
    # Record 9 is closer by far less than nine places show.
    df = spark.createDataFrame([(3, [3.0, 4.0 - 1e-11]), (5, [0.0, -9.0]), (9, [3.0, 4.0])], "id int, vector array<double>").coalesce(1)
    q = spark.createDataFrame([(0, [3.0, 4.0])], "query_id int, q array<double>")
    for k in (1, 2):
        assert [r.id for r in dense.batch_top_k(df, q, k, metric).orderBy("rank").collect()] == [3, 9][:k]


def test_batch_memory_follows_the_block(spark, monkeypatch):
    sizes = []
    block = dense._block_top_k
    monkeypatch.setattr(dense, "_block_top_k", lambda found, names, q, *a: sizes.append(q.size) or block(found, names, q, *a))
    q = spark.range(40_000).selectExpr("id as query_id", "array_repeat(cast(id as float), 64) as q")
    dense.batch_top_k(q.limit(3).selectExpr("query_id as id", "q as vector"), q, 1)
    assert sum(sizes) == 40_000 * 64 and max(sizes) <= 1_000_000 and len(sizes) == 3
    # Equal vectors are all hits of every query; they aren't held at once.
    exact, seen = dense._exact, []
    monkeypatch.setattr(dense, "_exact", lambda m, x, q: seen.append(x.size) or exact(m, x, q))
    best = dense._Nearest(np.ones((512, 64)), 10, "l2", pa.int64())
    best.add(pa.array(range(4096)), np.ones((4096, 64)))
    assert max(seen) <= 1_000_000
    assert best.held.n_new <= 2 * 10 * 512 + 50_000 and best.held.table.num_rows <= 5120


def test_cells_of_a_batch(spark):
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(20, 12))
    x = centers[rng.integers(0, 20, 2000)] + rng.normal(size=(2000, 12)) * 0.3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vector array<double>")
    q = df.filter("id < 200").selectExpr("id as query_id", "vector as q")
    c = dense.train_cells(df, 16)
    indexed = dense.assign_cells(df, c)
    plain = lambda f: {(r.query_id, r["rank"], r.id) for r in f.collect()}
    exact = plain(dense.batch_top_k(df, q, 10))
    assert plain(dense.probe_batch(indexed, q, 10, c, 16)) == exact
    hits = {(a, i) for a, _, i in plain(dense.probe_batch(indexed, q, 10, c, 4, max_query_values=600))}
    assert len(hits & {(a, i) for a, _, i in exact}) >= 0.9 * 2000


def test_value_at_is_exact(spark):
    from vectrail.functions import vectors as V

    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=900), np.full(500, 0.25), [1e30, -1e30]])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    for place in (0, 1, 300, 700, 1000, len(x) - 1):
        assert V.value_at(df, place, collect=5, buckets=7) == np.sort(x)[place]


def test_rescored_and_cells(spark):
    from vectrail.functions import vectors as V

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vector array<float>")
    exact = ids(dense.top_k(df, x[0], 10))
    assert ids(dense.rescored_top_k(df, x[0], 10, V.train_scalar(df))) == exact
    c = dense.train_cells(df, 8)
    indexed = dense.assign_cells(df, c)
    assert ids(dense.probe_top_k(indexed, x[0], 10, c, nprobe=8)) == exact
    assert len(set(ids(dense.probe_top_k(indexed, x[0], 10, c, nprobe=3))) & set(exact)) >= 4


def test_sparse_golden(spark):
    rows = [("doc1", [(10, 0.5), (42, 1.2), (100, 0.8)]), ("doc2", [(10, 0.3), (50, 2.0), (100, 0.1)]), ("doc3", [(42, 0.9), (50, 0.5)])]
    df = spark.createDataFrame(rows, "id string, sparse array<struct<dim:bigint,weight:float>>")
    got = sparse.search_sparse(df, {10: 1, 42: 1}, 3).collect()
    assert [(r.id, round(r.score, 5)) for r in got] == [("doc1", 1.7), ("doc3", 0.9), ("doc2", 0.3)] and got[0].distance == -got[0].score
    assert sparse.search_sparse(df, {}, 3).count() == 0
    index = sparse.postings(df)
    assert sparse.remove_postings(index, df.filter("id = 'doc1'").select("id")).filter("id = 'doc1'").isEmpty()
    assert sparse.replace_postings(index, df).count() == 8
    many = {d: 1.0 for d in range(100)}
    assert ids(sparse.search_sparse(df, many, 1)) == ["doc2"]


def test_sparse_batch_blocks_and_ties(spark, monkeypatch):
    kind = "sparse array<struct<dim:bigint,weight:double>>"
    rng = np.random.default_rng(1)
    rows = [(i, {int(d): float(w) / 2 for d, w in zip(rng.integers(0, 30, 5), rng.integers(-3, 4, rng.integers(0, 6)))}) for i in range(200)]
    df = spark.createDataFrame([(i, list(r.items())) for i, r in rows] + [(999, None)], f"id int, {kind}").repartition(3)
    want = {}
    for i, q in rows:
        scores = sorted((-sum(q[d] * x[d] for d in q if d in x), j) for j, x in rows if set(q) & set(x))
        want |= {(i, r + 1): (j, -s) for r, (s, j) in enumerate(scores[:5])}
    for most in (500_000, 40):
        found = sparse.batch_top_k(df, df.selectExpr("id as query_id", "sparse"), 5, max_query_pairs=most)
        assert {(r.query_id, r["rank"]): (r.id, r.score) for r in found.collect()} == want
    # Record 9 is better by far less than nine places show, and NaN is not found.
    near = spark.createDataFrame([(3, [(0, 1.0)]), (9, [(0, 1.0 + 1e-11)]), (5, [(0, math.nan)]), (6, [(0, 0.5)])], f"id int, {kind}").coalesce(1)
    q = spark.createDataFrame([(0, [(0, 1.0), (0, 7.0)])], f"query_id int, {kind}")
    for k in (1, 2, 3):
        assert [r.id for r in sparse.batch_top_k(near, q, k).orderBy("rank").collect()] == [3, 9, 6][:k]
    # By default a block has 500,000 pairs at most, in arrays.
    many = spark.range(30_000).selectExpr("id as query_id", "transform(sequence(0, 39), d -> struct(cast(d as bigint) as dim, 1D as weight)) as sparse")
    sizes, blocks = [], sparse._query_blocks
    monkeypatch.setattr(sparse, "_query_blocks", lambda *a: (sizes.append(len(b[3])) or b for b in blocks(*a)))
    sparse.batch_top_k(near, many, 1)
    assert sum(sizes) == 1_200_000 and max(sizes) <= 500_000


def test_encodings_are_made_in_slices(spark, monkeypatch):
    rng = np.random.default_rng(2)
    docs = [rng.normal(size=(n, 16)) for n in rng.integers(0, 5, 2000)]
    df = spark.createDataFrame([(i, d.tolist()) for i, d in enumerate(docs)] + [(9999, None)], "id int, multi array<array<double>>").coalesce(1)
    config = multivector.EncodingConfig(20, 2, None)
    encoder = multivector.Encoder(16, config)
    want = np.array([encoder.encode(d, False) for d in [*docs, docs[0][:0]]])
    got = multivector.encode_documents(df, 16, config).orderBy("id").collect()
    assert np.allclose(np.array([r.fde for r in got]), want, atol=1e-6) and len(got) == 2001
    # What is made at once is 1,000,000 numbers, however large Arrow's batch.
    caught = []
    monkeypatch.setattr(multivector.F, "arrow_udf", lambda kind: lambda f: caught.append(f) or (lambda c: c))
    multivector.encode_documents(df, 16, config)
    batch = pa.array([[[1.0] * 16]] * 2000)
    parts = list(caught[0](iter([batch, batch])))
    assert sum(map(len, parts)) == 4000 and max(len(p.values) for p in parts) <= 1_000_000


@pytest.fixture(scope="module")
def hybrid(spark):
    texts = ["the quick brown fox jumps over the lazy dog [animal]", "machine learning algorithms for vector databases [tech]", "rust programming language is fast and safe [tech]", "cooking recipes for delicious apple pie [food]", "deep learning models and neural networks [tech]"]
    return spark.createDataFrame([(f"doc_{i}", golden(i, 128), t) for i, t in enumerate(texts)] + [("none", None, None)], "id string, vector array<float>, text string")


def test_bm25_and_hybrid(spark, hybrid):
    two = spark.createDataFrame([("doc1", "rust programming language"), ("doc2", "rust rust systems programming")], "id string, text string")
    assert ids(text.bm25(two, "rust", 5)) == ["doc2", "doc1"]
    assert ids(text.bm25(two, "rust language", 5)) == ["doc1"] and ids(text.bm25(two, "  ", 5)) == []
    assert set(ids(text.bm25(hybrid, "tech", 9))) == {"doc_1", "doc_2", "doc_4"}
    got = fusion.hybrid_text(hybrid, golden(1, 128), "learning", 5, subscores=True).collect()
    assert [r.id for r in got[:2]] == ["doc_1", "doc_4"] and got[0].keyword_score > 0
    assert any(r.keyword_score is None for r in got)
    index = text.index_terms(hybrid)
    q = spark.createDataFrame([(0, ["learning"])], "query_id int, terms array<string>")
    batch = text.batch_bm25(index, 5, 8.2, q, 5).collect()
    single = text.bm25(hybrid, "learning", 5).collect()
    assert [r.id for r in batch] == [r.id for r in single]
    for bad in ({"alpha": 2}, {"rrf_k": 0}, {"k": 0}):
        with pytest.raises(ValueError):
            fusion.hybrid_text(hybrid, golden(1, 128), "x", **{"k": 1, **bad})


def test_batch_bm25_ties_to_nine_places_and_rarest_terms(spark):
    # Document 2 is better by far less than nine places show.
    index = spark.createDataFrame([("a", 1, 1, 10.0 + 1e-10), ("a", 2, 1, 10.0), ("a", 3, 1, 10.0), ("b", 3, 2, 10.0), ("b", 4, 1, 10.0)], "term string, id int, tf int, doc_len double")
    q = spark.createDataFrame([(0, ["a"]), (1, ["a", "b", "a"]), (2, ["a", "none"]), (3, [])], "query_id int, terms array<string>")
    got = [(r.query_id, r.id, r["rank"]) for r in text.batch_bm25(index, 9, 10.0, q, 2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (1, 3, 1)]


def test_fuse_counts_ranks(spark):
    v = spark.createDataFrame([("a", 0.1), ("b", 0.2)], "id string, distance double")
    t = spark.createDataFrame([("b", 3.0), ("c", 1.0)], "id string, score double")
    got = {r.id: r.score for r in fusion.fuse(v, t, 9).collect()}
    assert got == pytest.approx({"a": 0.5 / 61, "b": 0.5 / 62 + 0.5 / 61, "c": 0.5 / 62})


def test_maxsim(spark):
    e = np.eye(16)
    df = spark.createDataFrame([("d", e[:2].tolist(), "words here"), ("none", None, "words"), ("far", e[5:6].tolist(), "else")], "id string, multi array<array<float>>, text string")
    q = [(0.9 * e[0]).tolist(), (0.8 * e[1]).tolist()]
    r = multivector.maxsim_top_k(df, q, 5, explain=True).collect()
    assert [x.id for x in r] == ["d", "far"] and r[0].score == pytest.approx(1.7) and r[0].distance == pytest.approx(-1.7)
    assert r[0].explanation.matches == [0, 1] and r[0].explanation.sub_scores == pytest.approx([0.9, 0.8])
    assert ids(fusion.text_rerank(df, "words", q, 5)) == ["d"]
    with pytest.raises(ValueError):
        multivector.maxsim_top_k(df, [], 5)


def test_encodings_and_pooling(spark):
    rng = np.random.default_rng(0)
    docs = [rng.normal(size=(rng.integers(2, 9), 16)) for _ in range(80)]
    df = spark.createDataFrame([(i, d.tolist()) for i, d in enumerate(docs)], "id int, multi array<array<float>>")
    config = multivector.EncodingConfig.quality()
    config = multivector.EncodingConfig(config.repetitions, config.partition_bits, None)
    encoder = multivector.Encoder(16, config)
    assert config.dimension(16) == 10 * 16 * 16 == len(encoder.encode(docs[0], True))
    encoded = multivector.encode_documents(df, 16, config)
    exact = ids(multivector.maxsim_top_k(df, docs[3].tolist(), 10))
    got = ids(multivector.encoded_top_k(encoded, docs[3].tolist(), 10, encoder, rerank=5))
    assert len(set(got) & set(exact)) >= 8
    x = np.concatenate([np.zeros((3, 4)) + 5, np.zeros((3, 4)) - 5]) + rng.normal(size=(6, 4)) * 0.01
    pooled = multivector.pool_matrix(x, 3)
    assert len(pooled) == 2 and sorted(np.sign(pooled[:, 0])) == [-1, 1]
    assert len(multivector.pool_matrix(x, 0)) == 6 and len(multivector.pool_matrix(x[:1], 2)) == 1
    assert multivector.pool_tokens(df, 2).selectExpr("max(size(multi))").first()[0] <= 4


def test_bounded_cells_are_exact(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(300, 16)), rng.normal(size=(60, 16)) * 0.05 + 9])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id int, vector array<double>")
    c = dense.train_cells(df, 16)
    indexed = dense.assign_cells(df, c).cache()
    for i in [*range(0, 300, 25), 310]:
        assert ids(dense.probe_top_k(indexed, x[i], 10, c, None)) == np.argsort(((x - x[i]) ** 2).sum(1), kind="stable")[:10].tolist()
    assert len(ids(dense.probe_top_k(indexed, x[0], 400, c, None))) == 360  # fewer than k
    with pytest.raises(ValueError, match="nprobe"):
        dense.probe_top_k(indexed, x[0], 10, c, None, metric="dot")


def test_registered_cells_find_what_brute_force_finds(spark, monkeypatch):
    from pathlib import Path

    from vectrail.plans import registry

    if not Path("/root/testdata/sf0.01").exists():
        pytest.skip("the driver's tables aren't here")
    run = registry.queries()
    v = registry._vectors(spark, "/root/testdata/sf0.01")
    x = {r.id: list(r.vector) for r in v.collect()}
    for i in (0, 57, 211, 402):
        monkeypatch.setattr(registry, "_first", lambda *_, i=i: x[i])
        assert run["dense_cells"](spark, "/root/testdata/sf0.01").collect() == run["dense_topk_l2"](spark, "/root/testdata/sf0.01").collect()


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_registered_encodings_recall(spark, monkeypatch, sf):
    from pathlib import Path

    from vectrail.plans import registry

    d = f"/root/testdata/{sf}"
    if not Path(d).exists():
        pytest.skip("the driver's tables aren't here")
    x = {r.id: np.array(r.multi, float) for r in registry._multi(spark, d).collect()}
    names, t = sorted(x), np.array([x[i] for i in sorted(x)])
    few = max(200, int(len(t) * registry.CANDIDATES))
    encoder, queries = multivector.Encoder(16, registry.ENCODING), t[:100]
    codes = np.array([encoder.encode(m, False) for m in t])
    best = lambda s, n: np.argsort(-s, kind="stable")[:n]
    exact = [best(np.einsum("qd,ntd->nqt", q, t).max(2).sum(1), 10) for q in queries]
    hits = [np.isin(e, best(codes @ encoder.encode(q, True), few)).mean() for e, q in zip(exact, queries)]
    assert np.mean(hits) >= 0.95
    got = []
    for i in (0, 31, 77):
        monkeypatch.setattr(registry, "_multi_query", lambda *_, i=i: t[i].tolist())
        found = ids(registry.queries()["maxsim_encoded"](spark, d))
        got.append(len(set(found) & {names[j] for j in exact[i]}) / 10)
    assert np.mean(got) >= 0.9
