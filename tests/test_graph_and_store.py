from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vectrail.operators import graph, mutations
from vectrail.sources import store as S
from vectrail.sources.adapters import Document, Node, NodeStore, RetrievalStore
from vectrail.streaming import ingest as stream


@pytest.fixture(scope="module")
def edges(spark):
    rows = [("a", "b", "rel", 1.0), ("b", "c", "rel", 1.0), ("c", "a", "rel", 1.0), ("a", "d", "other", 1.0), ("d", "d", "loop", 1.0), ("a", "b", "other", 1.0)]
    return spark.createDataFrame(rows, "from_id string, to_id string, edge_type string, weight float")


def test_edges_and_degrees(spark, edges):
    assert graph.get_edges(edges, "a", "outgoing").count() == 3 and graph.get_edges(edges, "d").count() == 2
    assert sorted(r.id for r in graph.neighbors(edges, "a").collect()) == ["b", "b", "d"]
    assert graph.neighbors(edges, "d", "both").count() == 3 and graph.node_degree(edges, "d") == 2
    assert {r.id: r.degree for r in graph.degrees(edges).collect()} == {"a": 4, "b": 3, "c": 2, "d": 2}
    new = spark.createDataFrame([("a", "b", "rel", 0.5), ("x", "y", "rel", 1.0)], edges.schema)
    assert graph.count_new(edges, new) == 1
    out = graph.add_edges(edges, new)
    assert out.count() == 7 and graph.get_edge(out, "a", "b", "rel").first().weight == 0.5
    assert graph.remove_edge(out, "x", "y", "rel").count() == 6 and graph.remove_node(edges, "a").count() == 2
    assert graph.drop_orphans(edges, spark.createDataFrame([("a",), ("b",)], "id string")).count() == 2
    with pytest.raises(ValueError):
        graph.get_edges(edges, "a", "sideways")


def test_traversals(spark, edges):
    assert {r.id: r.depth for r in graph.traverse(edges, "a", 3).collect()} == {"b": 1, "d": 1, "c": 2}
    assert graph.traverse(edges, "a", 0).count() == 0
    by = {r.id: r.edge for r in graph.traverse_edges(edges, "a", 2).collect()}
    assert by["b"].edge_type == "other" and by["c"].from_id == "b"
    assert graph.shortest_path(edges, "a", "c") == ["a", "b", "c"] and graph.shortest_path(edges, "d", "a") is None
    assert graph.has_path(edges, "a", "a", 0) and not graph.has_path(edges, "a", "c", 1) and graph.has_path(edges, "b", "a", 2)
    nodes, inside = graph.subgraph(edges, ["a"], 1, edge_type="rel")
    assert sorted(r.id for r in nodes.collect()) == ["a", "b"] and inside.count() == 1
    assert sorted(r.id for r in graph.expand(edges, spark.createDataFrame([("c",)], "id string")).collect()) == ["a", "c"]
    assert graph.node_ids(edges).count() == 4 and graph.edge_types(edges).count() == 3


def test_mutations(spark):
    old = spark.createDataFrame([("a", [1.0], '{"x":1}'), ("b", [2.0], "{}")], "id string, vector array<float>, metadata string")
    new = spark.createDataFrame([("a", None, '{"y":2}', 1), ("c", [3.0], None, 1), ("c", [4.0], None, 2)], "id string, vector array<float>, metadata string, seq int")
    got = {r.id: (r.vector, r.metadata) for r in mutations.upsert(old, new, F.col("seq")).collect()}
    assert got == {"a": ([1.0], '{"y":2}'), "b": ([2.0], "{}"), "c": ([4.0], "{}")}
    with pytest.raises(ValueError, match="exists"):
        mutations.insert(old, old)
    with pytest.raises(KeyError):
        mutations.update(old, "z", [1.0])
    assert mutations.update(old, "a", metadata="{}").filter("id = 'a'").first().vector == [1.0]
    assert mutations.merge(old, old, "p_").count() == 4 and mutations.merge(old, old).count() == 2
    asked = spark.createDataFrame([(0, "b"), (1, "zz")], "position int, id string")
    assert [r.vector for r in mutations.lookup(old, asked).orderBy("position").collect()] == [[2.0], None]
    assert len({r.id for r in mutations.with_auto_ids(spark.range(5).select(F.lit(1).alias("v"))).collect()}) == 5


def test_store_lives_through_flush_and_log(spark, tmp_path):
    path = str(tmp_path / "s")
    schema = S.CollectionSchema(dense=2, text="default", graph=True, sparse=True)
    with S.create(spark, path, schema) as db:
        db.set([{"id": "a", "vector": [1, 0], "metadata": {"n": 1}, "text": "hello world"}, {"id": "b", "vector": [0, 1], "metadata": {"n": 2}, "sparse": {3: 1.0}}])
        db.set([{"id": "b", "metadata": {"n": 3}}])
        assert db.add_edges([{"from_id": "a", "to_id": "b", "edge_type": "rel"}, {"from_id": "a", "to_id": "gone", "edge_type": "rel"}]) == 2
        assert db.compact() == 0 and db.edges.count() == 1  # nothing was deleted; an edge to nowhere goes
    with pytest.raises(RuntimeError):
        len(db)
    with pytest.raises(FileExistsError):
        S.create(spark, path, schema)
    again = S.open_store(spark, path)
    assert [r.id for r in again.search([1, 0], 1).collect()] == ["a"] and again.get_metadata("b") == {"n": 3}
    assert [r.id for r in again.search([1, 0], 2, {"n": {"$gt": 1}}).collect()] == ["b"]
    assert [r.id for r in again.search_text("hello").collect()] == ["a"] and [r.id for r in again.search_sparse({3: 1}).collect()] == ["b"]
    assert again.get("b").vector == [0.0, 1.0] and [r and r.id for r in again.get_batch(["b", "q"])] == ["b", None] and "a" in again
    again.append_log(spark.createDataFrame([(1, "delete", "a"), (2, "noise", "b")], "seq int, op string, id string"))
    reopened = S.open_store(spark, path)
    assert list(reopened.ids()) == ["b"] and reopened.info()["records"] == 1
    assert reopened.delete(["b"]) == 1 and len(reopened) == 0
    with pytest.raises(KeyError):
        reopened.delete(["b"])
    with pytest.raises(FileNotFoundError):
        S.open_store(spark, str(tmp_path / "none"))


def test_schema_rules(spark, tmp_path):
    for bad in ({}, {"dense": 2, "multi": 2}, {"multi": 2, "metric": "l2"}, {"multi": 2, "sparse": True}, {"dense": 2, "metric": "cosine", "quantization": "sq8"}):
        with pytest.raises(ValueError):
            S.CollectionSchema(**bad).checked()
    db = S.open_store(spark, ":memory:")
    db.set([{"id": "a", "vector": [1, 2, 3]}])
    assert db.schema.dense == 3
    for bad in ([{"id": "b", "vector": [1]}], [{"id": "b", "vector": [1, 2, float("nan")]}], [{"id": "b", "vector": [1, 2, 3], "document": "x"}], [{"id": "b", "text": "x", "metadata": {"text": "y"}}], [{"id": "b", "document": "x"}]):
        with pytest.raises(ValueError):
            db.set(bad)
    with pytest.raises(ValueError, match="requires text"):
        db.search_text("x")
    with pytest.raises(ValueError):
        S.check_name("a-b")
    root = str(tmp_path)
    S.collection(spark, root, "two", S.CollectionSchema(dense=1))
    S.collection(spark, root, "one", S.CollectionSchema(dense=1))
    assert S.collections(spark, root) == ["one", "two"] and S.delete_collection(spark, root, "one") and S.collections(spark, root) == ["two"]


def test_store_graph_and_dispatch(spark, tmp_path):
    db = S.Store(spark, S.CollectionSchema(sparse=True, text="default"))
    with pytest.raises(ValueError, match="requires graph"):
        db.traverse("a")
    db.enable_graph()
    db.set([{"id": "a", "sparse": {1: 1.0}, "text": "red stone"}, {"id": "b", "sparse": {2: 1.0}}])
    db.add_edges([{"from_id": "a", "to_id": "b", "edge_type": "rel"}, {"from_id": "b", "to_id": "c", "edge_type": "rel"}])
    hits = db.query({1: 2.0})
    assert [r.id for r in hits.collect()] == ["a"] and [r.id for r in db.query("stone").collect()] == ["a"]
    assert sorted(r.id for r in db.expand(hits).collect()) == ["a", "b"] and db.edge_types() == ["rel"]
    nodes, inside = db.expand_graph(["a"], 2)
    assert [r.id for r in nodes.collect()] == ["a", "b", "c"] and inside.count() == 2
    assert db.shortest_path("a", "c") == ["a", "b", "c"] and db.has_path("a", "c") and db.node_degree("b") == 2 and db.neighbors("a").count() == 1
    copy = db.persist(str(tmp_path / "copy"))
    assert len(S.open_store(spark, copy.path)) == 2


def test_adapter(spark):
    db = S.Store(spark, S.CollectionSchema(dense=2), embed=lambda texts: [[float(len(t)), 1.0] for t in texts])
    r = RetrievalStore(db)
    r.add_texts(["aa", "bbbbbb"], [{"k": 1}, {"k": 2}], ["x", "y"])
    assert r.similarity_search("aaa", 1)[0].page_content == "aa" and r.query([6.0, 1.0], 1, [{"key": "k", "operator": "<", "value": 2}])[0][0] == "x"
    assert [d.id for d in r.get_by_ids(["y", "z"])] == ["y"] and r.delete(["x"]) and len(db) == 1


def test_more_of_the_adapters(spark):
    db = S.Store(spark, S.CollectionSchema(dense=2), embed=lambda texts: [[float(len(t)), 1.0] for t in texts])
    r = RetrievalStore.from_texts(db, ["aa", "bbbb"], [{"k": 1}, {"k": 2}], ["x", "y"])
    assert [d.id for d in r.similarity_search_by_vector([4.0, 1.0], 1)] == ["y"]
    assert len(RetrievalStore.from_documents(db, [Document("cccccc", {"k": 3}, "z")]).get_by_ids(["z"])) == 1
    n = NodeStore(db)
    assert n.add([Node("n1", "one", [50.0, 1.0], {"a": 1}, "doc"), Node("n2", "two", None, {"a": 2}, "doc"), Node("n3", "three", [70.0, 1.0], {"a": 3}, "other")]) == ["n1", "n2", "n3"]
    (found, score), *_ = n.query([50.0, 1.0], 1, [{"key": "a", "operator": "<", "value": 3}])
    assert (found.node_id, found.text, found.ref_doc_id, found.metadata) == ("n1", "one", "doc", {"a": 1}) and score == 1.0
    assert n.delete_nodes(["n1", "n3"], [{"key": "a", "value": 3}]) == 1 and n.delete("doc") == 2 and len(db) == 3
    with pytest.raises(ValueError):
        n.delete_nodes()


def test_streams(spark, tmp_path):
    rows = [(1, "upsert", "a", [1.0, 0.0]), (2, "upsert", "b", [0.0, 1.0]), (3, "delete", "a", None), (4, "upsert", "a", [0.5, 0.5])]
    source = str(tmp_path / "in")
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "seq int, op string, id string, vector array<float>").coalesce(1).write.mode("append").parquet(source)
    db = S.create(spark, str(tmp_path / "db"), S.CollectionSchema(dense=2))
    changes = spark.readStream.schema("seq int, op string, id string, vector array<float>").parquet(source)
    stream.ingest(changes, db, str(tmp_path / "ck")).awaitTermination()
    got = {r.id: r.vector for r in S.open_store(spark, str(tmp_path / "db")).records.collect()}
    assert got == {"a": [0.5, 0.5], "b": [0.0, 1.0]}
    events = spark.createDataFrame([("2024-01-01 00:00:30", "x", 1), ("2024-01-01 00:01:30", "x", 2), ("2024-01-01 00:01:40", "y", 2)], "t string, k string, i int").withColumn("t", F.to_timestamp("t"))
    events.write.parquet(str(tmp_path / "ev"))
    s = stream.windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")), "t", "1 minute", ["k"])
    s.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("counts").count() == 3
    assert stream.embedded(spark.createDataFrame([("abc",), (None,)], "text string"), lambda t: [[float(len(x))] for x in t]).selectExpr("sum(vector[0])").first()[0] == 3.0


def test_nothing_is_lost_without_a_flush(spark, tmp_path):
    path = str(tmp_path / "s")
    db = S.create(spark, path, S.CollectionSchema(dense=0))
    db.set([{"vector": [1, 2]}, {"vector": [3, 4]}])
    db.set([{"vector": [5, 6]}])
    db.set("a", [7, 8], {"k": 1})
    db.set(ids=["b", "c"], vectors=[[1, 1], [2, 2]], metadatas=[{"k": 1}, {"k": 2}])
    db.enable_graph()
    db.add_edges([{"from_id": "a", "to_id": "b", "edge_type": "rel"}, {"from_id": "b", "to_id": "c", "edge_type": "rel"}, {"from_id": "c", "to_id": "a", "edge_type": "rel"}])
    db.delete(["b"])
    db.add_edges([{"from_id": "a", "to_id": "b", "edge_type": "later"}])
    db.remove_edge("c", "a", "rel")
    db.update("a", vector=[9, 9])
    again = S.open_store(spark, path)  # the first was neither flushed nor closed
    assert len(again) == 5 and again.schema.dense == 2 and again.schema.graph
    assert [tuple(r) for r in again.edges.select("from_id", "to_id", "edge_type").collect()] == [("a", "b", "later")]
    assert again.get_vector("a") == [9.0, 9.0] and again.get_metadata("a") == {"k": 1} and len({*again.ids()}) == 5
    again.flush()
    more = S.open_store(spark, path)
    assert len(more) == 5 and more.version == 1 and more.info()["log_entries"] == 0 and more.has_edges("a") and more.get_edge("a", "b", "later")
    assert more.remove_all_for("a") == 1 and not more.has_edges("a") and more.bytes() > 0
    more.delete(["c"])
    assert more.compact() == 1 and len(S.open_store(spark, path)) == 4


def test_an_incomplete_version_or_call_does_not_count(spark, tmp_path):
    path = str(tmp_path / "s")
    db = S.create(spark, path, S.CollectionSchema(dense=1))
    db.set([{"id": "a", "vector": [1]}])
    db.flush()
    db.set([{"id": "a", "vector": [2]}])
    import os
    import shutil

    shutil.copytree(f"{path}/versions/1", f"{path}/versions/2")
    os.remove(f"{path}/versions/2/manifest.json")  # a flush that was killed
    shutil.copytree(f"{path}/log/2", f"{path}/log/3")
    os.remove(f"{path}/log/3/_SUCCESS")
    again = S.open_store(spark, path)
    assert again.version == 1 and again.get_vector("a") == [2.0]
    again.set([{"id": "b", "vector": [3]}])
    again.flush()
    shutil.copytree(f"{path}/versions/2", f"{path}/keep")
    os.makedirs(f"{path}/log", exist_ok=True)
    assert len(S.open_store(spark, path)) == 2


def test_many_calls_keep_a_flat_plan(spark):
    db = S.Store(spark, S.CollectionSchema(dense=1))
    for n in range(12):
        db.set([{"id": f"v{n % 5}", "vector": [n]}])
    plan = db.records._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 2 and {r.id: r.vector[0] for r in db.records.collect()} == {"v0": 10.0, "v1": 11.0, "v2": 7.0, "v3": 8.0, "v4": 9.0}
    db.close()


def test_records_without_metadata_are_not_deleted(spark):
    rows = spark.createDataFrame([("a", '{"k":1}'), ("b", None), ("c", "{}")], "id string, metadata string")
    assert [r.id for r in mutations.delete_by_filter(rows, {"k": {"$ne": 2}}).collect()] == ["b"]
    a, b = (mutations.with_auto_ids(spark.range(3).select(F.lit(1).alias("v"))).collect() for _ in range(2))
    assert len({r.id for r in a + b}) == 6


def test_multi_modes_and_limits(spark):
    db = S.Store(spark, S.CollectionSchema(multi=2, pool_factor=2, max_tokens=3))
    db.store("a", [[1.0, 0.0], [0.0, 1.0]])
    db.store("b", [[-1.0, 0.0], [-1.0, 0.1]])
    for mode in ("exact", "rerank", "encoded"):
        assert db.search_multi([[1.0, 0.0]], 1, mode=mode).first().id == "a"
    with pytest.raises(ValueError, match="before pooling"):
        db.store("c", [[1.0, 0.0]] * 7)
    with pytest.raises(ValueError):
        db.store("c", [1.0, 2.0])
    assert len(db.get_tokens("a")) == 1 and len(db.get_data("b")) == 1 and db.get_data("zz") is None


def test_intermediate_tables_are_cleaned(spark):
    import os

    from vectrail.sources import shared

    with shared.cleaned(spark):
        t = shared.written(spark.range(3), "scoped")
        path = t.inputFiles()[0].removeprefix("file:").removeprefix("//")
        assert t.count() == 3 and os.path.exists(path)
    assert not os.path.exists(path)
    kept = shared.written(spark.range(2), "unscoped")
    assert kept.count() == 2


def test_index_of_a_store(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4))
    db = S.create(spark, str(tmp_path / "s"), S.CollectionSchema(dense=4))
    db.set(spark.createDataFrame([(f"v{i:03}", v.tolist(), f'{{"half":{i % 2}}}') for i, v in enumerate(x)], "id string, vector array<float>, metadata string"))
    with pytest.raises(ValueError, match="build_index"):
        db.search_index([0, 0, 0, 0])
    made = db.build_index()
    assert made["cells"] == 20 and made["vectors"] == 400 and 0 < made["largest_share"] < 1
    again = S.open_store(spark, db.path)  # the index is kept
    exact = [r.id for r in again.search(x[5], 5, {"half": 1}).collect()]
    assert [r.id for r in again.search_index(x[5], 5, {"half": 1}, nprobe=20).collect()] == exact
    assert len({r.id for r in again.search_index(x[5], 5, {"half": 1}, "accurate").collect()} & set(exact)) >= 3
    again.delete(["v005"])
    with pytest.raises(ValueError, match="build_index"):
        again.search_index([0, 0, 0, 0])
