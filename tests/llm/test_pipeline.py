from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline as P
from vectrail.llm import common, decontaminate, entries, ngram_join, quality_classifier, token_store

from test_quality_classifier import corpus

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists() or not Path(token_store.VOCABULARY).exists(), reason="the driver's tables or the vocabulary aren't here")
def test_stages(spark):
    docs = common.table(spark, DATA, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in P.STAGES[:-1]:
        docs = common.written(stage(spark, docs, DATA), "test")
        assert docs.columns == columns, name
        sizes.append(docs.count())
        if name == "near copies":
            assert ngram_join.near_copies(docs).count() == 0
        if name == "decontamination":
            assert decontaminate.find_contaminated(docs, common.table(spark, DATA, "benchmark")).count() == 0
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    blocks = common.written(P.STAGES[-1][1](spark, docs, DATA), "test")
    plain = token_store.encoder(token_store.vocabulary(token_store.VOCABULARY))
    want = sorted((r.doc_id, plain.encode_ordinary(r.text)) for r in docs.collect())
    assert sorted((r.doc_id, list(r.ids)) for r in token_store.read_blocks(blocks).collect()) == want
    run = P.run(spark, DATA)
    assert run.selectExpr("sum(tokens)").first()[0] == blocks.selectExpr("sum(tokens)").first()[0]


@pytest.fixture
def small_dir(spark, tmp_path):
    """Labels and a benchmark, for stages whose documents are given."""
    rows, labels = corpus(120)
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows, str(tmp_path)


PASSAGE = "a passage of the benchmark that no training text may hold at all in any place"


@pytest.mark.skipif(not Path(token_store.VOCABULARY).exists(), reason="no vocabulary file here")
def test_stages_with_odd_rows(spark, documents, small_dir):
    rows, sf_dir = small_dir
    odd = [(None, rows[0][1]), (500, None), (501, ""), (502, rows[2][1] + " " + PASSAGE), (502, rows[2][1]), (503, "long text of words. " * 20_000), (504, rows[4][1]), (504, rows[4][1]), (None, None)]
    df = documents([*rows, *odd])
    for old, new in (("lang", "score"), ("n_chars", "n_tokens")):  # names of operators' own columns
        df = df.withColumnRenamed(old, new)
    df = df.withColumn("quality", df["doc_id"] * 2)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, df, sf_dir)
        assert out.columns == df.columns and out.schema.simpleString() == df.schema.simpleString(), name
        kept = out.collect()
        # Rows come out as they went in, values of clashing names too.
        assert not Counter(map(str, kept)) - Counter(map(str, df.collect())), name
        assert stage(spark, df.filter("false"), sf_dir).count() == 0, name
        ids = Counter(r.doc_id for r in kept)
        if name == "quality classifier":
            # By the operator's own judgement, every row.
            good = quality_classifier.good_documents(df.drop("score", "quality"), common.table(spark, sf_dir, "labels"), columns=True)
            assert sorted(map(str, (r.doc_id for r in good.collect()))) == sorted(map(str, ids.elements()))
        if name == "near copies":
            assert ids[504] == 0 and ids[500] == 1 and ids[501] == 1 and ids[None] == 1  # 504 and the first null id are copies of others
        if name == "decontamination":
            assert [r.text for r in kept if r.doc_id == 502] == [rows[2][1]] and len(kept) == len(rows) + len(odd) - 1
        if name == "mixing":
            assert ids[500] == ids[501] == 0
    last = P.STAGES[-1][1](spark, df, sf_dir)
    assert sum(len(r.doc_ids) - r.continued for r in last.collect()) == df.count() and P.STAGES[-1][1](spark, df.filter("false"), sf_dir).count() == 0


DUCK = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DUCK.exists(), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_like_sql(spark, name):
    c = duckdb.connect()
    for p in DUCK.glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    got, want = entries.queries()[name](spark, str(DUCK)).toPandas(), c.sql(entries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda f: sorted(repr([None if v is None or v != v else round(float(v), 5) if isinstance(v, (int, float)) else str(v) for v in r]) for r in f[sorted(f.columns)].itertuples(index=False))
    assert plain(got) == plain(want)


def test_all_ten_are_registered():
    assert [int(n[2:].split("_")[0]) for n in entries.queries()] == list(range(1, 11)) and set(entries.oracle_sql()) <= set(entries.queries())
