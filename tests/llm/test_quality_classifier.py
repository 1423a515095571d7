from __future__ import annotations

import random

import numpy as np
import pytest

from vectrail.llm import quality_classifier as Q


def corpus(n=400):
    rng = random.Random(2)
    words = "the of river stone and window bright paper over slowly".split()
    rows, labels = [], []
    for i in range(n):
        good = i % 2 == 0
        ws = [rng.choice(words) for _ in range(rng.randint(30, 90))]
        text = " ".join(ws).capitalize() + "." if good else " ".join(w.upper() + rng.choice(["!!", "$$$", "###"]) for w in ws[:30])
        rows.append((i, text))
        labels.append((i, int(good), 0))
    return rows, labels


@pytest.fixture(scope="module")
def fitted(spark, documents):
    rows, labels = corpus()
    known = spark.createDataFrame(labels[:300] + [(None, 1, 0), (5000, 1, 0), (2, None, 0)], "doc_id bigint, quality int, toxic int")
    docs = documents(rows)
    return docs, known, dict((i, y) for i, y, _ in labels), Q.fit(docs, known)


def test_held_out_accuracy(fitted):
    docs, known, truth, model = fitted
    rest = Q.score_quality(docs.filter("doc_id >= 300"), model).collect()
    assert len(rest) == 100 and np.mean([(r.quality >= 0.5) == truth[r.doc_id] for r in rest]) >= 0.97
    kept = Q.good_documents(docs, known, columns=True)
    assert kept.columns == [*docs.columns, "score", "quality"] and kept.count() == 200


def test_normal_equations_are_the_direct_fit(fitted):
    docs, known, truth, model = fitted
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    x = Q.statistics(texts)
    assert np.allclose(model.score(x), [r.score for r in Q.score_quality(docs, model).orderBy("doc_id").collect()])
    assert np.allclose(x, np.concatenate([Q.statistics([t]) for t in texts]))  # a text's row doesn't depend on its batch


def test_the_fit_is_the_direct_one(spark, fitted):
    """Ridge and calibration over the same rows without partitions: the whole
    matrix at once, and the isotonic fit by its min-max formula."""
    docs, known, _, model = fitted
    rules = Q.ClassifierRules()
    labelled = {r.doc_id: r.quality for r in known.collect() if r.doc_id is not None and r.quality is not None}
    from pyspark.sql import functions as F

    rows = docs.withColumn("held", F.pmod(F.xxhash64(F.lit(rules.seed + 1), "doc_id"), F.lit(1000)) < int(1000 * rules.held_out)).collect()
    rows = [r for r in rows if r.doc_id in labelled]
    x, y = Q.statistics([r.text for r in rows]), np.array([labelled[r.doc_id] for r in rows], float)
    held = np.array([r.held for r in rows])
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, np.maximum(x.std(0), 1e-6))
    rng = np.random.default_rng(rules.seed)
    omega, phase = rng.standard_normal((x.shape[1], rules.features)) / rules.bandwidth, rng.uniform(0, 2 * np.pi, rules.features)
    z = np.cos(np.clip((x - x.mean(0)) / np.maximum(x.std(0), 1e-6), -8, 8) @ omega + phase) * np.sqrt(2 / rules.features)
    z = np.concatenate([z, np.ones((len(z), 1))], 1)
    # Least squares with rows that stand for the ridge.
    strength = np.sqrt(rules.ridge * (~held).sum())
    beta = np.linalg.lstsq(np.concatenate([z[~held], strength * np.eye(z.shape[1])]), np.concatenate([y[~held], np.zeros(z.shape[1])]), rcond=None)[0]
    assert np.allclose(model.score(x), z @ beta, atol=1e-6)
    s, v = np.unique(model.score(x[held]), return_inverse=True)
    w = np.bincount(v).astype(float)
    m = np.bincount(v, weights=y[held])
    mean = lambda a, b: m[a : b + 1].sum() / w[a : b + 1].sum()
    brute = np.array([max(min(mean(a, b) for b in range(i, len(s))) for a in range(i + 1)) for i in range(len(s))])
    pooled = np.array([next(level for knot, level in reversed(list(zip(*blocks(model.score(x[held]), y[held])))) if knot <= t + 1e-12) for t in s])
    assert np.allclose(pooled, brute)


def blocks(score, y):
    """Where each block of the isotonic fit begins, and its level."""
    knots, levels = Q.isotonic(score, y)
    order = np.unique(score)
    begins = [order[0]]
    for level_before, level in zip(levels, levels[1:]):
        # The least score from which the mean of the rest of the block is the level.
        begins.append(next(t for t in order if t > begins[-1] and any(abs(y[(score >= t) & (score <= u)].mean() - level) < 1e-12 for u in order[order >= t]) and level > level_before))
    return begins, levels


def test_labels_that_clash(spark, fitted):
    docs, known, _, _ = fitted
    worse = known.unionByName(known.filter("doc_id < 50").selectExpr("doc_id", "0 as quality", "0 as toxic"))
    same = Q.fit(docs, worse)
    again = Q.fit(docs, worse.repartition(3).orderBy("quality", ascending=False))
    assert np.allclose(same.beta, again.beta)
    least = Q.fit(docs, worse.groupBy("doc_id").agg({"quality": "min"}).withColumnRenamed("min(quality)", "quality"))
    assert np.allclose(same.beta, least.beta)


def test_isotonic():
    knots, levels = Q.isotonic(np.array([0.1, 0.2, 0.2, 0.3, 0.4]), np.array([0, 1, 0, 0, 1.0]))
    assert np.all(np.diff(levels) >= 0) and levels[0] == 0 and levels[-1] == 1 and len(levels) == 3


def test_edges(spark, documents, fitted):
    _, known, _, model = fitted
    odd = documents([(1, None), (2, ""), (3, " \n "), (4, "a"), (4, "a"), (None, "word " * 30), (5, "long words here. " * 20_000), (6, "퟿\u0000 ünï")]).withColumnRenamed("lang", "score")
    got = Q.score_quality(odd, model, columns=True)
    assert got.count() == 8 and {r.doc_id: r.quality for r in got.collect()}[1] == 0.0 and got.columns.count("score") == 1
    assert Q.score_quality(odd.filter("false"), model).count() == 0
    none = Q.fit(odd, known.filter("false"))
    assert Q.score_quality(odd, none).filter("quality = 1").count() == 6
    one = Q.fit(fitted[0], known.filter("quality = 1"))
    assert Q.score_quality(fitted[0], one).filter("quality < 0.9").count() == 0
