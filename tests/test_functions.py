from __future__ import annotations

import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vectrail.functions import filters, tokenizers
from vectrail.functions import vectors as V


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_distances(spark):
    a, b = V.vector([0.1] * 128), V.vector([0.2] * 128)
    r = one(spark, V.l2_distance(a, b), V.dot_product(a, b), V.cosine_distance(a, b), V.l2_squared_decomposed(a, b, V.norm_squared(a), V.norm_squared(b)))
    assert r[0] == pytest.approx(1.131371, abs=1e-6)
    assert r[1] == pytest.approx(2.56) and r[2] == pytest.approx(0, abs=1e-9) and r[3] == pytest.approx(1.28)


def test_cosine_of_zero_is_nan_and_normalize_fails(spark):
    zero = V.vector([0, 0])
    assert math.isnan(one(spark, V.cosine_distance(zero, V.vector([1, 0])))[0])
    with pytest.raises(Exception, match="zero vector"):
        one(spark, V.normalize(zero))
    with pytest.raises(Exception, match="dimension mismatch"):
        one(spark, V.checked(zero, V.vector([1])))


def test_scores_and_comparison(spark):
    d = F.lit(4.0)
    assert list(one(spark, V.distance_to_score("l2", d), V.distance_to_score("cos", d), V.distance_to_score("ip", d), V.comparison_to_actual("l2", d), V.comparison_to_actual("l2", F.lit(1e-6)))) == [0.2, -3.0, -4.0, 2.0, 0.0]
    with pytest.raises(ValueError):
        V.metric_name("hamming")


def test_sparse(spark):
    pairs = F.expr("array(named_struct('dim', 9, 'weight', 1.0), named_struct('dim', 2, 'weight', 5.0), named_struct('dim', 9, 'weight', 7.0))")
    r = one(spark, V.sparse_from_pairs(pairs).alias("s"), V.sparse_dim(V.sparse_from_pairs(pairs)), V.sparse_dot(V.sparse_from_pairs(pairs), V.sparse_from_pairs(pairs)))
    assert [(p["dim"], p["weight"]) for p in r["s"]] == [(2, 5.0), (9, 1.0)] and r[1] == 10 and r[2] == 26.0
    good = one(spark, V.sparse(F.array(F.lit(1), F.lit(4)), F.array(F.lit(0.5), F.lit(2.0))).alias("s"))["s"]
    assert [(p["dim"], p["weight"]) for p in good] == [(1, 0.5), (4, 2.0)]
    with pytest.raises(Exception, match="ascend"):
        one(spark, V.sparse(F.array(F.lit(4), F.lit(4)), F.array(F.lit(0.5), F.lit(2.0))))
    m = one(spark, V.sparse_from_map(F.create_map(F.lit(3), F.lit(1.0), F.lit(1), F.lit(2.0))).alias("s"))["s"]
    assert [p["dim"] for p in m] == [1, 3]


def test_scalar_codes(spark):
    p = V.ScalarParams.of_range(-1.0, 1.0)
    a, b = V.vector([0.5, -0.25, 1.5]), V.vector([0.1, 0.9, -0.4])
    qa, qb = V.quantize(a, p), V.quantize(b, p)
    r = one(spark, qa.alias("q"), V.quantized_l2_squared(qb, V.norm_squared(V.dequantize(qb, p)), qa, V.dequantized_norm_squared(qa, p), p), V.l2_squared(V.dequantize(qa, p), V.dequantize(qb, p)))
    assert r["q"] == [191, 96, 255] and r[1] == pytest.approx(r[2])
    assert V.ScalarParams.of_range(2.0, 2.0).offset == 1.5


TEXT = "getUserProfile HTTPClient handle_request"


def test_tokenizers(spark):
    t = F.lit(TEXT)
    r = one(spark, tokenizers.tokens(t), tokenizers.tokens(t, "code"), tokenizers.tokens(t, "raw"), tokenizers.tokens(F.lit(None).cast("string")))
    assert r[0] == ["getuserprofile", "httpclient", "handle", "request"]
    assert r[1] == ["get", "user", "profile", "http", "client", "handle", "request"]
    assert r[2] == [TEXT] and r[3] == []
    assert tokenizers.query_terms(TEXT, "code") == r[1] and tokenizers.query_terms(TEXT) == r[0]


MATRIX = [
    ("{}", [False, True, False, False]), ('{"f":null}', [False, True, False, True]), ('{"f":"1"}', [False, True, False, False]),
    ('{"f":true}', [False, True, False, False]), ('{"f":1}', [True, False, True, False]), (None, [False, True, False, False]), ("no json", [False, True, False, False]),
]


def test_filter_null_matrix(spark):
    df = spark.createDataFrame([(m,) for m, _ in MATRIX], "m string")
    fields = filters.JsonFields(F.col("m"))
    specs = [{"f": 1}, {"f": {"$ne": 1}}, {"f": {"$gt": 0}}, {"f": None}]
    got = df.select(*[filters.compile_filter(s, fields) for s in specs]).collect()
    assert [list(r) for r in got] == [want for _, want in MATRIX]


def _reference(spec, doc):
    def leaf(name, op, v):
        has, x = name in doc, doc.get(name)
        same = lambda a, b: a == b and isinstance(a, bool) == isinstance(b, bool)
        number = isinstance(x, (int, float)) and not isinstance(x, bool)
        return {
            "$eq": lambda: has and same(x, v), "$ne": lambda: not (has and same(x, v)), "$gt": lambda: number and x > v, "$gte": lambda: number and x >= v,
            "$lt": lambda: number and x < v, "$lte": lambda: number and x <= v, "$in": lambda: has and any(same(x, y) for y in v),
            "$contains": lambda: isinstance(x, str) and v in x,
        }[op]()

    for k, v in spec.items():
        if k == "$and":
            ok = all(_reference(s, doc) for s in v)
        elif k == "$or":
            ok = any(_reference(s, doc) for s in v)
        elif k == "$not":
            ok = not _reference(v, doc)
        elif isinstance(v, dict):
            ok = all(leaf(k, op, x) for op, x in v.items())
        else:
            ok = leaf(k, "$eq", v)
        if not ok:
            return False
    return True


_VALUE = st.one_of(st.none(), st.booleans(), st.integers(-3, 3), st.sampled_from([0.5, 1.0, -2.5]), st.sampled_from(["", "a", "ab", "1"]))
_LEAF = st.one_of(
    st.fixed_dictionaries({"a": _VALUE}), st.fixed_dictionaries({"b": st.fixed_dictionaries({"$ne": _VALUE})}),
    st.fixed_dictionaries({"a": st.fixed_dictionaries({"$gt": st.integers(-3, 3), "$lte": st.integers(-3, 3)})}),
    st.fixed_dictionaries({"a": st.fixed_dictionaries({"$in": st.lists(_VALUE, max_size=3)})}), st.fixed_dictionaries({"b": st.fixed_dictionaries({"$contains": st.sampled_from(["a", "b"])})}),
)
_SPEC = st.recursive(_LEAF, lambda s: st.one_of(st.fixed_dictionaries({"$and": st.lists(s, max_size=2)}), st.fixed_dictionaries({"$or": st.lists(s, max_size=2)}), st.fixed_dictionaries({"$not": s})), max_leaves=4)


@settings(max_examples=12, deadline=None)
@given(st.lists(_SPEC, min_size=4, max_size=8), st.lists(st.dictionaries(st.sampled_from("ab"), _VALUE), min_size=5, max_size=12))
def test_filters_like_a_plain_evaluator(spark, specs, docs):
    df = spark.createDataFrame([(json.dumps(d),) for d in docs], "m string").coalesce(1)
    got = df.select(*[filters.compile_filter(s, filters.JsonFields(F.col("m"))).alias(f"c{i}") for i, s in enumerate(specs)]).collect()
    assert [list(r) for r in got] == [[_reference(s, d) for s in specs] for d in docs]


@pytest.mark.parametrize("bad", [{}, [], {"$xor": []}, {"f": {"$gt": "5"}}, {"f": {"$like": 1}}, {"f": {"$in": 3}}])
def test_filter_errors(spark, bad):
    with pytest.raises(ValueError):
        filters.compile_filter(bad, filters.JsonFields(F.col("m")))


def test_filter_helpers(spark):
    assert filters.combine({"a": 1}, {"$and": [{"b": 2}]}) == {"$and": [{"a": 1}, {"b": 2}]}
    assert filters.from_triples([{"key": "y", "operator": ">=", "value": 3}]) == {"y": {"$gte": 3}}
    p = spark.createDataFrame([("x", 3), (None, None)], "s string, n int")
    where = filters.compile_filter({"n": {"$gt": 1}, "s": {"$contains": "x"}}, filters.ColumnFields(p))
    assert p.filter(where).count() == 1 and p.filter(~where).count() == 1
