"""Vector arithmetic as Column expressions: distances, norms, sparse vectors
and the 8-bit codec.  All sums are taken in double precision."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = {
    "l2": "l2", "euclidean": "l2", "cosine": "cosine", "cos": "cosine",
    "ip": "dot", "inner_product": "dot", "dot": "dot",
}


def metric_name(name: str) -> str:
    try:
        return METRICS[name.lower()]
    except KeyError:
        raise ValueError(f"unknown metric {name!r}; one of {', '.join(METRICS)}") from None


def vector(values: Sequence[float]) -> Column:
    """A literal array<double>."""
    return F.array(*[F.lit(float(x)) for x in values]) if len(values) else F.expr("array()").cast("array<double>")


def _total(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + x)


def _d(x: Column) -> Column:
    return x.cast("double")


def dot_product(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: _d(x) * _d(y)))


def norm_squared(v: Column) -> Column:
    return _total(F.transform(v, lambda x: _d(x) * _d(x)))


def l2_norm(v: Column) -> Column:
    return F.sqrt(norm_squared(v))


def l2_squared(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: (_d(x) - _d(y)) * (_d(x) - _d(y))))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def l2_squared_decomposed(a: Column, b: Column, a_norm2: Column, b_norm2: Column) -> Column:
    """From squared norms that are at hand; never below 0."""
    return F.greatest(F.lit(0.0), a_norm2 + b_norm2 - 2 * dot_product(a, b))


def cosine_distance(a: Column, b: Column, b_norm: Column | None = None) -> Column:
    """1 - cos; NaN if either vector has norm 0.  ``b_norm``: the norm of ``b``
    where it is known, as for a query."""
    norms = l2_norm(a) * (l2_norm(b) if b_norm is None else b_norm)
    return F.when(norms == 0, F.lit(float("nan"))).otherwise(1 - dot_product(a, b) / norms)


def distance(metric: str, a: Column, b: Column) -> Column:
    """Smaller is closer: Euclidean, 1 - cos, or the negated inner product."""
    m = metric_name(metric)
    return l2_distance(a, b) if m == "l2" else cosine_distance(a, b) if m == "cosine" else -dot_product(a, b)


def distance_for_comparison(metric: str, a: Column, b: Column) -> Column:
    """Orders like ``distance`` without the square root."""
    return l2_squared(a, b) if metric_name(metric) == "l2" else distance(metric, a, b)


def comparison_to_actual(metric: str, d: Column) -> Column:
    """Squared L2 up to 1e-5 counts as 0; other metrics are unchanged."""
    return F.when(d <= 1e-5, 0.0).otherwise(F.sqrt(d)) if metric_name(metric) == "l2" else d


def distance_to_score(metric: str, d: Column) -> Column:
    m = metric_name(metric)
    return 1 / (1 + d) if m == "l2" else 1 - d if m == "cosine" else -d


def checked(a: Column, b: Column) -> Column:
    """``a``, or an error at run time where the lengths of ``a`` and ``b`` differ."""
    return F.when(F.size(a) == F.size(b), a).otherwise(
        F.raise_error(F.concat(F.lit("dimension mismatch: "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string")))
    )


def normalize(v: Column) -> Column:
    """Unit length; an error at run time for a zero vector."""
    n = l2_norm(v)
    return F.when(n == 0, F.raise_error(F.lit("cannot normalize a zero vector"))).otherwise(F.transform(v, lambda x: _d(x) / n))


def is_finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(_d(x)) < float("inf")))


# ------------------------------------------------------------ sparse vectors

SPARSE = "array<struct<dim:bigint,weight:float>>"


def sparse(indices: Column, values: Column) -> Column:
    """From parallel arrays: as many values as indices, the indices strictly
    ascending from 0, the values finite; an error at run time otherwise."""
    steps = F.forall(F.sequence(F.lit(2), F.greatest(F.size(indices), F.lit(2))), lambda i: (F.size(indices) < 2) | (F.get(indices, i - 1) > F.get(indices, i - 2)))
    good = (F.size(indices) == F.size(values)) & F.forall(indices, lambda x: x >= 0) & steps & is_finite(values)
    pairs = F.zip_with(indices, values, lambda i, w: F.struct(i.cast("bigint").alias("dim"), w.cast("float").alias("weight")))
    return F.when(good, pairs).otherwise(F.raise_error(F.lit("sparse vector: indices must ascend, one finite value each")))


def sparse_from_pairs(pairs: Column) -> Column:
    """Sorted by dimension; of a repeated one the first pair stays."""
    numbered = F.transform(pairs, lambda p, i: F.struct(p["dim"].cast("bigint").alias("dim"), i.alias("at"), p["weight"].cast("float").alias("weight")))
    ordered = F.array_sort(numbered)
    kept = F.filter(ordered, lambda p, i: (i == 0) | (F.get(ordered, i - 1)["dim"] != p["dim"]))
    return F.transform(kept, lambda p: F.struct(p["dim"].alias("dim"), p["weight"].alias("weight")))


def sparse_from_map(m: Column) -> Column:
    return sparse_from_pairs(F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("dim"), e["value"].alias("weight"))))


def sparse_literal(weights: Mapping[int, float] | Iterable[tuple[int, float]]) -> list[tuple[int, float]]:
    """Sorted (dimension, weight) pairs; a repeated dimension keeps its first."""
    seen: dict[int, float] = {}
    for d, w in weights.items() if isinstance(weights, Mapping) else weights:
        if d < 0 or not math.isfinite(w):
            raise ValueError("sparse vector: dimensions from 0 and finite weights")
        seen.setdefault(int(d), float(w))
    return sorted(seen.items())


def sparse_dot(a: Column, b: Column) -> Column:
    other = F.map_from_entries(F.transform(b, lambda p: F.struct(p["dim"], p["weight"])))
    return _total(F.transform(a, lambda p: F.coalesce(_d(p["weight"]) * _d(F.try_element_at(other, p["dim"])), F.lit(0.0))))


def sparse_nnz(v: Column) -> Column:
    return F.size(v)


def sparse_dim(v: Column) -> Column:
    """One more than the last dimension; 0 if there is none."""
    return F.coalesce(F.try_element_at(v, F.lit(-1))["dim"] + 1, F.lit(0))


# -------------------------------------------------------------- 8-bit codec


@dataclass(frozen=True)
class ScalarParams:
    """value = code * scale + offset."""

    scale: float
    offset: float

    @staticmethod
    def of_range(low: float, high: float) -> ScalarParams:
        if high - low < 1e-7:
            return ScalarParams(1 / 255, low - 0.5)
        return ScalarParams((high - low) / 255, low)


def value_at(values: DataFrame, place: int, collect: int = 10_000, buckets: int = 4096) -> float:
    """The value at ``place`` (from 0) of column ``x`` in ascending order,
    exactly: histograms that narrow to the bucket of the place, one scan each,
    without a sort or shuffle of values."""
    low, high, n = values.agg(F.min("x"), F.max("x"), F.count("x")).first()
    while low < high and n > collect:
        inside = values.filter(F.col("x").between(low, high))
        bucket = F.floor((F.col("x") - low) / (high - low) * buckets)
        rows = inside.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()  # buckets + 1 at most
        for r in sorted(rows, key=lambda r: r["lo"]):
            if place < r["n"]:
                break
            place -= r["n"]
        if (r["lo"], r["hi"]) == (low, high):  # one bucket: the range is at the limit of precision
            break
        low, high, n = r["lo"], r["hi"], r["n"]
    if low == high:
        return low
    return sorted(r[0] for r in values.filter(F.col("x").between(low, high)).collect())[place]


def train_scalar(records: DataFrame, vector_col: str = "vector", low: float = 0.01, high: float = 0.99, sample: int | None = None) -> ScalarParams:
    """Range between two percentiles of all values, taken at place floor(n * p)
    of the ordered values.  With ``sample``, of about so many values, drawn by a
    hash of the vector."""
    total = records.agg(F.sum(F.size(vector_col))).first()[0] or 0
    if not total:
        raise ValueError("no values to train on")
    chosen = records
    if sample is not None and sample < total:
        chosen = records.filter(F.pmod(F.xxhash64(vector_col), F.lit(2**62)) < max(1, int(sample / total * 2**62)))
    values = chosen.select(F.explode(vector_col).alias("x")).select(_d(F.col("x")).alias("x")).filter("x is not null and not isnan(x)")
    n = values.count()
    if not n:  # a small sample may be empty
        return train_scalar(records, vector_col, low, high)
    return ScalarParams.of_range(*(value_at(values, min(int(n * p), n - 1)) for p in (low, high)))


def quantize(v: Column, p: ScalarParams) -> Column:
    """array<smallint> of codes from 0 to 255."""
    return F.transform(v, lambda x: F.round(F.least(F.greatest((_d(x) - p.offset) / p.scale, F.lit(0.0)), F.lit(255.0))).cast("smallint"))


def dequantize(q: Column, p: ScalarParams) -> Column:
    return F.transform(q, lambda x: (x * p.scale + p.offset).cast("double"))


def quantized_sum(q: Column) -> Column:
    return F.aggregate(q, F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))


def dequantized_norm_squared(q: Column, p: ScalarParams) -> Column:
    return norm_squared(dequantize(q, p))


def int_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("long") * y.cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def quantized_l2_squared(q: Column, q_norm2: Column, c: Column, c_norm2: Column, p: ScalarParams) -> Column:
    """Squared distance from whole-number dot products of codes.  ``q_norm2``
    is the query's norm before quantization."""
    dot = p.scale**2 * int_dot(q, c) + p.scale * p.offset * (quantized_sum(q) + quantized_sum(c)) + p.offset**2 * F.size(q)
    return F.greatest(F.lit(0.0), q_norm2 + c_norm2 - 2 * dot)
