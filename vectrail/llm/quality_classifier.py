"""Quality classifier: random Fourier features and a calibrated ridge fit.

Statistics of a document (character classes, word and line shapes, repetition)
are standardised and mapped to random Fourier features, which approximate a
Gaussian kernel.  Each partition of the labelled sample sums its part of the
normal equations; the driver adds these fixed-size matrices and solves them.
Scores of the held-out rows are calibrated by isotonic regression.  Scoring is
one map over the texts.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import replacing, written

STATISTICS = (
    "log_chars", "log_words", "upper", "digit", "punctuation", "symbol", "space", "newline", "other",
    "word_length", "word_spread", "short_words", "long_words", "distinct_words", "top_word", "distinct_lines",
    "line_length", "ended_lines", "bracketed", "same_runs", "punctuated_words", "capital_words",
)


@dataclass(frozen=True)
class ClassifierRules:
    """``max_rows``: bound on the labelled rows that are read, chosen by a
    seeded hash of the id.  ``features``: random Fourier features.
    ``bandwidth``: of the kernel, for each standardised statistic.
    ``held_out``: share of the sample kept for calibration.  ``min_quality``:
    calibrated probability of good quality below which a document goes."""

    max_rows: int = 20_000
    features: int = 256
    bandwidth: float = 8.0
    ridge: float = 1e-3
    held_out: float = 0.3
    min_quality: float = 0.5
    seed: int = 5


_KNOWN: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """Class of each code point: 0 other, 1 lower or caseless letter, 2 upper,
    3 digit, 4 punctuation, 5 symbol, 6 space, 7 line break, 8 bracket."""
    if _KNOWN:
        return _KNOWN[0]
    kind = np.zeros(0x110000, np.uint8)
    kind[0x3000:] = 1
    for c in range(0x3000):
        k = unicodedata.category(chr(c))
        kind[c] = 2 if k == "Lu" else 1 if k[0] in "LM" else 3 if k[0] == "N" else 8 if k in ("Ps", "Pe") else 4 if k[0] == "P" else 5 if k[0] == "S" else 6 if k[0] == "Z" else 0
    kind[9], kind[10], kind[13] = 6, 7, 7
    _KNOWN.append(kind)
    return kind


def statistics(texts: list[str]) -> np.ndarray:
    """A row of STATISTICS for each text; an empty text has zeros."""
    out = np.zeros((len(texts), len(STATISTICS)))
    full = [i for i, t in enumerate(texts) if t]
    if not full:
        return out
    own = [texts[i] for i in full]
    code = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.array([len(t) for t in own])
    start = np.concatenate(([0], np.cumsum(n)[:-1]))
    kind = _classes()[code]
    share = [np.add.reduceat((kind == k).astype(np.int32), start) / n for k in range(9)]
    same = np.zeros(len(code), np.int32)
    same[1:] = (code[1:] == code[:-1]) & (kind[1:] != 1)
    gap = kind >= 6
    gap[kind == 8] = False
    head = ~gap
    head[1:] &= gap[:-1]
    head[start] = ~gap[start]
    at = np.flatnonzero(head)
    stop = ~gap
    stop[:-1] &= gap[1:]
    stop[start[1:] - 1] = ~gap[start[1:] - 1]
    end = np.flatnonzero(stop)
    owner = np.searchsorted(start, at, side="right") - 1
    length = (end - at + 1).astype(float)
    words = np.bincount(owner, minlength=len(own)).astype(float)
    w = np.maximum(words, 1)
    per = lambda x: np.bincount(owner, weights=x, minlength=len(own)) / w
    mean = per(length)
    spread = np.sqrt(np.maximum(per(length**2) - mean**2, 0))
    ended = np.isin(kind[end], (4, 5))
    capital = kind[at] == 2
    distinct, top, lines, line_n, closed = [], [], [], [], []
    for t in own:
        ws = t.split()
        bag = Counter(ws)
        distinct.append(len(bag) / max(1, len(ws)))
        ls = [x for x in t.split("\n") if x]
        lines.append(len(set(ls)) / max(1, len(ls)))
        line_n.append(len(ls))
        closed.append(sum(x[-1] in ".!?…。" for x in ls) / max(1, len(ls)))
        top.append(max(bag.values(), default=0) / max(1, len(ws)))
    found = (
        np.log1p(n), np.log1p(words), share[2], share[3], share[4], share[5], share[6], share[7], share[0],
        np.log1p(mean), np.log1p(spread), per(length <= 3), per(length >= 14), distinct, top, lines,
        np.log1p(n / np.maximum(1, line_n)), closed, share[8], np.add.reduceat(same, start) / n, per(ended), per(capital),
    )
    out[full] = np.stack([np.asarray(x, float) for x in found], 1)
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.omega + self.phase
        return np.concatenate([np.cos(z) * np.sqrt(2 / len(self.phase)), np.ones((len(x), 1))], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def calibrated(self, score: np.ndarray) -> np.ndarray:
        """The isotonic fit, linear between its knots."""
        return np.interp(score, self.knots, self.levels)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; equal scores are one block from the start.
    Knots are the mean scores of the blocks."""
    knots, at = np.unique(score, return_inverse=True)
    weight = np.bincount(at).astype(float)
    blocks: list[list[float]] = []
    for k, v, w in zip(knots, np.bincount(at, weights=y) / weight, weight):
        blocks.append([k, v, w])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            k2, v2, w2 = blocks.pop()
            k1, v1, w1 = blocks.pop()
            blocks.append([(k1 * w1 + k2 * w2) / (w1 + w2), (v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2])
    return np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    rules: ClassifierRules = ClassifierRules(),
) -> Model:
    """Labels that are null or whose document is missing are unused, and of an
    id's labels the least counts; rows of a labelled id are all used; without
    any, or with one class only, every document has that class's level (good,
    if there are none)."""
    # Of clashing labels of an id the least counts: a document that one label calls poor isn't good.
    labelled = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).dropna().groupBy("__id").agg(F.min("__y").alias("__y"))
    n = labelled.count()
    share = F.pmod(F.xxhash64(F.lit(rules.seed), "__id"), F.lit(2**52)) / 2.0**52
    sample = labelled.filter(share < min(1.0, rules.max_rows / max(1, n)))
    k = len(STATISTICS)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), k).cast(pa.list_(pa.float64()))], names=["i", "y", "x"])

    # The sample is bounded by max_rows, so it may be broadcast at any scale.
    drawn = docs.select(F.col(id_col).alias("__id"), text_col).join(F.broadcast(sample), "__id")
    kind = docs.schema[id_col].dataType.simpleString()
    data = drawn.select("__id", text_col, "__y").mapInArrow(measure, f"i {kind}, y int, x array<double>")
    held = F.pmod(F.xxhash64(F.lit(rules.seed + 1), "i"), F.lit(1000)) < int(1000 * rules.held_out)
    data = written(data.withColumn("held", held), "quality-sample")

    sums = data.agg(F.count("*").alias("n"), *[f(F.col("x")[j]).alias(f"{a}{j}") for j in range(k) for a, f in (("m", F.mean), ("s", F.stddev_pop))]).first()
    if not sums["n"]:
        mean, scale = np.zeros(k), np.ones(k)
    else:
        mean = np.array([sums[f"m{j}"] for j in range(k)])
        scale = np.array([max(sums[f"s{j}"], 1e-6) for j in range(k)])
    rng = np.random.default_rng(rules.seed)
    omega = rng.standard_normal((k, rules.features)) / rules.bandwidth
    phase = rng.uniform(0, 2 * np.pi, rules.features)
    d = rules.features + 1
    model = Model(mean, scale, omega, phase, np.zeros(d), np.zeros(1), np.ones(1))
    if not sums["n"]:
        return model

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, v, seen = np.zeros((d, d)), np.zeros(d), False
        for b in batches:
            if not b.num_rows:
                continue
            z = model.features(np.array(b.column(1).to_pylist()))
            a += z.T @ z
            v += z.T @ np.array(b.column(0).to_pylist(), float)
            seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([a.ravel(), v]).tobytes()])], names=["part"])

    total = np.zeros(d * d + d)
    for r in data.filter(~F.col("held")).select("y", "x").coalesce(8).mapInArrow(partial, "part binary").toLocalIterator():
        total += np.frombuffer(r["part"])
    a, v = total[: d * d].reshape(d, d), total[d * d :]
    beta = np.linalg.solve(a + rules.ridge * max(1.0, a[-1, -1]) * np.eye(d), v)
    model = Model(mean, scale, omega, phase, beta, np.zeros(1), np.ones(1))
    rest = data.filter("held").select("y", "x").collect()  # at most held_out * max_rows
    if not rest:
        return Model(mean, scale, omega, phase, beta, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    knots, levels = isotonic(model.score(np.array([r["x"] for r in rest])), np.array([r["y"] for r in rest], float))
    return Model(mean, scale, omega, phase, beta, knots, levels)


def judged(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Scores and calibrated qualities; 0 for texts without characters."""
    score = model.score(statistics([t or "" for t in texts]))
    return score, np.where([bool(t) for t in texts], model.calibrated(score), 0.0)


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", columns: bool = False) -> DataFrame:
    """(id, ``score``, ``quality``) of every row; with ``columns`` all columns
    of ``docs`` and these, which take the place of input columns so named.

    A null or empty text has quality 0.  Repeated rows give repeated results; a
    null id stays null.
    """
    src = replacing(docs, "score", "quality") if columns else docs.select(id_col, text_col)
    names = src.columns
    at = names.index(text_col)
    keep = list(range(len(names))) if columns else [0]
    fields = [T.StructField(names[i], src.schema[i].dataType) for i in keep]
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("quality", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, 2048):
                part = b.slice(first, 2048)
                s, q = judged(model, part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), pa.array(s), pa.array(q)], names=schema.names)

    return src.mapInArrow(run, schema)


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: bool = False, rules: ClassifierRules = ClassifierRules()) -> DataFrame:
    """(id, ``score``, ``quality``) of the documents of at least
    ``min_quality``, or with ``columns`` all their columns and these.

    Null and empty texts have quality 0 and go, unless ``min_quality`` is 0.  A
    null id stays null; repeated rows are judged alike and all stay or go.
    """
    model = fit(docs, labels, id_col, text_col, rules=rules)
    return score_quality(docs, model, id_col, text_col, columns).filter(F.col("quality") >= rules.min_quality)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: ClassifierRules = ClassifierRules()) -> DataFrame:
    """The same documents with the columns of ``docs`` alone, all of them."""
    model = fit(docs, labels, id_col, text_col, rules=rules)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, 2048):
                part = b.slice(first, 2048)
                yield part.filter(pa.array(judged(model, part.column(at).to_pylist())[1] >= rules.min_quality))

    return docs.mapInArrow(run, docs.schema)
