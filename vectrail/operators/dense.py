"""Exact nearest neighbours, single and batched, and their pruned variants."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import vectors as V
from ..functions.filters import ColumnFields, Fields, JsonFields, compile_filter


def check_query(query: Sequence[float], k: int, metric: str, dim: int | None = None) -> list[float]:
    q = [float(x) for x in query]
    if k <= 0:
        raise ValueError("k must be positive: k=0 finds nothing")
    if dim is not None and len(q) != dim:
        raise ValueError(f"query has {len(q)} dimensions, the collection {dim}")
    if not all(map(math.isfinite, q)):
        raise ValueError("query holds NaN or Infinity")
    if V.metric_name(metric) == "cosine" and not any(q):
        raise ValueError("cosine distance to a zero vector is undefined")
    return q


def check_options(k: int, ef: int | None = None, max_distance: float | None = None) -> None:
    if ef is not None and ef < k:
        raise ValueError("ef must be at least k")
    if max_distance is not None and max_distance < 0:
        raise ValueError("max_distance must not be negative")


def predicate(records: DataFrame, spec: Mapping[str, Any] | Column | None, metadata_col: str = "metadata") -> Column | None:
    """A filter document over the records' metadata, or over their own columns
    where they have no metadata column; a Column is taken as it is."""
    if spec is None or isinstance(spec, Column):
        return spec
    fields: Fields = ColumnFields(records)
    if metadata_col in records.columns:
        fields = JsonFields(F.col(metadata_col), isinstance(records.schema[metadata_col].dataType, T.VariantType))
    return compile_filter(spec, fields)


def top_k(
    records: DataFrame, query: Sequence[float], k: int, metric: str = "l2", where: Mapping[str, Any] | Column | None = None,
    max_distance: float | None = None, id_col: str = "id", vector_col: str = "vector", keep: Sequence[str] = (), ef: int | None = None,
) -> DataFrame:
    """(id, ``distance``, ``score``, keep...) of the k closest records that
    match, closest first, ties by id; those beyond ``max_distance`` go.

    Records without a vector are not found.  NaN distances come last.  Only id,
    vector and what the filter reads are scanned; ``keep`` columns ride along
    through the per-partition heaps of the limit.
    """
    q = check_query(query, k, metric)
    check_options(k, ef, max_distance)
    found = records.filter(F.col(vector_col).isNotNull())
    condition = predicate(records, where)
    if condition is not None:
        found = found.filter(condition)
    lit = V.vector(q)
    if V.metric_name(metric) == "cosine":
        d = V.cosine_distance(F.col(vector_col), lit, F.lit(math.sqrt(sum(x * x for x in q))))
    else:
        d = V.distance(metric, F.col(vector_col), lit)
    cols = [c for c in keep if c != id_col]
    scored = found.select(id_col, d.alias("distance"), *cols)
    best = scored.orderBy(F.col("distance").asc(), F.col(id_col).asc()).limit(k)
    if max_distance is not None:
        best = best.filter(F.col("distance") <= max_distance)
    return best.select(id_col, "distance", V.distance_to_score(metric, F.col("distance")).alias("score"), *cols)


def batch_top_k(
    records: DataFrame, queries: DataFrame, k: int, metric: str = "l2", where: Mapping[str, Any] | Column | None = None,
    max_distance: float | None = None, id_col: str = "id", vector_col: str = "vector", query_id: str = "query_id",
    query_col: str = "q", max_query_values: int = 1_000_000,
) -> DataFrame:
    """(query_id, id, ``distance``, ``rank``) of the k closest records of every
    query, ties by id, NaN distances last.  Distances that agree to nine places
    are ties.

    Queries go to the scan tasks in blocks of at most ``max_query_values``
    numbers: each block is one scan, and the result doesn't depend on the blocks.
    What a task holds follows the block and k, not the tables.  The more blocks,
    the fewer tasks a scan has, so that partial results don't grow with both.
    A task keeps k rows a query by matrix products over Arrow batches; the
    distances of the survivors are computed anew without the cancellation of the
    product form.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    check_options(k, None, max_distance)
    m = V.metric_name(metric)
    found = records.filter(F.col(vector_col).isNotNull())
    condition = predicate(records, where)
    if condition is not None:
        found = found.filter(condition)
    near, kind = None, queries.schema[query_id].dataType
    asked = queries.select(query_id, query_col)
    values = query_values(asked)
    found = for_blocks(found, values, max_query_values)
    for names, q in _query_blocks(asked, m, max_query_values, values):
        part = _block_top_k(found, names, q, kind, k, m, id_col, vector_col, query_id)
        near = part if near is None else near.unionAll(part)
    w = Window.partitionBy(query_id).orderBy(F.round("distance", PLACES).asc(), F.col(id_col).asc())
    best = near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    if max_distance is not None:
        best = best.filter(F.col("distance") <= max_distance)
    return best.select(query_id, id_col, "distance", "rank")


def query_values(queries: DataFrame) -> int:
    """Numbers in the second column's lists."""
    return queries.agg(F.sum(F.size(queries.columns[1]))).first()[0] or 0


def for_blocks(records: DataFrame, values: int, most: int) -> DataFrame:
    """``records`` in fewer partitions where blocks of queries make tasks enough."""
    blocks = -(-values // max(1, most))
    if blocks < 2:
        return records
    return records.coalesce(max(1, -(-4 * records.sparkSession.sparkContext.defaultParallelism // blocks)))


def _query_blocks(queries: DataFrame, m: str, most: int, values: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and vectors of the queries, block by block; one empty block if there
    are none."""
    kind, width = to_arrow_type(queries.schema[0].dataType), None
    for names, dim, q in _packed(queries, kind, most, values):
        if dim < 0 or (len(names) and width not in (None, dim)):
            raise ValueError("queries have different dimensions, or there is a null")
        width = dim if len(names) else width
        if not np.isfinite(q).all():
            raise ValueError("query holds NaN or Infinity")
        if m == "cosine" and not (q != 0).any(axis=1).all():
            raise ValueError("cosine distance to a zero vector is undefined")
        yield names, q


def _pack(column: pa.Array) -> tuple[int, np.ndarray]:
    """Dimension and matrix; -1 where dimensions differ or there is a null."""
    sizes = pc.unique(pc.list_value_length(column)).to_pylist()
    if column.null_count or len(sizes) > 1:
        return -1, np.zeros((len(column), 0))
    return sizes[0] if sizes else 0, matrix(column)


def _packed(queries: DataFrame, kind: pa.DataType, most: int, values: int) -> Iterator[tuple[pa.Array, int, np.ndarray]]:
    if values <= most:
        t = queries.toArrow()
        yield t.column(0).combine_chunks().cast(kind), *_pack(t.column(1).combine_chunks())
        return
    schema = T.StructType([T.StructField("names", T.ArrayType(queries.schema[0].dataType)), T.StructField("dim", T.IntegerType()), T.StructField("q", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                dim, q = _pack(b.column(1))
                step = max(1, most // max(1, dim))
                for first in range(0, b.num_rows, step):
                    own = b.column(0).slice(first, step).cast(kind)
                    names = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
                    yield pa.RecordBatch.from_arrays([names, pa.array([dim], pa.int32()), pa.array([q[first : first + step].tobytes()], pa.binary())], names=schema.names)

    # Matrices come to the driver, one partition's at a time.
    names, rows, dim = [], [], None
    for r in queries.mapInArrow(run, schema).toLocalIterator():
        if r["dim"] < 0 or dim not in (None, r["dim"]):
            yield pa.array(r["names"], kind), -1, np.zeros((0, 0))
        dim = r["dim"]
        names.extend(r["names"])
        rows.append(np.frombuffer(r["q"]).reshape(-1, dim))
        step = max(1, most // max(1, dim))
        while len(names) > step:
            q = np.concatenate(rows)
            yield pa.array(names[:step], kind), dim, q[:step].copy()
            names, rows = names[step:], [q[step:]]
    yield pa.array(names, kind), dim or 0, np.concatenate(rows) if rows else np.zeros((0, 0))


def _exact(m: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    if m == "l2":
        return np.sqrt(((x - q) ** 2).sum(1))
    dots = (x * q).sum(1)
    if m == "dot":
        return -dots
    norms = np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum(1))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(norms == 0, np.nan, 1 - dots / norms)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as a matrix of doubles, without Python objects."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


#: Numbers that agree to so many places are ties.
PLACES = 9


def places(d: np.ndarray) -> np.ndarray:
    """``d`` to PLACES, where a double has so many."""
    return np.where(np.abs(d) < 1e7, np.round(np.where(np.abs(d) < 1e7, d, 0), PLACES), d)


class Held:
    """The k rows of least ``d`` of each of n queries, ties by id, NaN last."""

    def __init__(self, n: int, k: int, kind: pa.DataType) -> None:
        self.n, self.k = n, k
        self.table = pa.schema([("q", pa.int32()), ("key", pa.float64()), ("nan", pa.bool_()), ("id", kind), ("d", pa.float64())]).empty_table()
        self.new: list[pa.Table] = []
        self.n_new = 0

    def push(self, q: np.ndarray, d: np.ndarray, ids: pa.Array) -> bool:
        """Hold more rows; whether there was a ``settle``."""
        lost = np.isnan(d)
        key = places(np.where(lost, np.inf, d))
        self.new.append(pa.table({"q": pa.array(q.astype(np.int32)), "key": pa.array(key), "nan": pa.array(lost), "id": ids, "d": pa.array(d)}, schema=self.table.schema))
        self.n_new += len(q)
        if self.n_new <= 2 * self.k * self.n + 50_000:
            return False
        self.settle()
        return True

    def settle(self) -> None:
        t = pa.concat_tables([self.table, *self.new]).combine_chunks()
        t = t.take(pc.sort_indices(t, [(c, "ascending") for c in ("q", "key", "nan", "id")], null_placement="at_start"))
        q = t["q"].to_numpy()
        start = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, int)
        rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
        self.table, self.new, self.n_new = t.filter(pa.array(rank < self.k)), [], 0

    def kth(self) -> tuple[np.ndarray, np.ndarray]:
        """Queries that have k settled rows, and the last of these's ``d``."""
        q = self.table["q"].to_numpy()
        last = np.cumsum(np.bincount(q, minlength=self.n)) - 1
        full = np.flatnonzero(np.bincount(q, minlength=self.n) >= self.k)
        d = self.table["d"].to_numpy()[last[full]] if len(full) else np.zeros(0)
        return full[~np.isnan(d)], d[~np.isnan(d)]

    def batches(self, names: pa.Array, columns: list[str], sign: float = 1.0) -> Iterator[pa.RecordBatch]:
        self.settle()
        t = self.table
        out = pa.table([names.take(t["q"].combine_chunks()), t["id"], pa.array(sign * t["d"].to_numpy())], names=columns)
        yield from out.combine_chunks().to_batches(max_chunksize=65_536)


class _Nearest:
    """The k closest rows of each query over the batches of a task."""

    def __init__(self, q: np.ndarray, k: int, m: str, kind: pa.DataType) -> None:
        self.q, self.k, self.m = q, k, m
        self.q2 = (q * q).sum(1)
        self.edge = np.full(len(q), np.inf)  # what a row's rough distance may be, at most
        self.held = Held(len(q), k, kind)

    def add(self, ids: pa.Array, x: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Hold more vectors against all queries, or against some."""
        rows = np.arange(len(self.q)) if rows is None else rows
        n2 = (x * x).sum(1)
        largest, width = float(np.sqrt(np.nanmax(n2, initial=0.0))), x.shape[1]
        # Single precision does for a first look, where nothing overflows.
        kind = np.float32 if max(largest, float(np.sqrt(self.q2.max(initial=0.0)))) < 1e15 and np.isfinite(n2).all() else np.float64
        unit = np.finfo(kind).eps * (width + 16)
        # One product gives what orders the rows: |x|^2 - 2 q.x, -q.x or -q.x / |x|.
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            if self.m == "cosine":
                near = (x / np.sqrt(n2)[:, None]).astype(kind)
            else:
                near = np.concatenate([x, n2[:, None]], 1).astype(kind) if self.m == "l2" else x.astype(kind)
        take, some = min(len(x), self.k), max(1, 1_000_000 // max(1, width))
        for first in range(0, len(rows), 256):
            own_rows = rows[first : first + 256]
            part = self.q[own_rows]
            own = np.sqrt(self.q2[own_rows])
            asked = np.concatenate([-2 * part, np.ones((len(part), 1))], 1) if self.m == "l2" else -part
            with np.errstate(invalid="ignore", over="ignore"):
                rough = asked.astype(kind) @ near.T
            # Rounding may swap rows by twice this; rows that differ by less than
            # the places that count must both stay.
            slack = 2 * unit * (own * (2 * largest if self.m == "l2" else largest if self.m == "dot" else 1) + (largest**2 if self.m == "l2" else 0))
            slack = slack + 2 * 10.0**-PLACES * (2 * (own + largest) + 1 if self.m == "l2" else 1 if self.m == "dot" else own)
            edge = self.edge[own_rows]
            open_ = np.flatnonzero(np.isinf(edge))
            if len(open_) and take < len(x):
                clean = rough[open_]
                clean[np.isnan(clean)] = np.inf
                edge[open_] = np.partition(clean, take - 1, axis=1)[:, take - 1] + slack[open_]
            with np.errstate(invalid="ignore"):
                # Not "rough <= edge" for all: a NaN may be among the closest of few.
                hit = rough <= (edge + slack).astype(kind)[:, None]
                loose = np.isinf(edge)
                if loose.any():
                    hit[loose] = True
            qi, xi = np.nonzero(hit)
            # Where k rows were found the edge moves in to the k-th of them.
            found = np.bincount(qi, minlength=len(part))
            full = np.flatnonzero((found >= self.k) & ~loose)
            if len(full):
                value = rough[qi, xi]
                value = value[np.lexsort((value, qi))]
                kth = value[(np.cumsum(found) - found)[full] + self.k - 1]
                edge[full] = np.minimum(edge[full], kth + slack[full])
            self.edge[own_rows] = edge
            settled = False
            for at in range(0, len(qi), some):  # among equal rows all may be hits
                q, r = qi[at : at + some], xi[at : at + some]
                settled |= self.held.push(own_rows[q], _exact(self.m, x[r], part[q]), ids.take(pa.array(r)))
            if settled:
                at, d = self.held.kth()
                self.edge[at] = np.minimum(self.edge[at], d * d - self.q2[at] if self.m == "l2" else d if self.m == "dot" else np.sqrt(self.q2[at]) * (d - 1))


def _block_top_k(found: DataFrame, names: pa.Array, q: np.ndarray, name_kind: T.DataType, k: int, m: str, id_col: str, vector_col: str, query_id: str) -> DataFrame:
    schema = T.StructType([T.StructField(query_id, name_kind), T.StructField(id_col, found.schema[id_col].dataType), T.StructField("distance", T.DoubleType())])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]
    block = found.sparkSession.sparkContext.broadcast((names, q))  # at most max_query_values numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = block.value
        if not len(names):
            return
        best, size = _Nearest(q, k, m, kinds[1]), 1024
        most = max(64, min(4096, 1_000_000 // max(1, q.shape[1])))
        for b in batches:
            first = 0
            while first < b.num_rows:
                # A short start, which narrows what the rest is held against.
                part = b.slice(first, min(size, most))
                best.add(part.column(0).cast(kinds[1]), matrix(part.column(1)))
                first, size = first + part.num_rows, most
        yield from best.held.batches(names, schema.names)

    return found.select(id_col, vector_col).mapInArrow(run, schema)


def rescored_top_k(
    records: DataFrame, query: Sequence[float], k: int, params: V.ScalarParams, oversample: float = 3.0,
    id_col: str = "id", vector_col: str = "vector", code_col: str | None = None,
) -> DataFrame:
    """L2 search on 8-bit codes for ceil(k * oversample) candidates, then exact
    distances of these.  ``code_col``: codes stored with the records; they are
    computed if there are none."""
    q = check_query(query, k, "l2")
    if oversample < 1:
        raise ValueError("oversample must be at least 1")
    found = records.filter(F.col(vector_col).isNotNull())
    code = F.col(code_col) if code_col else V.quantize(F.col(vector_col), params)
    lit = V.vector(q)
    rough = V.quantized_l2_squared(V.quantize(lit, params), F.lit(sum(x * x for x in q)), code, V.dequantized_norm_squared(code, params), params)
    few = found.select(id_col, vector_col, rough.alias("__rough")).orderBy("__rough", id_col).limit(math.ceil(k * oversample))
    return top_k(few, q, k, "l2", id_col=id_col, vector_col=vector_col)


# ------------------------------------------------ inverted file (approximate)


def train_cells(records: DataFrame, cells: int, vector_col: str = "vector", sample: int = 50_000, rounds: int = 12, seed: int = 42) -> np.ndarray:
    """Centroids of k-means over a bounded sample (``sample`` is the bound)."""
    n = records.filter(F.col(vector_col).isNotNull()).count()
    if not n:
        raise ValueError("no vectors to train on")
    part = records.filter(F.col(vector_col).isNotNull()).select(vector_col)
    if n > sample:
        # 62 bits of a hash, so that the share of no table rounds to nothing.
        part = part.filter(F.pmod(F.xxhash64(F.lit(seed), vector_col), F.lit(2**62)) < max(1, int(sample / n * 2**62)))
    x = np.array([r[0] for r in part.collect()], float)
    if not len(x):  # equal vectors share a hash: of few kinds all may fall out
        x = np.array([records.filter(F.col(vector_col).isNotNull()).select(F.min(vector_col)).first()[0]], float)
    x = x[np.lexsort(x.T[::-1])]
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[: min(cells, len(x))]].copy()
    for _ in range(rounds):
        near = ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
        new = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
        if np.allclose(new, c):
            break
        c = new
    return c


def assign_cells(records: DataFrame, centroids: np.ndarray, vector_col: str = "vector") -> DataFrame:
    """``records`` with ``cell``; written partitioned by it, a search reads only
    the probed cells."""
    at = records.columns.index(vector_col)
    schema = T.StructType([*records.schema.fields, T.StructField("cell", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = np.full(b.num_rows, -1, np.int32)
            good = np.flatnonzero(b.column(at).is_valid().to_numpy(zero_copy_only=False))
            if len(good):
                x = matrix(b.column(at).take(pa.array(good)))
                cell[good] = ((centroids * centroids).sum(1)[None, :] - 2 * x @ centroids.T).argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=[*b.schema.names, "cell"])

    return records.mapInArrow(run, schema)


def probe_top_k(indexed: DataFrame, query: Sequence[float], k: int, centroids: np.ndarray, nprobe: int | None = 8, **kw) -> DataFrame:
    """``top_k`` within the ``nprobe`` closest cells: approximate, exact if all
    are probed.  Without ``nprobe``, L2 only: within the cells that may hold one
    of the k closest, by the distance found in the first cells, the centroids'
    distances and the cells' radii; exact."""
    q = np.array(query, float)
    gaps = np.sqrt(((centroids - q) ** 2).sum(1))
    cells = np.argsort(gaps, kind="stable")
    if nprobe is not None:
        return top_k(indexed.filter(F.col("cell").isin(cells[:nprobe].tolist())), query, k, **kw)
    if V.metric_name(kw.get("metric", "l2")) != "l2":
        raise ValueError("only L2 distances bound the cells: give nprobe")
    radii = cell_radii(indexed, centroids, kw.get("vector_col", "vector"))
    found = [r["distance"] for r in top_k(indexed.filter(F.col("cell").isin(cells[:8].tolist())), query, k, **kw).collect()]
    edge = found[-1] if len(found) == k and math.isfinite(found[-1]) else math.inf
    near = [j for j, r in radii.items() if not gaps[j] - r > edge * (1 + 1e-6) + 1e-6]
    return top_k(indexed.filter(F.col("cell").isin(near)), query, k, **kw)


def cell_radii(indexed: DataFrame, centroids: np.ndarray, vector_col: str = "vector") -> dict[int, float]:
    """The largest distance of a vector to its centroid, by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell = b.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.sqrt(((matrix(b.column(1)) - centroids[cell]) ** 2).sum(1)))], names=["cell", "r"])

    held = indexed.filter(F.col(vector_col).isNotNull()).select("cell", vector_col)
    return {r["cell"]: r["r"] for r in held.mapInArrow(run, "cell int, r double").groupBy("cell").agg(F.max("r").alias("r")).collect()}


def probe_batch(indexed: DataFrame, queries: DataFrame, k: int, centroids: np.ndarray, nprobe: int, metric: str = "l2", id_col: str = "id", vector_col: str = "vector", query_id: str = "query_id", query_col: str = "q", max_query_values: int = 1_000_000) -> DataFrame:
    """(query_id, id, ``distance``, ``rank``) of the k closest records of every
    query within the ``nprobe`` cells whose centroids are closest to it:
    approximate, exact if all cells are probed.  Blocks and ties as in
    ``batch_top_k``; vectors and queries meet only where the cell is probed."""
    if k <= 0 or nprobe <= 0:
        raise ValueError("k and nprobe must be positive")
    m = V.metric_name(metric)
    found = indexed.filter(F.col(vector_col).isNotNull())
    schema = T.StructType([T.StructField(query_id, queries.schema[query_id].dataType), T.StructField(id_col, found.schema[id_col].dataType), T.StructField("distance", T.DoubleType())])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]
    near, asked = None, queries.select(query_id, query_col)
    for names, q in _query_blocks(asked, m, max_query_values, query_values(asked)):
        gaps = (centroids * centroids).sum(1)[None, :] - 2 * q @ centroids.T if len(q) else np.zeros((0, len(centroids)))
        take = min(nprobe, len(centroids))
        cells = np.argpartition(gaps, take - 1, axis=1)[:, :take].astype(np.int32) if len(q) else np.zeros((0, 0), np.int32)
        block = found.sparkSession.sparkContext.broadcast((names, q, cells))  # at most max_query_values numbers

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            names, q, cells = block.value
            if not len(names):
                return
            asking = [np.flatnonzero((cells == j).any(1)) for j in range(len(centroids))]
            best = _Nearest(q, k, m, kinds[1])
            for b in batches:
                cell = b.column(2).to_numpy()
                order = np.argsort(cell, kind="stable")
                for rows in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
                    if len(rows) and len(asking[cell[rows[0]]]):
                        for first in range(0, len(rows), 4096):
                            part = b.take(pa.array(rows[first : first + 4096]))
                            best.add(part.column(0).cast(kinds[1]), matrix(part.column(1)), asking[cell[rows[0]]])
            yield from best.held.batches(names, schema.names)

        part = found.select(id_col, vector_col, F.col("cell").cast("int").alias("cell")).mapInArrow(run, schema)
        near = part if near is None else near.unionAll(part)
    w = Window.partitionBy(query_id).orderBy(F.round("distance", PLACES).asc(), F.col(id_col).asc())
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(query_id, id_col, "distance", "rank")


#: Cells probed of a thousand, by preset.
PRESETS = {"fast": 30, "balanced": 80, "accurate": 200}


def cell_plan(n: int, preset: str = "balanced") -> tuple[int, int]:
    """(cells, nprobe) for n vectors: about sqrt(n) cells."""
    if preset not in PRESETS:
        raise ValueError(f"unknown preset {preset!r}; one of {', '.join(PRESETS)}")
    cells = max(1, min(4096, math.isqrt(max(1, n))))
    return cells, max(1, -(-cells * PRESETS[preset] // 1000))


def save_cells(indexed: DataFrame, centroids: np.ndarray, path: str) -> None:
    """Write an index: vectors by cell, so that a search reads only what it
    probes, and the centroids."""
    indexed.write.partitionBy("cell").parquet(f"{path}/vectors")
    rows = [(j, c.tolist()) for j, c in enumerate(centroids)]
    indexed.sparkSession.createDataFrame(rows, "cell int, centroid array<double>").write.parquet(f"{path}/centroids")


def load_cells(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray]:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # one for each cell
    return spark.read.parquet(f"{path}/vectors"), np.array([r["centroid"] for r in rows])


def cell_statistics(indexed: DataFrame, centroids: np.ndarray) -> dict[str, float]:
    """Cells, those in use, vectors, and the largest cell's share of them."""
    sizes = [r["count"] for r in indexed.filter("cell >= 0").groupBy("cell").count().collect()]
    return {"cells": len(centroids), "used": len(sizes), "vectors": sum(sizes), "largest_share": max(sizes) / sum(sizes) if sizes else 0.0}
