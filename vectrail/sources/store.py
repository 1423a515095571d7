"""A named collection of records: schema, versioned Parquet and change log.

A store is a directory: ``schema`` (numbered, the last is in force), ``versions/N``
(records, edges and, written last, a manifest) and ``log/E`` (the changes of one
call, in force once complete).  Every change is appended to the log before the
call returns, and reading folds the log of the last version into it in one join,
however many calls there were.  A flush writes a new version; its manifest names
the last call it holds, so that older log entries never come back.  A store in
memory is such a directory in the shared folder, gone when it is closed.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tokenizers import preset
from ..functions.vectors import SPARSE, is_finite, metric_name, sparse_literal, train_scalar
from ..operators import dense, fusion, graph, multivector, mutations, sparse, text
from .shared import shared_dir

MODALITIES = ("dense", "sparse", "multi", "text", "graph")
_LOG = "epoch long, seq long, op string, "
#: Log entries, and calls, after which a call ends with a flush.
CHECKPOINT_ENTRIES, CHECKPOINT_CALLS = 10_000, 64


@dataclass(frozen=True)
class CollectionSchema:
    """``None`` or False leaves a modality out.  ``dense``: the dimension, 0 to
    take that of the first vector.  Index hints (``options``) are kept and have
    no effect."""

    name: str = "default"
    metric: str | None = None
    dense: int | None = None
    sparse: bool = False
    multi: int | None = None
    text: str | None = None
    graph: bool = False
    quantization: str | None = None
    pool_factor: int | None = None
    max_tokens: int | None = None
    options: Mapping[str, Any] | None = None

    def checked(self) -> CollectionSchema:
        metric = metric_name(self.metric or ("dot" if self.multi else "l2"))
        if not any((self.dense is not None, self.sparse, self.multi, self.text, self.graph)):
            raise ValueError("a schema needs a modality")
        if self.dense is not None and self.multi:
            raise ValueError("dense and multi exclude each other")
        if self.multi and metric != "dot":
            raise ValueError("multi needs the inner product")
        if self.multi and self.sparse:
            raise ValueError("multi and sparse exclude each other")
        if self.quantization and (metric != "l2" or self.multi):
            raise ValueError("8-bit codes need dense vectors and L2")
        if self.text:
            preset(self.text)
        return CollectionSchema(**{**asdict(self), "metric": metric})


def check_name(name: str) -> str:
    if not re.fullmatch(r"\w+", name or ""):
        raise ValueError("a collection's name has letters, digits and underscores only")
    return name


class Store:
    """The records, edges and searches of one collection.  Failing calls leave
    the state as it was."""

    def __init__(self, spark: SparkSession, schema: CollectionSchema, path: str | None = None, embed: Callable[[list[str]], Sequence[Sequence[float]]] | None = None) -> None:
        self.spark, self.schema, self.path, self.embed = spark, schema.checked(), path, embed
        self._home = path or f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
        self._closed = False
        self.oversample, self.rerank, self.ef_search = 3.0, 20, None
        self.version, self._flushed = 0, 0
        self._base, self._base_edges = spark.createDataFrame([], mutations.RECORD), graph.empty_edges(spark)
        if path:
            self._load()
        self._epoch = max([self._flushed, *self._calls("log"), *self._calls("edge_log")])
        self._pending = self._log("log", mutations.RECORD, self._calls("log")).count() if path else 0
        self._changed()

    def _load(self) -> None:
        """The last version that is complete."""
        fs, p = _fs(self.spark, self._home)
        found = [n for n in _numbers(fs, p, f"{self._home}/versions") if fs.exists(p(f"{self._home}/versions/{n}/manifest.json"))]
        if found:
            self.version = max(found)
            at = f"{self._home}/versions/{self.version}"
            self._flushed = json.loads(_read_text(self.spark, f"{at}/manifest.json"))["epoch"]
            self._base, self._base_edges = (self.spark.read.parquet(f"{at}/{x}") for x in ("records", "edges"))

    # ------------------------------------------------------------------- log

    def _calls(self, name: str) -> list[int]:
        """Calls in the log that are complete and no version holds."""
        fs, p = _fs(self.spark, self._home)
        root = f"{self._home}/{name}"
        return [n for n in _numbers(fs, p, root) if n > self._flushed and fs.exists(p(f"{root}/{n}/_SUCCESS"))]

    def _log(self, name: str, kind: str, calls: list[int]) -> DataFrame:
        if not calls:
            return self.spark.createDataFrame([], _LOG + kind)
        return self.spark.read.schema(_LOG + kind).parquet(*[f"{self._home}/{name}/{n}" for n in calls])

    def _append(self, changes: DataFrame, name: str = "log", kind: str = mutations.RECORD) -> None:
        """Write the changes of one call (``op``, maybe ``seq``, columns); they
        count from here on."""
        fields = T.StructType.fromDDL(kind).fields
        epoch = self._epoch + 1
        seq = F.col("seq").cast("long") if "seq" in changes.columns else F.lit(0).cast("long")
        cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in changes.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
        at = f"{self._home}/{name}/{epoch}"
        changes.select(F.lit(epoch).cast("long").alias("epoch"), seq.alias("seq"), "op", *cols).write.mode("overwrite").parquet(at)  # of a call that didn't end
        self._epoch = epoch
        self._pending += self.spark.read.parquet(at).count()
        self._changed()
        if self._pending >= CHECKPOINT_ENTRIES or epoch - self._flushed >= CHECKPOINT_CALLS:
            self._write_version()

    def _changed(self) -> None:
        """The state: the version with what the log has since."""
        order = F.struct("epoch", "seq")
        entries, links = self._calls("log"), self._calls("edge_log")
        log = self._log("log", mutations.RECORD, entries)
        self._records = mutations.apply_log(self._base, log.withColumn("seq", order)) if entries else self._base
        edges = self._base_edges.withColumns({"epoch": F.lit(0).cast("long"), "seq": F.lit(0).cast("long"), "op": F.lit("add")})
        if links:
            edges = edges.unionByName(self._log("edge_log", graph.EDGE, links))
            value = [c for c in self._base_edges.columns if c not in graph.KEY]
            last = edges.groupBy(*graph.KEY).agg(F.max_by(F.struct("op", "epoch", *value), order).alias("e"))
            edges = last.select(*graph.KEY, "e.*").filter("op = 'add'")
        if entries:
            # A record's deletion takes the edges along that were there.
            gone = log.filter("op = 'delete'").groupBy(F.col("id").alias("__gone")).agg(F.max("epoch").alias("__when"))
            for end in ("from_id", "to_id"):
                edges = edges.join(gone, (F.col(end) == F.col("__gone")) & (F.col("epoch") < F.col("__when")), "left_anti")
        self._edges = edges.select(*self._base_edges.columns)

    def _write_version(self) -> None:
        n = self.version + 1
        at = f"{self._home}/versions/{n}"
        fs, p = _fs(self.spark, self._home)
        fs.delete(p(at), True)  # of a flush that didn't end
        self._records.write.parquet(f"{at}/records")
        self._edges.write.parquet(f"{at}/edges")
        _write_text(self.spark, f"{at}/manifest.json", json.dumps({"epoch": self._epoch}))
        self.version, self._flushed, self._pending = n, self._epoch, 0
        self._base, self._base_edges = self.spark.read.parquet(f"{at}/records"), self.spark.read.parquet(f"{at}/edges")
        for name in ("log", "edge_log"):
            for k in _numbers(fs, p, f"{self._home}/{name}"):
                if k <= self._flushed:
                    fs.delete(p(f"{self._home}/{name}/{k}"), True)
        self._changed()

    def _set_schema(self, **changes: Any) -> None:
        """Another schema, written at once."""
        self.schema = CollectionSchema(**{**asdict(self.schema), **changes})
        fs, p = _fs(self.spark, self._home)
        n = 1 + max(_numbers(fs, p, f"{self._home}/schema"), default=0)
        _write_text(self.spark, f"{self._home}/schema/{n}", json.dumps(asdict(self.schema)))

    # ------------------------------------------------------------- lifecycle

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        if not self._closed:
            if self.path:
                self.flush()
            else:
                fs, p = _fs(self.spark, self._home)
                fs.delete(p(self._home), True)
        self._closed = True

    def _live(self) -> None:
        if self._closed:
            raise RuntimeError("the store is closed")

    def _needs(self, what: str, operation: str) -> None:
        self._live()
        value = getattr(self.schema, what)
        if value is None or value is False:
            raise ValueError(f"{operation} requires {what} in the collection schema")

    @property
    def records(self) -> DataFrame:
        self._live()
        return self._records

    @property
    def edges(self) -> DataFrame:
        self._needs("graph", "edges")
        return self._edges

    def flush(self) -> None:
        """Write the state as a new version, if anything changed."""
        self._live()
        if self._epoch > self._flushed or not self.version:
            self._write_version()

    def compact(self) -> int:
        """Rewrite without deleted records, edges of ids that don't live and old
        versions; the number of records that were deleted since the version."""
        self._live()
        deleted = self._log("log", mutations.RECORD, self._calls("log")).filter("op = 'delete'").select("id").distinct()
        removed = deleted.join(self._records.select("id"), "id", "left_anti").count()
        self._edges = mutations.compact_edges(self._records, self._edges)
        old = self.version
        self._epoch += 1
        self._write_version()
        fs, p = _fs(self.spark, self._home)
        for n in range(1, old + 1):
            fs.delete(p(f"{self._home}/versions/{n}"), True)
        return removed

    def optimize(self, partitions: int | None = None) -> None:
        """Lay the records out by id, for lookups and joins on it."""
        self._live()
        self._records = self._records.repartitionByRange(*([partitions] if partitions else []), "id").sortWithinPartitions("id")
        self._epoch += 1
        self._write_version()

    def append_log(self, changes: DataFrame) -> None:
        """Append (seq, op, record columns) durably; unknown ops are skipped."""
        self._live()
        self._append(changes)

    def persist(self, path: str) -> Store:
        """A copy of the state as a store at ``path``."""
        copy = create(self.spark, path, self.schema, self.embed)
        copy._records, copy._edges = self.records, self._edges
        copy._epoch += 1
        copy._write_version()
        return copy

    def info(self) -> dict[str, Any]:
        row = mutations.statistics(self.records).first().asDict()
        return {**row, "edges": self._edges.count(), "version": self.version, "log_entries": self._pending, "schema": asdict(self.schema), "path": self.path or ":memory:"}

    def bytes(self) -> int:
        """What the store takes on disk, log and old versions included."""
        fs, p = _fs(self.spark, self._home)
        return fs.getContentSummary(p(self._home)).getLength() if fs.exists(p(self._home)) else 0

    def set_options(self, oversample: float | None = None, rerank: int | None = None, ef_search: int | None = None) -> None:
        """Candidates for each wanted hit of ``search_coded`` and of encoded
        multi-vector search; ``ef_search`` is kept as a hint."""
        if (oversample is not None and oversample < 1) or (rerank is not None and rerank < 1) or (ef_search is not None and ef_search < 1):
            raise ValueError("options are at least 1")
        self.oversample, self.rerank, self.ef_search = oversample or self.oversample, rerank or self.rerank, ef_search or self.ef_search

    def __len__(self) -> int:
        return self.records.count()

    # ------------------------------------------------------------- mutations

    def _frame(self, items: DataFrame | Sequence[Mapping[str, Any]]) -> tuple[DataFrame, Column | None]:
        if isinstance(items, DataFrame):
            if "id" not in items.columns:
                items = mutations.with_auto_ids(items)
            return items, F.col("seq") if "seq" in items.columns else None
        rows, documents = [], [i for i in items if i.get("document") is not None]
        vectors = iter(self._embedded([i["document"] for i in documents])) if documents else iter(())
        for n, i in enumerate(items):
            if i.get("document") is not None and i.get("vector") is not None:
                raise ValueError("an item has a vector or a document, not both")
            meta = dict(i.get("metadata") or {})
            words = i.get("text", i.get("document"))
            if words is not None:
                if meta.get("text", words) != words:
                    raise ValueError("metadata.text differs from the text")
                meta["text"] = words
            v = next(vectors) if i.get("document") is not None else i.get("vector")
            pairs = None if i.get("sparse") is None else [{"dim": d, "weight": w} for d, w in sparse_literal(i["sparse"])]
            m = i.get("multi")
            rows.append((i.get("id") or f"__auto_{self._epoch + 1}_{n}", None if v is None else [float(x) for x in v], pairs, None if m is None else [[float(x) for x in t] for t in m], words, json.dumps(meta, ensure_ascii=False), n))
        if not self.schema.text and any(r[4] is not None and r[1] is not None for r in rows):
            self._set_schema(text="default")  # text beside a vector enables its search
        return self.spark.createDataFrame(rows, mutations.RECORD + ", seq int"), F.col("seq")

    def _embedded(self, texts: list[str]) -> Sequence[Sequence[float]]:
        if self.embed is None:
            raise ValueError("documents need an embedding function")
        found = self.embed(texts)
        if len(found) != len(texts):
            raise ValueError("the embedding function gave a different number of rows")
        return found

    def _checked(self, new: DataFrame) -> DataFrame:
        if "vector" in new.columns:
            if self.schema.dense == 0:
                first = new.filter("vector is not null").select(F.size("vector")).first()
                if first:
                    self._set_schema(dense=first[0])
            bad = F.col("vector").isNotNull() & (~is_finite(F.col("vector")) | (F.size("vector") != (self.schema.dense or 0)))
            if not new.filter(bad).isEmpty():
                self._needs("dense", "a vector")
                raise ValueError(f"vectors have {self.schema.dense} finite dimensions")
        if "multi" in new.columns and not new.filter("multi is not null").isEmpty():
            self._needs("multi", "a token matrix")
            width = self.schema.multi
            if not new.filter((F.size("multi") == 0) | F.exists("multi", lambda t: F.size(t) != width)).isEmpty():
                raise ValueError(f"tokens have {width} dimensions and there is at least one")
            most, factor = self.schema.max_tokens, self.schema.pool_factor or 1
            if most and not new.filter(F.size("multi") > most * factor).isEmpty():
                raise ValueError(f"at most {most * factor} tokens before pooling")
            if self.schema.pool_factor or self.schema.max_tokens:
                new = multivector.pool_tokens(new, self.schema.pool_factor or 0, self.schema.max_tokens)
        return new

    def set(self, items: DataFrame | Sequence[Mapping[str, Any]] | str | None = None, vector: Sequence[float] | None = None, metadata: Mapping[str, Any] | None = None, *, ids: Sequence[str] | None = None, vectors: Sequence[Sequence[float]] | None = None, metadatas: Sequence[Mapping[str, Any]] | None = None, documents: Sequence[str] | None = None) -> None:
        """Upsert records: of a frame, a list of dicts, one id with its vector
        and metadata, or parallel lists.  Of a repeated id the last (by ``seq``,
        in a frame that has it) counts.  Items without an id get one of their own."""
        self._live()
        if isinstance(items, str):
            items = [{"id": items, "vector": vector, "metadata": metadata}]
        elif items is None:
            sizes = {len(x) for x in (ids, vectors, metadatas, documents) if x is not None}
            if len(sizes) != 1:
                raise ValueError("parallel lists have one length")
            items = [
                {"id": ids[k] if ids else None, "vector": vectors[k] if vectors else None, "metadata": metadatas[k] if metadatas else None, "document": documents[k] if documents else None}
                for k in range(sizes.pop())
            ]
        new, order = self._frame(items)
        new = self._checked(new)
        self._append((new if order is not None else mutations.last_of_each(new)).withColumn("op", F.lit("upsert")))

    def store(self, id: str, data: Any, metadata: Mapping[str, Any] | None = None) -> None:
        """Upsert one record by what its data are: a vector, a mapping of
        dimensions to weights, or a list of tokens."""
        kind = "sparse" if isinstance(data, Mapping) else "multi" if len(data) and not isinstance(data[0], (int, float)) else "vector"
        self._needs({"vector": "dense"}.get(kind, kind), "store")
        self.set([{"id": id, kind: data, "metadata": metadata}])

    def insert(self, items: DataFrame | Sequence[Mapping[str, Any]]) -> None:
        """An error if an id exists already or comes twice."""
        self._live()
        new = self._checked(self._frame(items)[0])
        mutations.insert(self._records, new)
        self._append(new.withColumn("op", F.lit("upsert")))

    def update(self, id: str, vector=None, metadata: Mapping[str, Any] | None = None, text: str | None = None) -> None:
        """One record's payloads; metadata is replaced whole and keeps its text,
        a text goes to both; an error if there is no such id."""
        if metadata is not None and text is not None and metadata.get("text", text) != text:
            raise ValueError("metadata.text differs from the text")
        old = self.records.filter(F.col("id") == id).select("metadata").first()
        if old is None:
            raise KeyError(id)
        meta = json.loads(old[0] or "{}") if metadata is None else dict(metadata)
        if text is not None:
            meta["text"] = text
        row = (id, None if vector is None else [float(x) for x in vector], text, json.dumps(meta, ensure_ascii=False), "upsert")
        self._append(self._checked(self.spark.createDataFrame([row], "id string, vector array<float>, text string, metadata string, op string")))

    def delete(self, ids: Sequence[str] | DataFrame) -> int:
        """The number of records that were there; an error for a single id that
        wasn't.  Edges of the ids go as well."""
        gone = ids.select("id") if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in ids], "id string")
        n = mutations.delete_count(self.records, gone)
        if isinstance(ids, (list, tuple)) and len(ids) == 1 and not n:
            raise KeyError(ids[0])
        self._append(gone.distinct().withColumn("op", F.lit("delete")))
        return n

    def delete_by_filter(self, where: Mapping[str, Any]) -> int:
        """Delete what matches; records without metadata never do."""
        return self.delete(self.records.filter(mutations.deletable(self.records, where)).select("id"))

    def count(self, where: Mapping[str, Any] | None = None) -> int:
        return self.records.count() if not where else mutations.count_by_filter(self.records, where)

    def merge_from(self, other: Store, prefix: str | None = None) -> int:
        """Other's records whose ids are new here; their number."""
        if other is self:
            raise ValueError("a store can't be merged with itself")
        if self.schema.dense and other.schema.dense and self.schema.dense != other.schema.dense:
            raise ValueError("the stores have different dimensions")
        theirs = other.records.select("id", "vector", "sparse", "metadata")
        if prefix:
            theirs = theirs.withColumn("id", F.concat(F.lit(prefix), F.col("id")))
        before = self.records.count()
        self._append(theirs.join(self._records.select("id"), "id", "left_anti").withColumn("op", F.lit("upsert")))
        return self._records.count() - before

    # --------------------------------------------------------------- lookups

    def ids(self) -> Iterator[str]:
        return (r[0] for r in self.records.select("id").orderBy("id").toLocalIterator())

    def items(self) -> Iterator[Row]:
        """Records with a dense vector."""
        return self.records.filter("vector is not null").toLocalIterator()

    def get(self, id: str) -> Row | None:
        return self.records.filter((F.col("id") == id) & F.col("vector").isNotNull()).first()

    def get_metadata(self, id: str) -> dict | None:
        r = self.records.filter(F.col("id") == id).select("metadata").first()
        return None if r is None else json.loads(r[0] or "{}")

    def _payload(self, id: str, column: str) -> Any:
        r = self.records.filter(F.col("id") == id).select(column).first()
        return None if r is None else r[0]

    def get_vector(self, id: str) -> list[float] | None:
        return self._payload(id, "vector")

    def get_tokens(self, id: str) -> list[list[float]] | None:
        return self._payload(id, "multi")

    def get_data(self, id: str) -> Any:
        """The record's vector, else its tokens, else its sparse weights."""
        r = self.records.filter(F.col("id") == id).select("vector", "multi", "sparse").first()
        if r is None:
            return None
        return r[0] if r[0] is not None else r[1] if r[1] is not None else None if r[2] is None else {p["dim"]: p["weight"] for p in r[2]}

    def get_batch(self, ids: Sequence[str]) -> list[Row | None]:
        asked = self.spark.createDataFrame(list(enumerate(ids)), "position int, id string")
        rows = mutations.lookup(self.records.withColumn("__here", F.lit(True)), asked).orderBy("position").collect()
        return [r if r["__here"] else None for r in rows]

    def __contains__(self, id: str) -> bool:
        return not self.records.filter(F.col("id") == id).isEmpty()

    # -------------------------------------------------------------- searches

    def _query(self, q: Sequence[float] | str) -> Sequence[float]:
        return self._embedded([q])[0] if isinstance(q, str) else q

    def search(self, query: Sequence[float] | str, k: int = 10, where: Mapping[str, Any] | None = None, max_distance: float | None = None, ef: int | None = None) -> DataFrame:
        self._needs("dense", "search")
        q = dense.check_query(self._query(query), k, self.schema.metric, self.schema.dense or None)
        return dense.top_k(self._records, q, k, self.schema.metric, where or None, max_distance, keep=["metadata"], ef=ef)

    def search_batch(self, queries: DataFrame, k: int = 10, where: Mapping[str, Any] | None = None, max_distance: float | None = None) -> DataFrame:
        self._needs("dense", "search_batch")
        return dense.batch_top_k(self._records, queries, k, self.schema.metric, where or None, max_distance)

    # ----------------------------------------------------------------- index

    def build_index(self, preset: str = "balanced", cells: int | None = None) -> dict[str, float]:
        """Cells over the vectors as they are now, written beside the records;
        its statistics.  Records that change later make it stale."""
        self._needs("dense", "build_index")
        self._live()
        held = self._records.filter("vector is not null").select("id", "vector", "metadata")
        planned, _ = dense.cell_plan(held.count(), preset)
        centroids = dense.train_cells(held, cells or planned)
        fs, p = _fs(self.spark, self._home)
        at = f"{self._home}/index/{self._epoch}"
        fs.delete(p(f"{self._home}/index"), True)
        dense.save_cells(dense.assign_cells(held, centroids), centroids, at)
        return self.index_statistics()

    def _index(self) -> tuple[DataFrame, Any]:
        fs, p = _fs(self.spark, self._home)
        at = f"{self._home}/index/{self._epoch}"
        if not fs.exists(p(f"{at}/centroids/_SUCCESS")):
            raise ValueError("no index of the records as they are: call build_index")
        return dense.load_cells(self.spark, at)

    def index_statistics(self) -> dict[str, float]:
        return dense.cell_statistics(*self._index())

    def search_index(self, query: Sequence[float] | str, k: int = 10, where: Mapping[str, Any] | None = None, preset: str = "balanced", nprobe: int | None = None) -> DataFrame:
        """The k closest of those that match within the probed cells; the filter
        comes before the top k."""
        self._needs("dense", "search_index")
        q = dense.check_query(self._query(query), k, self.schema.metric, self.schema.dense or None)
        indexed, centroids = self._index()
        probes = nprobe or max(1, -(-len(centroids) * dense.PRESETS[preset] // 1000))
        return dense.probe_top_k(indexed, q, k, centroids, probes, metric=self.schema.metric, where=where or None, keep=["metadata"])

    def search_sparse(self, query, k: int = 10, where: Mapping[str, Any] | None = None) -> DataFrame:
        self._needs("sparse", "search_sparse")
        return sparse.search_sparse(self._records, query, k, where or None)

    def search_text(self, words: str, k: int = 10, where: Mapping[str, Any] | None = None) -> DataFrame:
        self._needs("text", "search_text")
        return text.bm25(self._records, words, k, self.schema.text, where or None)

    def search_hybrid(self, query: Sequence[float] | str, words: str | None = None, k: int = 10, where: Mapping[str, Any] | None = None, alpha: float = 0.5, rrf_k: int = 60, subscores: bool = False) -> DataFrame:
        self._needs("dense", "search_hybrid")
        self._needs("text", "search_hybrid")
        words = words if words is not None else query if isinstance(query, str) else ""
        return fusion.hybrid_text(self._records, self._query(query), words, k, where or None, alpha, rrf_k, subscores, self.schema.metric, self.schema.text)

    def search_hybrid_sparse(self, query: Sequence[float], terms, k: int = 10, where: Mapping[str, Any] | None = None, alpha: float = 0.5) -> DataFrame:
        self._needs("dense", "search_hybrid_sparse")
        self._needs("sparse", "search_hybrid_sparse")
        return fusion.hybrid_sparse(self._records, query, terms, k, alpha, where or None, self.schema.metric)

    def search_coded(self, query: Sequence[float], k: int = 10) -> DataFrame:
        """L2 search on 8-bit codes for k * ``oversample`` candidates, then their
        exact distances."""
        self._needs("dense", "search_coded")
        if not self.schema.quantization:
            raise ValueError("search_coded requires quantization in the collection schema")
        return dense.rescored_top_k(self._records, query, k, train_scalar(self._records), self.oversample)

    def search_multi(self, query: Sequence[Sequence[float]], k: int = 10, where: Mapping[str, Any] | None = None, max_distance: float | None = None, explain: bool = False, mode: str = "exact") -> DataFrame:
        """``mode``: exact, ``rerank`` (the best by the encodings, ordered by
        MaxSim) or ``encoded`` (by the encodings alone)."""
        self._needs("multi", "search_multi")
        multivector.check_tokens(query, self.schema.multi)
        if mode not in ("exact", "rerank", "encoded"):
            raise ValueError("mode is exact, rerank or encoded")
        if mode != "exact":
            config = multivector.EncodingConfig(projection=None)
            held = self._records.filter("multi is not null") if not where else self._records.filter(dense.predicate(self._records, where)).filter("multi is not null")
            encoded = multivector.encode_documents(held, self.schema.multi, config)
            return multivector.encoded_top_k(encoded, query, k, multivector.Encoder(self.schema.multi, config), self.rerank if mode == "rerank" else None)
        found = self._records if not where else self._records.filter(dense.predicate(self._records, where))
        return multivector.maxsim_top_k(found, query, k, max_distance, explain)

    def search_text_rerank(self, words: str, query: Sequence[Sequence[float]], k: int = 10, candidates: int = 10_000) -> DataFrame:
        self._needs("text", "search_text_rerank")
        self._needs("multi", "search_text_rerank")
        return fusion.text_rerank(self._records, words, query, k, candidates, self.schema.text)

    def search_sparse_rerank(self, terms, query: Sequence[Sequence[float]], k: int = 10, candidates: int = 10_000) -> DataFrame:
        return fusion.sparse_rerank(self.records, terms, query, k, candidates)

    def query(self, q: Any, k: int = 10, **options: Any) -> DataFrame:
        """The search that fits the query: a mapping is sparse, a list of lists
        a token matrix, a string is embedded, or BM25 where there is nothing to
        embed it with."""
        if isinstance(q, Mapping):
            return self.search_sparse(q, k, **options)
        if isinstance(q, str) and self.embed is None:
            return self.search_text(q, k, **options)
        if not isinstance(q, str) and len(q) and not isinstance(q[0], (int, float)):
            return self.search_multi(q, k, **options)
        return self.search(q, k, **options)

    # ----------------------------------------------------------------- graph

    def enable_graph(self) -> None:
        self._set_schema(graph=True)

    def enable_text(self, tokenizer: str = "default") -> None:
        self._set_schema(text=preset(tokenizer))

    def edges_involving(self, node: str) -> DataFrame:
        return graph.edges_involving(self.edges, node)

    def get_edge(self, from_id: str, to_id: str, edge_type: str) -> Row | None:
        return graph.get_edge(self.edges, from_id, to_id, edge_type).first()

    def has_edges(self, node: str) -> bool:
        return not self.edges_involving(node).isEmpty()

    def remove_all_for(self, node: str) -> int:
        """Remove the node's edges; their number."""
        found = self.edges_involving(node)
        n = found.count()
        self._append(found.withColumn("op", F.lit("remove")), "edge_log", graph.EDGE)
        return n

    def get_edges(self, node: str, direction: str = "both", edge_type: str | None = None) -> DataFrame:
        return graph.get_edges(self.edges, node, direction, edge_type)

    def neighbors(self, node: str, direction: str = "outgoing", edge_type: str | None = None) -> DataFrame:
        return graph.neighbors(self.edges, node, direction, edge_type)

    def node_degree(self, node: str, direction: str = "both", edge_type: str | None = None) -> int:
        return graph.node_degree(self.edges, node, direction, edge_type)

    def traverse(self, start: str, max_depth: int = 1, direction: str = "outgoing", edge_type: str | None = None) -> DataFrame:
        return graph.traverse(self.edges, start, max_depth, direction, edge_type)

    def traverse_edges(self, start: str, max_depth: int = 1, direction: str = "outgoing", edge_type: str | None = None) -> DataFrame:
        return graph.traverse_edges(self.edges, start, max_depth, direction, edge_type)

    def shortest_path(self, start: str, end: str, max_depth: int = 10, direction: str = "outgoing", edge_type: str | None = None) -> list[str] | None:
        return graph.shortest_path(self.edges, start, end, max_depth, direction, edge_type)

    def has_path(self, start: str, end: str, max_depth: int = 10, direction: str = "outgoing", edge_type: str | None = None) -> bool:
        return graph.has_path(self.edges, start, end, max_depth, direction, edge_type)

    def expand_graph(self, seeds: Sequence[str], max_depth: int = 1, direction: str = "outgoing", edge_type: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Nodes in order, and the edges between them, around all seeds."""
        nodes, edges = graph.subgraph(self.edges, seeds, max_depth, direction, edge_type)
        return nodes.orderBy("id"), edges

    def subgraph(self, start: str, max_depth: int = 1, direction: str = "outgoing", edge_type: str | None = None) -> tuple[DataFrame, DataFrame]:
        return self.expand_graph([start], max_depth, direction, edge_type)

    def expand(self, found: DataFrame, direction: str = "outgoing", edge_type: str | None = None) -> DataFrame:
        """A search's ids and their direct neighbours."""
        return graph.expand(self.edges, found, direction, edge_type)

    def edge_types(self) -> list[str]:
        return sorted(r[0] for r in graph.edge_types(self.edges).collect())

    def node_ids(self) -> DataFrame:
        return graph.node_ids(self.edges)

    def add_edges(self, edges: DataFrame | Sequence[Mapping[str, Any]]) -> int:
        """Upsert edges; the number of new ones."""
        self._needs("graph", "add_edges")
        order = None
        if not isinstance(edges, DataFrame):
            rows = [(e["from_id"], e["to_id"], e["edge_type"], float(e.get("weight", 1.0)), json.dumps(e.get("metadata") or {}), n) for n, e in enumerate(edges)]
            edges, order = self.spark.createDataFrame(rows, graph.EDGE + ", seq int"), F.col("seq")
        n = graph.count_new(self._edges, edges)
        least = F.row_number().over(Window.partitionBy(*graph.KEY).orderBy(F.col("weight").asc() if order is None else order.desc()))
        self._append(edges.withColumn("__r", least).filter("__r = 1").withColumn("op", F.lit("add")), "edge_log", graph.EDGE)
        return n

    def remove_edge(self, from_id: str, to_id: str, edge_type: str) -> bool:
        self._needs("graph", "remove_edge")
        there = not graph.get_edge(self._edges, from_id, to_id, edge_type).isEmpty()
        self._append(self.spark.createDataFrame([(from_id, to_id, edge_type, "remove")], "from_id string, to_id string, edge_type string, op string"), "edge_log", graph.EDGE)
        return there


# ------------------------------------------------------------ opening, naming


def _fs(spark: SparkSession, path: str):
    """Hadoop's file system of a path, so that any scheme works."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path
    return p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _write_text(spark: SparkSession, path: str, value: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p(path), True)
    out.write(bytearray(value.encode()))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    # Not by the text source: it skips no empty lines, but lists the folder.
    return spark.sparkContext.wholeTextFiles(path).values().first()


def _numbers(fs, p, path: str) -> list[int]:
    return [int(x.getPath().getName()) for x in fs.listStatus(p(path)) if x.getPath().getName().isdigit()] if fs.exists(p(path)) else []


def create(spark: SparkSession, path: str, schema: CollectionSchema, embed=None) -> Store:
    """A new store; ``:memory:`` is not kept.  An error if it exists."""
    schema = schema.checked()
    if path == ":memory:":
        return Store(spark, schema, embed=embed)
    fs, p = _fs(spark, path)
    if fs.exists(p(f"{path}/schema")):
        raise FileExistsError(path)
    _write_text(spark, f"{path}/schema/1", json.dumps(asdict(schema)))
    return Store(spark, schema, path, embed)


def open_store(spark: SparkSession, path: str, schema: CollectionSchema | None = None, embed=None, **hints: Any) -> Store:
    """An existing store, its log folded in; with a schema one is created where
    there is none.  ``hints``: options to keep where it is created."""
    if schema is not None and hints:
        schema = replace(schema, options={**(schema.options or {}), **hints})
    if path == ":memory:":
        return Store(spark, schema or CollectionSchema(dense=0), embed=embed)
    fs, p = _fs(spark, path)
    if not fs.exists(p(f"{path}/schema")):
        if schema is None:
            raise FileNotFoundError(path)
        return create(spark, path, schema, embed)
    last = max(_numbers(fs, p, f"{path}/schema"))
    return Store(spark, CollectionSchema(**json.loads(_read_text(spark, f"{path}/schema/{last}"))), path, embed)


def collection(spark: SparkSession, root: str, name: str, schema: CollectionSchema) -> Store:
    return open_store(spark, f"{root}/collections/{check_name(name)}", schema)


def collections(spark: SparkSession, root: str) -> list[str]:
    fs, p = _fs(spark, root)
    if not fs.exists(p(f"{root}/collections")):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p(f"{root}/collections")))


def delete_collection(spark: SparkSession, root: str, name: str) -> bool:
    fs, p = _fs(spark, root)
    return fs.delete(p(f"{root}/collections/{check_name(name)}"), True)


__all__ = ["SPARSE", "CollectionSchema", "Store", "collection", "collections", "create", "delete_collection", "open_store"]
