"""Vector-store interfaces of common retrieval frameworks, without importing
them: objects with their methods' names, over a ``Store``."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import functions as F

from ..functions.filters import from_triples
from ..operators.dense import predicate
from .store import Store


@dataclass
class Document:
    page_content: str
    metadata: dict[str, Any] = field(default_factory=dict)
    id: str | None = None


class RetrievalStore:
    """add_texts, similarity_search and their kin.  The store needs an
    embedding function."""

    def __init__(self, store: Store) -> None:
        self.store = store

    @classmethod
    def from_texts(cls, store: Store, texts: Sequence[str], metadatas: Sequence[Mapping[str, Any]] | None = None, ids: Sequence[str] | None = None) -> RetrievalStore:
        made = cls(store)
        made.add_texts(texts, metadatas, ids)
        return made

    @classmethod
    def from_documents(cls, store: Store, documents: Sequence[Document]) -> RetrievalStore:
        made = cls(store)
        made.add_documents(documents)
        return made

    def add_texts(self, texts: Sequence[str], metadatas: Sequence[Mapping[str, Any]] | None = None, ids: Sequence[str] | None = None) -> list[str]:
        names = list(ids) if ids else [uuid.uuid4().hex for _ in texts]
        metas = metadatas or [{}] * len(texts)
        self.store.set([{"id": i, "document": t, "metadata": dict(m)} for i, t, m in zip(names, texts, metas)])
        return names

    def add_documents(self, documents: Sequence[Document]) -> list[str]:
        return self.add_texts([d.page_content for d in documents], [d.metadata for d in documents], [d.id or uuid.uuid4().hex for d in documents])

    def similarity_search_with_score(self, query: str | Sequence[float], k: int = 4, filter: Mapping[str, Any] | None = None) -> list[tuple[Document, float]]:
        out = []
        for r in self.store.search(query, k, filter).collect():
            meta = json.loads(r["metadata"] or "{}")
            out.append((Document(meta.pop("text", ""), meta, r["id"]), r["distance"]))
        return out

    def similarity_search(self, query: str | Sequence[float], k: int = 4, filter: Mapping[str, Any] | None = None) -> list[Document]:
        return [d for d, _ in self.similarity_search_with_score(query, k, filter)]

    def similarity_search_by_vector(self, embedding: Sequence[float], k: int = 4, filter: Mapping[str, Any] | None = None) -> list[Document]:
        return self.similarity_search(embedding, k, filter)

    def query(self, embedding: Sequence[float], k: int = 4, filters: list[Mapping[str, Any]] | None = None, condition: str = "and") -> list[tuple[str, float]]:
        """Ids and scores, under filters of key, operator and value."""
        where = from_triples(filters, condition) if filters else None
        return [(r["id"], r["score"]) for r in self.store.search(embedding, k, where).collect()]

    def get_by_ids(self, ids: Sequence[str]) -> list[Document]:
        found = []
        for r in self.store.get_batch(ids):
            if r is not None:
                meta = json.loads(r["metadata"] or "{}")
                found.append(Document(meta.pop("text", ""), meta, r["id"]))
        return found

    def delete(self, ids: Sequence[str]) -> bool:
        return self.store.delete(self.store.spark.createDataFrame([(i,) for i in ids], "id string")) > 0


@dataclass
class Node:
    """A piece of a source document, ``ref_doc_id``, with its embedding."""

    node_id: str
    text: str
    embedding: Sequence[float] | None = None
    metadata: dict[str, Any] = field(default_factory=dict)
    ref_doc_id: str | None = None


class NodeStore:
    """add, delete, delete_nodes and query over nodes.  The source document's id
    is kept in the metadata."""

    REF = "ref_doc_id"

    def __init__(self, store: Store) -> None:
        self.store = store

    def add(self, nodes: Sequence[Node]) -> list[str]:
        items = []
        for n in nodes:
            meta = {**n.metadata, **({} if n.ref_doc_id is None else {self.REF: n.ref_doc_id})}
            items.append({"id": n.node_id, "metadata": meta, **({"document": n.text} if n.embedding is None else {"vector": n.embedding, "text": n.text})})
        self.store.set(items)
        return [n.node_id for n in nodes]

    def delete(self, ref_doc_id: str) -> int:
        """Delete all nodes of a source document."""
        return self.store.delete_by_filter({self.REF: ref_doc_id})

    def delete_nodes(self, node_ids: Sequence[str] | None = None, filters: list[Mapping[str, Any]] | None = None, condition: str = "and") -> int:
        """Delete by ids, by filters, or nodes of both."""
        if not node_ids and not filters:
            raise ValueError("give ids or filters")
        found = self.store.records
        if filters:
            found = found.filter(predicate(found, from_triples(filters, condition)))
        if node_ids:
            found = found.filter(F.col("id").isin(list(node_ids)))
        return self.store.delete(found.select("id"))

    def query(self, embedding: Sequence[float] | str, k: int = 4, filters: list[Mapping[str, Any]] | None = None, condition: str = "and") -> list[tuple[Node, float]]:
        """Nodes and scores, closest first."""
        out = []
        where = from_triples(filters, condition) if filters else None
        for r in self.store.search(embedding, k, where).collect():
            meta = json.loads(r["metadata"] or "{}")
            out.append((Node(r["id"], meta.pop("text", ""), None, meta, meta.pop(self.REF, None)), r["score"]))
        return out
