"""Keyed upserts, updates, deletes and merges as DataFrame transforms.

A record is a row with ``id`` and any of ``vector``, ``sparse``, ``multi``,
``text`` and ``metadata`` (JSON).  Every function returns the new state.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dense import predicate
from .graph import drop_orphans

PAYLOADS = ("vector", "sparse", "multi", "text")
RECORD = "id string, vector array<float>, sparse array<struct<dim:bigint,weight:float>>, multi array<array<float>>, text string, metadata string"


def last_of_each(changes: DataFrame, order: Column | None = None, id_col: str = "id") -> DataFrame:
    """The last row of each id by ``order``; without an order, any one."""
    if order is None:
        return changes.dropDuplicates([id_col])
    return changes.withColumn("__r", F.row_number().over(Window.partitionBy(id_col).orderBy(order.desc()))).filter("__r = 1").drop("__r")


def upsert(records: DataFrame, changes: DataFrame, order: Column | None = None, id_col: str = "id") -> DataFrame:
    """Records with the changes applied.  A changed record takes the new
    metadata ({} if there is none) and keeps each payload that the change lacks.
    One shuffle of either side, by id."""
    new = last_of_each(changes, order, id_col)
    both = records.alias("o").join(new.alias("n"), F.col(f"o.{id_col}") == F.col(f"n.{id_col}"), "full_outer")
    cols = []
    for c in records.columns:
        if c == id_col:
            cols.append(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c))
        elif c not in new.columns:
            cols.append((F.when(F.col(f"n.{id_col}").isNull(), F.col(f"o.{c}")).otherwise(F.lit("{}")) if c == "metadata" else F.col(f"o.{c}")).alias(c))
        elif c == "metadata":
            empty = F.lit("{}") if dict(records.dtypes)[c] == "string" else F.parse_json(F.lit("{}"))
            cols.append(F.when(F.col(f"n.{id_col}").isNotNull(), F.coalesce(F.col(f"n.{c}"), empty)).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            cols.append(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c))
    return both.select(*cols)


def insert(records: DataFrame, new: DataFrame, id_col: str = "id") -> DataFrame:
    """Union; an error if an id exists already or comes twice."""
    clash = new.groupBy(id_col).count().filter("count > 1").select(id_col).union(new.join(records.select(id_col), id_col, "left_semi").select(id_col))
    found = clash.first()
    if found:
        raise ValueError(f"id {found[0]!r} exists already")
    return records.unionByName(new, allowMissingColumns=True).select(*records.columns)


def with_auto_ids(rows: DataFrame, prefix: str = "__auto_", id_col: str = "id") -> DataFrame:
    """Ids for rows that have none: unique over calls, and made without a
    shuffle; anew at each evaluation, so write the rows before they are used
    twice."""
    made = F.concat(F.lit(prefix), F.expr("uuid()"))
    return rows.withColumn(id_col, F.coalesce(F.col(id_col), made) if id_col in rows.columns else made)


def update(records: DataFrame, id: Any, vector=None, metadata: str | None = None, text: str | None = None, id_col: str = "id") -> DataFrame:
    """One record's payloads; metadata is replaced whole; an error if there is
    no such id."""
    me = F.col(id_col) == F.lit(id)
    if records.filter(me).isEmpty():
        raise KeyError(id)
    out = records
    for name, value in (("vector", None if vector is None else F.array(*[F.lit(float(x)) for x in vector]).cast("array<float>")), ("metadata", None if metadata is None else F.lit(metadata)), ("text", None if text is None else F.lit(text))):
        if value is not None:
            out = out.withColumn(name, F.when(me, value).otherwise(F.col(name)))
    return out


def delete(records: DataFrame, ids: DataFrame, edges: DataFrame | None = None, id_col: str = "id") -> tuple[DataFrame, DataFrame | None]:
    """Records without the ids, and edges without those that touch them."""
    gone = ids.select(F.col(id_col).alias("__gone")).distinct()
    kept = records.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
    if edges is not None:
        for end in ("from_id", "to_id"):
            edges = edges.join(gone, F.col(end) == F.col("__gone"), "left_anti")
    return kept, edges


def delete_count(records: DataFrame, ids: DataFrame, id_col: str = "id") -> int:
    return records.join(ids.select(id_col).distinct(), id_col, "left_semi").count()


def deletable(records: DataFrame, where: Mapping[str, Any] | Column) -> Column:
    """Whether a record matches for deletion: one without metadata never does,
    whatever the filter, so that ``$ne`` and ``$not`` don't sweep it away."""
    match = predicate(records, where)
    return match & F.col("metadata").isNotNull() if "metadata" in records.columns else match


def delete_by_filter(records: DataFrame, where: Mapping[str, Any] | Column) -> DataFrame:
    """Records that don't match (see ``deletable``)."""
    return records.filter(~deletable(records, where))


def count_by_filter(records: DataFrame, where: Mapping[str, Any] | Column) -> int:
    return records.filter(predicate(records, where)).count()


def merge(records: DataFrame, other: DataFrame, prefix: str | None = None, id_col: str = "id") -> DataFrame:
    """Records and those of ``other`` whose ids (with the prefix) are new."""
    theirs = other if not prefix else other.withColumn(id_col, F.concat(F.lit(prefix), F.col(id_col)))
    return records.unionByName(theirs.join(records.select(id_col), id_col, "left_anti"), allowMissingColumns=True).select(*records.columns)


def lookup(records: DataFrame, ids: DataFrame, id_col: str = "id", position_col: str = "position") -> DataFrame:
    """A row for each asked (position, id), in any order, with nulls where there
    is no such record."""
    return ids.join(records, id_col, "left")


def compact_edges(records: DataFrame, edges: DataFrame, id_col: str = "id") -> DataFrame:
    return drop_orphans(edges, records, id_col)


def apply_log(records: DataFrame, log: DataFrame, id_col: str = "id") -> DataFrame:
    """Replay of a change log (``seq``, ``op``, record columns): the last entry
    of an id decides; ``op`` is upsert or delete, others are skipped.  Payloads
    carry over entry by entry, up to the last delete."""
    known = log.filter(F.col("op").isin("upsert", "delete"))
    w = Window.partitionBy(id_col)
    dead = known.withColumn("__dead", F.max(F.when(F.col("op") == "delete", F.col("seq"))).over(w))
    live = dead.filter(F.col("__dead").isNull() | (F.col("seq") > F.col("__dead")))
    payload = [c for c in records.columns if c not in (id_col, "metadata") and c in log.columns]
    folded = live.groupBy(id_col).agg(F.max("seq").alias("__seq"), *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in payload], *([F.max_by("metadata", "seq").alias("metadata")] if {"metadata"} <= {*records.columns} & {*log.columns} else []))
    cleared = records.join(dead.filter("__dead is not null").select(id_col).distinct(), id_col, "left_anti").select(*records.columns)
    return upsert(cleared, folded.drop("__seq"), id_col=id_col)


def statistics(records: DataFrame) -> DataFrame:
    """One row: how many records have each payload, and the vectors' bytes."""
    return records.agg(
        F.count("*").alias("records"), *[F.count(c).alias(f"{c}s") for c in PAYLOADS if c in records.columns],
        F.coalesce(F.sum(F.size("vector").cast("long") * 4), F.lit(0)).alias("vector_bytes"),
    )
