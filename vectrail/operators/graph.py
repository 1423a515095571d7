"""Typed directed edges and bounded traversals.

An edge table has ``from_id``, ``to_id``, ``edge_type``, ``weight`` and maybe
``metadata``; its key is the first three.  A traversal is one join a level,
against the frontier alone; every level is written to the shared folder, so
that plans stay short.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import written

KEY = ["from_id", "to_id", "edge_type"]
DIRECTIONS = ("outgoing", "incoming", "both")
EDGE = "from_id string, to_id string, edge_type string, weight float, metadata string"


def empty_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EDGE)


def _direction(d: str) -> str:
    if d not in DIRECTIONS:
        raise ValueError(f"direction is one of {', '.join(DIRECTIONS)}")
    return d


def _typed(edges: DataFrame, edge_type: str | None) -> DataFrame:
    return edges if edge_type is None else edges.filter(F.col("edge_type") == edge_type)


def add_edges(edges: DataFrame, new: DataFrame, order: Column | None = None) -> DataFrame:
    """Upsert by key: new edges replace old ones, later new ones earlier ones
    (by ``order``; without it the one of least weight stays of a repeated key)."""
    w = Window.partitionBy(*KEY).orderBy(F.col("weight").asc() if order is None else order.desc())
    fresh = new.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
    return edges.join(fresh.select(*KEY), KEY, "left_anti").select(*edges.columns).unionByName(fresh, allowMissingColumns=True)


def count_new(edges: DataFrame, new: DataFrame) -> int:
    return new.select(*KEY).distinct().join(edges.select(*KEY), KEY, "left_anti").count()


def remove_edge(edges: DataFrame, from_id: str, to_id: str, edge_type: str) -> DataFrame:
    return edges.filter(~((F.col("from_id") == from_id) & (F.col("to_id") == to_id) & (F.col("edge_type") == edge_type)))


def edges_involving(edges: DataFrame, node: str) -> DataFrame:
    return edges.filter((F.col("from_id") == node) | (F.col("to_id") == node))


def remove_node(edges: DataFrame, node: str) -> DataFrame:
    return edges.filter((F.col("from_id") != node) & (F.col("to_id") != node))


def get_edge(edges: DataFrame, from_id: str, to_id: str, edge_type: str) -> DataFrame:
    return edges.filter((F.col("from_id") == from_id) & (F.col("to_id") == to_id) & (F.col("edge_type") == edge_type))


def get_edges(edges: DataFrame, node: str, direction: str = "both", edge_type: str | None = None) -> DataFrame:
    """The node's edges; ``both`` has a self-loop once."""
    out, into = F.col("from_id") == node, F.col("to_id") == node
    d = _direction(direction)
    return _typed(edges, edge_type).filter(out if d == "outgoing" else into if d == "incoming" else out | into)


def _steps(edges: DataFrame, direction: str, edge_type: str | None) -> DataFrame:
    """(src, dst, edge): every edge as a step; ``both`` as two."""
    e = _typed(edges, edge_type)
    edge = F.struct(*[F.col(c) for c in (*KEY, "weight") if c in e.columns]).alias("edge")
    d = _direction(direction)
    out = e.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), edge)
    into = e.select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"), edge)
    return out if d == "outgoing" else into if d == "incoming" else out.unionAll(into)


def neighbors(edges: DataFrame, node: str, direction: str = "outgoing", edge_type: str | None = None) -> DataFrame:
    """(id): one row for each step, so a neighbour may come more than once."""
    return _steps(edges, direction, edge_type).filter(F.col("src") == node).select(F.col("dst").alias("id"))


def node_degree(edges: DataFrame, node: str, direction: str = "both", edge_type: str | None = None) -> int:
    return get_edges(edges, node, direction, edge_type).count()


def degrees(edges: DataFrame, direction: str = "both", edge_type: str | None = None) -> DataFrame:
    """(id, ``degree``) of every node with an edge; a self-loop counts once."""
    s = _steps(edges, direction, edge_type)
    if direction == "both":
        s = s.distinct()
    return s.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def _reach(edges: DataFrame, seeds: DataFrame, depth: int, direction: str, edge_type: str | None, stop: str | None = None) -> DataFrame:
    """(start, id, depth, edge, path) of every node within ``depth`` steps of
    each start, which itself has depth 0.  Of several ways to a node at one
    level the least edge (from, to, type) counts, and the least path."""
    steps = _steps(edges, direction, edge_type)
    seen = seeds.select(F.col("id").alias("start"), F.col("id").alias("id"), F.lit(0).alias("depth"), F.lit(None).cast(steps.schema["edge"].dataType).alias("edge"), F.array("id").alias("path")).distinct()
    seen = written(seen, "graph-level")
    levels, frontier = [seen], seen
    for level in range(1, depth + 1):
        if stop is not None and not frontier.filter(F.col("id") == stop).isEmpty():
            break
        ways = frontier.select("start", F.col("id").alias("src"), "path").join(steps, "src")
        fresh = ways.groupBy("start", F.col("dst").alias("id")).agg(F.min("edge").alias("edge"), F.min(F.concat("path", F.array("dst"))).alias("path"))
        known = levels[0]
        for x in levels[1:]:
            known = known.unionAll(x)
        frontier = written(fresh.join(known.select("start", "id"), ["start", "id"], "left_anti").select("start", "id", F.lit(level).alias("depth"), "edge", "path"), "graph-level")
        if frontier.isEmpty():
            break
        levels.append(frontier)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionAll(x)
    return out


def _seeds(edges: DataFrame, ids: Sequence[str]) -> DataFrame:
    kind = edges.schema["from_id"].dataType.simpleString()
    return edges.sparkSession.createDataFrame([(i,) for i in ids], f"id {kind}")


def traverse(edges: DataFrame, start: str, max_depth: int = 1, direction: str = "outgoing", edge_type: str | None = None) -> DataFrame:
    """(id, ``depth``) of the nodes within ``max_depth`` steps, the start left
    out; depth 0 finds none."""
    return _reach(edges, _seeds(edges, [start]), max_depth, direction, edge_type).filter("depth > 0").select("id", "depth")


def traverse_edges(edges: DataFrame, start: str, max_depth: int = 1, direction: str = "outgoing", edge_type: str | None = None) -> DataFrame:
    """As ``traverse``, with the edge by which each node was reached."""
    return _reach(edges, _seeds(edges, [start]), max_depth, direction, edge_type).filter("depth > 0").select("id", "depth", "edge")


def shortest_path(edges: DataFrame, start: str, end: str, max_depth: int = 10, direction: str = "outgoing", edge_type: str | None = None) -> list[str] | None:
    """Nodes from start to end, both included, of the least of the shortest
    paths; None if there is none within ``max_depth`` steps."""
    if start == end:
        return [start]
    found = _reach(edges, _seeds(edges, [start]), max_depth, direction, edge_type, end).filter(F.col("id") == end).select("path").first()
    return found[0] if found else None


def has_path(edges: DataFrame, start: str, end: str, max_depth: int = 10, direction: str = "outgoing", edge_type: str | None = None) -> bool:
    return shortest_path(edges, start, end, max_depth, direction, edge_type) is not None


def subgraph(edges: DataFrame, seeds: Sequence[str], max_depth: int = 1, direction: str = "outgoing", edge_type: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id) within reach of any seed, seeds included, and the edges of the
    type between them.  The depths of several seeds are counted from each."""
    nodes = written(_reach(edges, _seeds(edges, seeds), max_depth, direction, edge_type).select("id").distinct(), "graph-nodes")
    inside = _typed(edges, edge_type).join(nodes.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(nodes.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return nodes, inside.select(*edges.columns).dropDuplicates(KEY)


def expand(edges: DataFrame, ids: DataFrame, direction: str = "outgoing", edge_type: str | None = None, id_col: str = "id") -> DataFrame:
    """The ids and their direct neighbours."""
    own = ids.select(F.col(id_col).alias("id"))
    near = _steps(edges, direction, edge_type).join(own.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    return own.unionAll(near).distinct()


def edge_types(edges: DataFrame) -> DataFrame:
    return edges.select("edge_type").distinct()


def node_ids(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()


def drop_orphans(edges: DataFrame, live: DataFrame, id_col: str = "id") -> DataFrame:
    """Only edges both of whose ends are among the live ids."""
    ids = live.select(F.col(id_col).alias("__id"))
    for end in ("from_id", "to_id"):
        edges = edges.join(ids, F.col(end) == F.col("__id"), "left_semi")
    return edges
