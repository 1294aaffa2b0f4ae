"""Scans and look-ups: filters that reach the Parquet reader."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.graph import Graph


def node_scan(graph: Graph, *labels: str, columns: set[str] | None = None) -> DataFrame:
    """All nodes that have every label."""
    return graph.node_scan(labels, columns)


def index_scan(graph: Graph, label: str, key: str, value) -> DataFrame:
    """Nodes of a label whose property equals a value."""
    return graph.node_scan((label,)).where(F.col(f"`{key}`") == F.lit(value))


def range_scan(graph: Graph, label: str, key: str, low, high) -> DataFrame:
    """Nodes of a label whose property lies in [low, high]."""
    return graph.node_scan((label,)).where(F.col(f"`{key}`").between(low, high))


def edge_type_scan(graph: Graph, *types: str, columns: set[str] | None = None) -> DataFrame:
    """Edges of any of the types; of all without one."""
    return graph.edge_scan(types, columns)


def edge_property_scan(graph: Graph, type: str, key: str, value) -> DataFrame:
    """Edges of a type whose property equals a value."""
    return graph.edge_scan((type,)).where(F.col(f"`{key}`") == F.lit(value))


def find_node(graph: Graph, labels: tuple[str, ...], **props) -> DataFrame:
    """The node with the smallest id among those with these labels and properties; one row or none."""
    found = graph.node_scan(labels)
    for key, value in props.items():
        found = found.where(F.col(f"`{key}`") == F.lit(value))
    return found.orderBy("_kind", "_id").limit(1)


def find_edge(graph: Graph, src: tuple[str, int], dst: tuple[str, int], type: str) -> DataFrame:
    """The edge with the smallest id between two nodes (kind, id); one row or none."""
    between = _is("_src", src) & _is("_dst", dst)
    return graph.edge_scan((type,)).where(between).orderBy("_id").limit(1)


def _is(end: str, node: tuple[str, int]) -> F.Column:
    return (F.col(f"{end}_kind") == node[0]) & (F.col(end) == node[1])


def node_of(graph: Graph, kind: str, id: int) -> DataFrame:
    """The node of a kind with an id."""
    return graph.node_scan((kind,)).where((F.col("_id") == id) & (F.col("_kind") == kind))


def edge_of(graph: Graph, type: str, id: int) -> DataFrame:
    """The edge of a type with an id."""
    return graph.edge_scan((type,)).where(F.col("_id") == id)


def edges_of(graph: Graph, kind: str, id: int, types: tuple[str, ...] = (), columns: set[str] | None = None) -> DataFrame:
    """The edges (of any of the types) that begin or end at a node; a loop counts once."""
    return graph.edge_scan(types, columns).where(_is("_src", (kind, id)) | _is("_dst", (kind, id)))


def versions_of(graph: Graph, kind: str, id: int) -> DataFrame:
    """The earlier states of a node, numbered in `_seq`; no rows for a kind without any."""
    states = graph.version_scan((kind,))
    if states is None:
        return graph.spark.createDataFrame([], "_id long, _kind string, _seq long")
    return states.where((F.col("_id") == id) & (F.col("_kind") == kind))


def version_counts(graph: Graph, label: str) -> DataFrame:
    """_id, n, latest: how many earlier states each node has, and the number of the last."""
    return graph.version_scan((label,), set()).groupBy("_id").agg(F.count(F.lit(1)).alias("n"), F.max("_seq").alias("latest"))


def subgraphs_of(graph: Graph, kind: str, id: int) -> DataFrame:
    """subgraph_id of the subgraphs a node is a member of."""
    return graph.member_scan().where((F.col("node_kind") == kind) & (F.col("node_id") == id)).select("subgraph_id")
