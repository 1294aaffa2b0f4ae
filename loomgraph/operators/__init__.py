"""The graph operators as functions over DataFrames, usable without the query language."""

from .expansions import contains, expand, hyperedge_counts, optional_expand, participants, var_length_expand
from .grouping import sort_limit
from .scans import (
    edge_of, edge_property_scan, edge_type_scan, edges_of, find_edge, find_node, index_scan, node_of, node_scan, range_scan, subgraphs_of, version_counts, versions_of,
)
from .temporal import nodes_at, nodes_between, reference_states, valid_at, valid_between

__all__ = [
    "contains", "edge_of", "edge_property_scan", "edge_type_scan", "edges_of", "expand", "find_edge", "find_node", "hyperedge_counts", "index_scan", "node_of",
    "node_scan", "nodes_at", "nodes_between", "optional_expand", "participants", "range_scan", "reference_states", "sort_limit", "subgraphs_of",
    "valid_at", "valid_between", "var_length_expand", "version_counts", "versions_of",
]
