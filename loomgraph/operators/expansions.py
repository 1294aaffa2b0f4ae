"""Expansions along edges: equi-joins on the ends' ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.graph import EDGE_COLUMNS, Graph

#: Hops after which a frontier is written down, so that later hops don't repeat earlier ones.
HOPS_AT_ONCE = 4


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """Edges as seen from their start: `_from`, `_to` and their kinds instead of the ends.

    direction out, in, or both; in both a loop counts once."""
    rest = [F.col(f"`{c}`") for c in edges.columns if c not in ("_src", "_src_kind", "_dst", "_dst_kind")]

    def seen(a: str, b: str) -> list:
        return [F.col(f"_{a}").alias("_from"), F.col(f"_{a}_kind").alias("_from_kind"), F.col(f"_{b}").alias("_to"), F.col(f"_{b}_kind").alias("_to_kind"), *rest]

    out = edges.select(*seen("src", "dst"))
    if direction == "out":
        return out
    back = edges.select(*seen("dst", "src"))
    if direction == "in":
        return back
    loop = (F.col("_from") == F.col("_to")) & (F.col("_from_kind") == F.col("_to_kind"))
    return out.unionByName(back.where(~loop))


def _prefixed(df: DataFrame, rel: str, target: str) -> DataFrame:
    names = {"_to": f"{target}._id", "_to_kind": f"{target}._kind", "_from": "__from", "_from_kind": "__from_kind"}
    return df.select(*[F.col(f"`{c}`").alias(names.get(c, f"{rel}.{c}")) for c in df.columns])


def expand(rows: DataFrame, source: str, edges: DataFrame, rel: str, target: str, direction: str = "out", how: str = "inner") -> DataFrame:
    """`rows` with one row for each edge at their `source`; the edge's columns under `rel`
    and the other end's id and kind under `target`. With how "left" a row without edges
    stays, with nulls."""
    seen = _prefixed(directed(edges, direction), rel, target)
    on = (F.col(f"`{source}._id`") == F.col("__from")) & (F.col(f"`{source}._kind`") == F.col("__from_kind"))
    return rows.join(seen, on, how).drop("__from", "__from_kind")


def optional_expand(rows: DataFrame, source: str, edges: DataFrame, rel: str, target: str, direction: str = "out") -> DataFrame:
    """`expand` that keeps every row."""
    return expand(rows, source, edges, rel, target, direction, "left")


def var_length_expand(
    rows: DataFrame, source: str, edges: DataFrame, rel: str, target: str, direction: str = "out", least: int = 1, most: int = 10, written=None
) -> DataFrame:
    """All paths of `least` to `most` edges that meet no node twice, one row a path; the last
    edge under `rel` (nulls for a path of no edges), the last node under `target`.

    The path is an array of nodes, nothing else is carried from hop to hop. `written`
    (a function of a DataFrame) cuts the lineage every few hops of a long path, where
    each hop's branch of the union would repeat all hops before it.
    """
    step = _prefixed(directed(edges, direction), rel, target)
    node = F.struct(F.col(f"`{source}._id`").alias("id"), F.col(f"`{source}._kind`").alias("kind"))
    columns = [c for c in step.columns if c not in ("__from", "__from_kind")]
    state = rows.where(F.col(f"`{source}._id`").isNotNull()).withColumn("__path", F.array(node))
    types = dict(step.dtypes)
    state = state.select("*", *[(F.col(f"`{source}.{c.rsplit('.', 1)[-1]}`") if c in (f"{target}._id", f"{target}._kind") else F.lit(None).cast(types[c])).alias(c) for c in columns])
    kept = [F.col(f"`{c}`") for c in rows.columns]
    found = [state] if least == 0 else []
    for hop in range(1, most + 1):
        tail = F.element_at("__path", -1)
        here = state.select(*kept, "__path")
        joined = here.join(step, (tail["id"] == F.col("__from")) & (tail["kind"] == F.col("__from_kind")))
        reached = F.struct(F.col(f"`{target}._id`").alias("id"), F.col(f"`{target}._kind`").alias("kind"))
        state = joined.where(~F.array_contains("__path", reached)).select(*kept, F.array_append("__path", reached).alias("__path"), *[f"`{c}`" for c in columns])
        if written is not None and hop % HOPS_AT_ONCE == 0 and hop < most:
            state = written(state)
        if hop >= least:
            found.append(state)
    return reduce(lambda a, b: a.unionByName(b), found).drop("__path")


def contains(rows: DataFrame, source: str, members: DataFrame, target: str) -> DataFrame:
    """From subgraphs to the nodes that are their members."""
    seen = members.select(F.col("subgraph_id").alias("__from"), F.col("node_id").alias(f"{target}._id"), F.col("node_kind").alias(f"{target}._kind"))
    return rows.join(seen, F.col(f"`{source}._id`") == F.col("__from")).drop("__from")


def participants(hyperedges: DataFrame) -> DataFrame:
    """_id, place, role, kind, id, ts of every participant of hyperedges, sources before targets."""
    sides = [
        hyperedges.select("_id", F.lit(role).alias("role"), F.posexplode(column).alias("place", "p"))
        for role, column in (("source", "_sources"), ("target", "_targets"))
    ]
    return sides[0].unionByName(sides[1]).select("_id", "role", "place", "p.kind", "p.id", "p.ts")


def hyperedge_counts(graph: Graph, types: tuple[str, ...], kind: str) -> DataFrame:
    """id, n: the places that entities of a kind take in hyperedges of any of the types."""
    found = participants(graph.hyperedge_scan(types)).where(F.col("kind") == kind)
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def edge_columns(edges: DataFrame) -> list[str]:
    return [c for c in edges.columns if c not in EDGE_COLUMNS]
