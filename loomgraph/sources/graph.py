"""A property graph as tables.

A node table has `_id`, `_labels` and one typed column for each property; its name is
the nodes' kind, and a node's identity is (kind, `_id`). An edge table has `_id`, `_src`
and `_dst`, and knows its type and, where they are fixed, the kinds at its ends.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of every table that are not properties.
NODE_COLUMNS = ("_id", "_kind", "_labels")
EDGE_COLUMNS = ("_id", "_type", "_src", "_src_kind", "_dst", "_dst_kind")
ENTITY = "struct<kind:string,id:bigint,ts:bigint>"


@dataclass(frozen=True)
class NodeTable:
    """labels: all labels that occur; uniform: every row has all of them."""

    df: DataFrame
    labels: frozenset[str]
    uniform: bool = True


@dataclass(frozen=True)
class EdgeTable:
    """src_kind and dst_kind are None where rows carry their own `_src_kind` and `_dst_kind`."""

    type: str
    df: DataFrame
    src_kind: str | None = None
    dst_kind: str | None = None


@dataclass(frozen=True)
class Graph:
    """Everything a query can read."""

    spark: SparkSession
    nodes: dict[str, NodeTable] = field(default_factory=dict)
    edges: tuple[EdgeTable, ...] = ()
    versions: dict[str, DataFrame] = field(default_factory=dict)
    subgraphs: DataFrame | None = None
    members: DataFrame | None = None
    hyperedges: DataFrame | None = None

    def with_nodes(self, kind: str, df: DataFrame, id_column: str | None = None) -> Graph:
        """The graph with a table as the nodes of one label."""
        plain = normalised(df)
        if id_column:
            plain = plain.withColumn("_id", F.col(id_column).cast("long"))
        plain = plain.withColumn("_labels", F.array(F.lit(kind))) if "_labels" not in plain.columns else plain
        return replace(self, nodes={**self.nodes, kind: NodeTable(plain, frozenset([kind]))})

    def with_edges(self, type: str, df: DataFrame, src_kind: str, dst_kind: str) -> Graph:
        """The graph with a table (`_src`, `_dst`, perhaps `_id`, properties) as edges of one type."""
        plain = normalised(df).withColumn("_src", F.col("_src").cast("long")).withColumn("_dst", F.col("_dst").cast("long"))
        if "_id" not in plain.columns:
            plain = plain.withColumn("_id", F.xxhash64("_src", "_dst"))
        return replace(self, edges=(*self.edges, EdgeTable(type, plain, src_kind, dst_kind)))

    # -- schema

    def kinds_with(self, labels: tuple[str, ...]) -> list[str]:
        return [k for k, t in self.nodes.items() if set(labels) <= t.labels]

    def node_properties(self, kinds: list[str]) -> dict[str, T.DataType]:
        """Property columns of some kinds with their common types."""
        return _merged([self.nodes[k].df for k in kinds], NODE_COLUMNS)

    def edge_tables(self, types: tuple[str, ...]) -> list[EdgeTable]:
        return [e for e in self.edges if not types or e.type in types]

    # -- scans

    def node_scan(self, labels: tuple[str, ...] = (), columns: set[str] | None = None) -> DataFrame:
        """_id, _kind, _labels and properties of the nodes that have all `labels`; only
        tables that can have them are read, and with `columns` only these."""
        kinds = self.kinds_with(labels)
        props = self.node_properties(kinds)
        parts = []
        for kind in kinds:
            table = self.nodes[kind]
            df = table.df
            if not table.uniform:
                for label in labels:
                    df = df.where(F.array_contains("_labels", label))
            parts.append(df.select("_id", F.lit(kind).alias("_kind"), "_labels", *_aligned(df, props, columns)))
        return _union(self.spark, parts, "_id long, _kind string, _labels array<string>")

    def edge_scan(self, types: tuple[str, ...] = (), columns: set[str] | None = None) -> DataFrame:
        """_id, _type, the ends and properties of the edges of any of `types` (all, if none)."""
        tables = self.edge_tables(types)
        props = _merged([e.df for e in tables], EDGE_COLUMNS)
        parts = []
        for e in tables:
            ends = [
                "_src", (F.lit(e.src_kind) if e.src_kind is not None else F.col("_src_kind")).alias("_src_kind"),
                "_dst", (F.lit(e.dst_kind) if e.dst_kind is not None else F.col("_dst_kind")).alias("_dst_kind"),
            ]
            parts.append(e.df.select("_id", F.lit(e.type).alias("_type"), *ends, *_aligned(e.df, props, columns)))
        return _union(self.spark, parts, "_id long, _type string, _src long, _src_kind string, _dst long, _dst_kind string")

    def version_scan(self, labels: tuple[str, ...] = (), columns: set[str] | None = None) -> DataFrame | None:
        """_id, _kind, _seq and properties of the earlier states of nodes of these labels' tables."""
        kinds = [k for k in self.kinds_with(labels) if k in self.versions]
        if not kinds:
            return None
        props = _merged([self.versions[k] for k in kinds], ("_seq", *NODE_COLUMNS))
        parts = [self.versions[k].select("_id", F.lit(k).alias("_kind"), "_seq", *_aligned(self.versions[k], props, columns)) for k in kinds]
        return _union(self.spark, parts, "_id long, _kind string, _seq long")

    def subgraph_scan(self) -> DataFrame:
        if self.subgraphs is None:
            return self.spark.createDataFrame([], "_id long, _temporal_anchor timestamp, _created_at timestamp")
        return self.subgraphs

    def member_scan(self) -> DataFrame:
        """subgraph_id, node_id, node_kind."""
        if self.members is None:
            return self.spark.createDataFrame([], "subgraph_id long, node_id long, node_kind string")
        return self.members

    def hyperedge_scan(self, types: tuple[str, ...] = ()) -> DataFrame:
        """_id, _type, _sources, _targets and properties of hyperedges of any of `types`."""
        if self.hyperedges is None:
            return self.spark.createDataFrame([], f"_id long, _type string, _sources array<{ENTITY}>, _targets array<{ENTITY}>")
        return self.hyperedges.where(F.col("_type").isin(*types)) if types else self.hyperedges


def normalised(df: DataFrame) -> DataFrame:
    """Columns brought to the types of the data model: 64-bit numbers and instants."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.FloatType, T.DecimalType)):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.TimestampNTZType, T.DateType)):
            c = c.cast("timestamp")
        out.append(c.alias(f.name))
    return df.select(*out)


def common_type(a: T.DataType, b: T.DataType, name: str) -> T.DataType:
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if {type(a), type(b)} == {T.LongType, T.DoubleType}:
        return T.DoubleType()
    raise TypeError(f"property {name} has values of types {a.simpleString()} and {b.simpleString()}")


def _merged(tables: list[DataFrame], without: tuple[str, ...]) -> dict[str, T.DataType]:
    out: dict[str, T.DataType] = {}
    for df in tables:
        for f in df.schema.fields:
            if f.name not in without:
                out[f.name] = common_type(out[f.name], f.dataType, f.name) if f.name in out else f.dataType
    return out


def _aligned(df: DataFrame, props: dict[str, T.DataType], columns: set[str] | None) -> list:
    have = set(df.columns)
    names = [n for n in props if columns is None or n in columns]
    return [(F.col(f"`{n}`") if n in have else F.lit(None)).cast(props[n]).alias(n) for n in names]


def _union(spark: SparkSession, parts: list[DataFrame], empty: str) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], empty)
    return reduce(lambda a, b: a.unionByName(b), parts)
