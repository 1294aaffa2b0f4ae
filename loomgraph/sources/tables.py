"""The graph view over the driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import ENTITY, Graph


#: The tables' columns. Given to the reader, so that no job is spent on finding them out.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double,
        l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz""",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def table_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers, orders, parts and so on as nodes, their keys as edges, users with the
    history of their events as versions, regions as subgraphs of nations, sales as hyperedges.
    Nothing is read until a query runs, and then only the columns it uses."""
    t = {n: read(spark, sf_dir, n) for n in SCHEMAS}
    items = t["lineitem"]
    # rows of this table may be equal, so an item's id is a hash of its place: its file, and its row there
    line = F.xxhash64("_metadata.file_path", "_metadata.row_index")
    graph = Graph(spark)
    for kind, table, key in (
        ("Region", "region", "r_regionkey"), ("Nation", "nation", "n_nationkey"), ("Customer", "customer", "c_custkey"),
        ("Supplier", "supplier", "s_suppkey"), ("Part", "part", "p_partkey"), ("Order", "orders", "o_orderkey"), ("Event", "events", "event_id"),
    ):
        graph = graph.with_nodes(kind, t[table], key)

    def ends(df: DataFrame, src: str, dst: str, *more) -> DataFrame:
        return df.select(F.col(src).alias("_src"), F.col(dst).alias("_dst"), *more)

    graph = graph.with_edges("IN_REGION", ends(t["nation"], "n_nationkey", "n_regionkey"), "Nation", "Region")
    graph = graph.with_edges("IN_NATION", ends(t["customer"], "c_custkey", "c_nationkey"), "Customer", "Nation")
    graph = graph.with_edges("IN_NATION", ends(t["supplier"], "s_suppkey", "s_nationkey"), "Supplier", "Nation")
    placed = ends(t["orders"], "o_custkey", "o_orderkey", F.col("o_orderkey").alias("_id"), F.col("o_orderdate").alias("_valid_from"))
    graph = graph.with_edges("PLACED", placed, "Customer", "Order")
    has_item = ends(
        items, "l_orderkey", "l_partkey", line.alias("_id"), F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_returnflag").alias("flag"), F.col("l_shipdate").alias("_valid_from"),
    )
    graph = graph.with_edges("HAS_ITEM", has_item, "Order", "Part")
    graph = graph.with_edges("SUPPLIES", ends(items, "l_suppkey", "l_partkey").distinct(), "Supplier", "Part")
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    following = t["events"].select("event_id", F.lead("event_id").over(by_user).alias("next")).where(F.col("next").isNotNull())
    graph = graph.with_edges("NEXT", ends(following, "event_id", "next"), "Event", "Event")

    states = t["events"].select(
        F.col("user_id").alias("_id"), F.row_number().over(by_user).cast("long").alias("_seq"), F.col("ts").cast("timestamp").alias("_updated_at"),
        F.min("ts").over(Window.partitionBy("user_id")).cast("timestamp").alias("_created_at"), "event_type", "value",
        F.count(F.lit(1)).over(Window.partitionBy("user_id")).alias("__n"),
    )
    graph = graph.with_nodes("User", states.where(F.col("_seq") == F.col("__n")).drop("_seq", "__n"))
    graph.versions["User"] = states.where(F.col("_seq") < F.col("__n")).drop("__n")

    regions = t["region"].select(F.col("r_regionkey").cast("long").alias("_id"), F.lit(None).cast("timestamp").alias("_temporal_anchor"), F.col("r_name").alias("name"))
    members = t["nation"].select(F.col("n_regionkey").cast("long").alias("subgraph_id"), F.col("n_nationkey").cast("long").alias("node_id"), F.lit("Nation").alias("node_kind"))

    def entity(kind: str, key: str):
        return F.struct(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"), F.lit(None).cast("long").alias("ts"))

    sales = items.select(
        line.alias("_id"), F.lit("SALE").alias("_type"),
        F.array(entity("Order", "l_orderkey")).cast(f"array<{ENTITY}>").alias("_sources"),
        F.array(entity("Part", "l_partkey"), entity("Supplier", "l_suppkey")).cast(f"array<{ENTITY}>").alias("_targets"), F.col("l_quantity").alias("quantity"),
    )
    from dataclasses import replace

    return replace(graph, subgraphs=regions, members=members, hyperedges=sales)
