"""The registered graph queries over the driver's tables, each with DuckDB SQL beside it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators as ops
from .plans.writer import open_session
from .session import Session, scratch_folder
from .sources.graph import Graph
from .sources.tables import read, table_graph

Query = Callable[[SparkSession, str], DataFrame]

_PATHS = """WITH RECURSIVE step AS (SELECT event_id AS a, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
 walk(s, e, hops) AS (SELECT event_id, event_id, 0 FROM events WHERE event_type = 'signup'
  UNION ALL SELECT w.s, step.b, w.hops + 1 FROM walk w JOIN step ON w.e = step.a WHERE step.b IS NOT NULL AND w.hops < {most})
 SELECT s AS a, e AS b FROM walk WHERE hops >= {least}"""
_STATES = """states AS (SELECT user_id, event_type, value, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
 count(*) OVER (PARTITION BY user_id) AS n, min(ts) OVER (PARTITION BY user_id) AS created FROM events)"""
_AT, _FROM, _TO = "2024-01-15T00:00:00", "2024-01-05T00:00:00", "2024-01-12T00:00:00"
#: _AT as a number, the time of reading queries (1997), and their parameters.
_AT_MS, _NOW_MS, _PARAMETERS = 1_705_276_800_000, 852_076_800_000, {"least": 5000, "segment": "BUILDING"}

#: name: (query text, SQL). Columns have the same names on both sides.
TEXTS: dict[str, tuple[str, str]] = {
    "node_scan_project": (
        "MATCH (c:Customer) RETURN c.c_name AS name, c.c_acctbal AS balance",
        "SELECT c_name AS name, c_acctbal AS balance FROM customer",
    ),
    "filter_logic": (
        "MATCH (c:Customer) WHERE c.c_acctbal > 0 AND NOT c.c_mktsegment = 'BUILDING' RETURN c.c_name AS name",
        "SELECT c_name AS name FROM customer WHERE c_acctbal > 0 AND NOT coalesce(c_mktsegment = 'BUILDING', false)",
    ),
    "filter_null_comparison": (
        "MATCH (c:Customer) WHERE NOT (c.missing = 1) AND c.missing IS NULL AND c.c_acctbal IS NOT NULL RETURN count(*) AS n",
        "SELECT count(*) AS n FROM customer WHERE c_acctbal IS NOT NULL",
    ),
    "inline_properties": (
        "MATCH (p:Part {p_brand: 'Brand#17'}) RETURN p.p_name AS name, p.p_size AS size",
        "SELECT p_name AS name, CAST(p_size AS BIGINT) AS size FROM part WHERE p_brand = 'Brand#17'",
    ),
    "distinct_sort_skip_limit": (
        "MATCH (o:Order) RETURN DISTINCT o.o_orderpriority AS priority, o.o_orderstatus AS status ORDER BY priority DESC, status SKIP 2 LIMIT 7",
        "SELECT DISTINCT o_orderpriority AS priority, o_orderstatus AS status FROM orders ORDER BY priority DESC, status LIMIT 7 OFFSET 2",
    ),
    "sort_by_hidden_value": (
        "MATCH (o:Order) RETURN o.o_orderkey AS k ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 20",
        "SELECT o_orderkey AS k FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    ),
    "expand_out": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.c_name AS name, o.o_totalprice AS price",
        "SELECT c_name AS name, o_totalprice AS price FROM customer JOIN orders ON c_custkey = o_custkey",
    ),
    "expand_in": (
        "MATCH (o:Order)<-[r:PLACED]-(c:Customer) WHERE o.o_totalprice > 200000 RETURN id(o) AS o, id(c) AS c, type(r) AS kind",
        "SELECT o_orderkey AS o, c_custkey AS c, 'PLACED' AS kind FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 200000",
    ),
    "expand_both": (
        "MATCH (p:Part)-[:SUPPLIES]-(s) WHERE p.p_size < 10 RETURN id(p) AS p, id(s) AS s",
        "SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 10",
    ),
    "four_hops": (
        "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o:Order) RETURN r.r_name AS region, count(*) AS n, sum(o.o_totalprice) > 0 AS any",
        """SELECT r_name AS region, count(*) AS n, sum(o_totalprice) > 0 AS any FROM region JOIN nation ON n_regionkey = r_regionkey
           JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY r_name""",
    ),
    "edge_property_filter": (
        "MATCH (o:Order)-[i:HAS_ITEM {flag: 'R'}]->(p:Part) WHERE i.quantity >= 45 RETURN id(o) AS o, id(p) AS p, i.quantity AS quantity",
        "SELECT l_orderkey AS o, l_partkey AS p, l_quantity AS quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' AND l_quantity >= 45",
    ),
    "optional_match": (
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o) RETURN id(c) AS c, id(o) AS o",
        "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey",
    ),
    "optional_match_where": (
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 300000 RETURN c.c_name AS name, o.o_totalprice AS price",
        "SELECT c_name AS name, o_totalprice AS price FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000",
    ),
    "optional_match_two_hops": (
        "MATCH (n:Nation) OPTIONAL MATCH (n)<-[:IN_NATION]-(s:Supplier)-[:SUPPLIES]->(p:Part {p_size: 7}) RETURN n.n_name AS nation, count(p) AS parts",
        """SELECT n_name AS nation, count(x.p) AS parts FROM nation LEFT JOIN (SELECT DISTINCT s_nationkey, s_suppkey, p_partkey AS p FROM supplier
           JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey AND p_size = 7) x ON s_nationkey = n_nationkey GROUP BY n_name""",
    ),
    "chain_join": (
        "MATCH (c:Customer), (s:Supplier) WHERE c.c_nationkey = s.s_nationkey AND c.c_acctbal > 9000 RETURN c.c_name AS c, s.s_name AS s",
        "SELECT c_name AS c, s_name AS s FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_acctbal > 9000",
    ),
    "two_matches_share_a_node": (
        "MATCH (c:Customer)-[:IN_NATION]->(n:Nation) MATCH (s:Supplier)-[:IN_NATION]->(n) WHERE n.n_name <> 'X' RETURN n.n_name AS nation, count(*) AS pairs",
        "SELECT n_name AS nation, count(*) AS pairs FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name",
    ),
    "type_alternation": (
        "MATCH (a)-[r:IN_NATION|IN_REGION]->(b) RETURN type(r) AS kind, count(*) AS n",
        """SELECT 'IN_REGION' AS kind, count(*) AS n FROM nation UNION ALL
           SELECT 'IN_NATION', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)""",
    ),
    "count_rows": ("MATCH (o:Order) RETURN o.o_orderstatus AS status, count(*) AS n", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1"),
    "count_values": (
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o) RETURN count(*) AS rows, count(o) AS orders, count(DISTINCT c) AS customers",
        "SELECT count(*) AS rows, count(o_orderkey) AS orders, count(DISTINCT c_custkey) AS customers FROM customer LEFT JOIN orders ON o_custkey = c_custkey",
    ),
    "sum_avg_min_max": (
        "MATCH (p:Part) RETURN p.p_brand AS brand, sum(p.p_size) AS total, min(p.p_size) AS low, max(p.p_size) AS high, avg(p.p_size) AS mean",
        "SELECT p_brand AS brand, CAST(sum(p_size) AS BIGINT) AS total, CAST(min(p_size) AS BIGINT) AS low, CAST(max(p_size) AS BIGINT) AS high, avg(p_size) AS mean FROM part GROUP BY 1",
    ),
    "aggregate_expression": (
        "MATCH (p:Part) RETURN p.p_brand AS brand, count(*) + 1 AS more, sum(p.p_size) / count(*) AS whole_mean",
        "SELECT p_brand AS brand, count(*) + 1 AS more, CAST(sum(p_size) // count(*) AS BIGINT) AS whole_mean FROM part GROUP BY 1",
    ),
    "aggregate_empty": ("MATCH (p:Part {p_brand: 'none'}) RETURN count(*) AS n, sum(p.p_size) AS total", "SELECT count(*) AS n, CAST(coalesce(sum(p_size), 0) AS BIGINT) AS total FROM part WHERE p_brand = 'none'"),
    "with_having": (
        "MATCH (c:Customer)-[:PLACED]->(o) WITH c, count(*) AS n WHERE n > 12 RETURN c.c_name AS name, n",
        "SELECT c_name AS name, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name HAVING count(*) > 12",
    ),
    "with_distinct_rename": (
        "MATCH (c:Customer) WITH DISTINCT c.c_mktsegment AS segment WHERE segment <> 'BUILDING' RETURN segment",
        "SELECT DISTINCT c_mktsegment AS segment FROM customer WHERE c_mktsegment <> 'BUILDING'",
    ),
    "unwind_list": (
        "UNWIND [1, 2, 3] AS x MATCH (r:Region) RETURN x * 2 AS x2, r.r_name AS name",
        "SELECT x * 2 AS x2, r_name AS name FROM (SELECT CAST(unnest([1, 2, 3]) AS BIGINT) AS x) CROSS JOIN region",
    ),
    "arithmetic": (
        "MATCH (p:Part) RETURN id(p) AS p, p.p_size / 7 AS quotient, (0 - p.p_size) % 7 AS rest, -p.p_size + 2 * 3 AS mixed, p.p_retailprice / 2 AS half",
        "SELECT p_partkey AS p, CAST(p_size // 7 AS BIGINT) AS quotient, CAST(-(p_size % 7) AS BIGINT) AS rest, CAST(-p_size + 6 AS BIGINT) AS mixed, p_retailprice / 2 AS half FROM part",
    ),
    "three_valued_logic": (
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WITH c, o WHERE o.o_totalprice > 100000 OR o IS NULL RETURN id(c) AS c, id(o) AS o",
        "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 100000 OR o_orderkey IS NULL",
    ),
    "labels_function": ("MATCH (n) UNWIND labels(n) AS label RETURN label, count(*) AS n", """SELECT * FROM (VALUES
        ('Region', (SELECT count(*) FROM region)), ('Nation', (SELECT count(*) FROM nation)), ('Customer', (SELECT count(*) FROM customer)), ('Supplier', (SELECT count(*) FROM supplier)),
        ('Part', (SELECT count(*) FROM part)), ('Order', (SELECT count(*) FROM orders)), ('Event', (SELECT count(*) FROM events)), ('User', (SELECT count(DISTINCT user_id) FROM events))) v(label, n)"""),
    "datetime_compare": (
        "MATCH (o:Order) WHERE o.o_orderdate >= datetime('1995-01-01') AND o.o_orderdate < datetime('1996-01-01T00:00:00Z') RETURN id(o) AS o",
        "SELECT o_orderkey AS o FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'",
    ),
    "paths_1_to_3": ("MATCH (e:Event {event_type: 'signup'})-[:NEXT*1..3]->(f) RETURN id(e) AS a, id(f) AS b", _PATHS.format(least=1, most=3)),
    "paths_0_to_2": ("MATCH (e:Event {event_type: 'signup'})-[:NEXT*0..2]->(f) RETURN id(e) AS a, id(f) AS b", _PATHS.format(least=0, most=2)),
    "paths_exactly_2": ("MATCH (e:Event {event_type: 'signup'})-[:NEXT*2]->(f) RETURN id(e) AS a, id(f) AS b", _PATHS.format(least=2, most=2)),
    "paths_long": ("MATCH (e:Event {event_type: 'signup'})-[:NEXT*4..6]->(f) RETURN id(e) AS a, id(f) AS b", _PATHS.format(least=4, most=6)),
    "paths_undirected": (
        "MATCH (s:Supplier)-[:SUPPLIES*1..2]-(x) RETURN labels(x) AS kinds, id(x) AS x, count(*) AS paths",
        """WITH s AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem)
           SELECT ['Part'] AS kinds, p AS x, count(*) AS paths FROM s GROUP BY p
           UNION ALL SELECT ['Supplier'], b.s, count(*) FROM s a JOIN s b ON a.p = b.p AND b.s <> a.s GROUP BY b.s""",
    ),
    "paths_open_above": ("MATCH (e:Event {event_type: 'signup'})-[:NEXT*9..]->(f) RETURN id(e) AS a, id(f) AS b", _PATHS.format(least=9, most=10)),
    "paths_open_below": ("MATCH (e:Event {event_type: 'signup'})-[:NEXT*..2]->(f) RETURN id(e) AS a, id(f) AS b", _PATHS.format(least=1, most=2)),
    "collect_unwind": (
        "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r.r_name AS region, collect(n.n_name) AS names UNWIND names AS name RETURN region, name",
        "SELECT r_name AS region, n_name AS name FROM nation JOIN region ON r_regionkey = n_regionkey",
    ),
    "return_distinct_aggregate": (
        "MATCH (c:Customer) RETURN DISTINCT c.c_mktsegment AS segment, count(DISTINCT c.c_nationkey) AS nations",
        "SELECT c_mktsegment AS segment, count(DISTINCT c_nationkey) AS nations FROM customer GROUP BY 1",
    ),
    "now_function": ("MATCH (o:Order) WHERE o.o_orderdate < now() RETURN count(*) AS n", "SELECT count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'"),
    "parameters": (
        "MATCH (c:Customer) WHERE c.c_acctbal > $least AND c.c_mktsegment = $segment AND NOT c.c_name = $missing RETURN id(c) AS c",
        "SELECT c_custkey AS c FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'",
    ),
    "nodes_at_milliseconds": (
        f"MATCH (u:User) AT TIME {_AT_MS} RETURN id(u) AS u, u.event_type AS state",
        f"WITH {_STATES} SELECT user_id AS u, event_type AS state FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS k FROM states WHERE ts <= TIMESTAMP '{_AT}') WHERE k = 1",
    ),
    "edges_at_time": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order) AT TIME datetime('1995-06-01') RETURN id(c) AS c, id(o) AS o",
        "SELECT o_custkey AS c, o_orderkey AS o FROM orders WHERE o_orderdate <= TIMESTAMP '1995-06-01'",
    ),
    "edges_between_times": (
        "MATCH (o:Order)-[i:HAS_ITEM]->(p) BETWEEN TIME datetime('1996-01-01') AND datetime('1997-01-01') RETURN count(*) AS n, count(DISTINCT p) AS parts",
        # an edge without an end is in force from its start on, so a range only bounds the start
        "SELECT count(*) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem WHERE l_shipdate <= TIMESTAMP '1997-01-01'",
    ),
    "nodes_at_time": (
        f"MATCH (u:User) AT TIME datetime('{_AT}') RETURN id(u) AS u, u.event_type AS state, u.value AS value",
        f"WITH {_STATES} SELECT user_id AS u, event_type AS state, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS k FROM states WHERE ts <= TIMESTAMP '{_AT}') WHERE k = 1",
    ),
    "nodes_between_times": (
        f"MATCH (u:User) BETWEEN TIME datetime('{_FROM}') AND datetime('{_TO}') RETURN id(u) AS u, u.event_type AS state, u.value AS value",
        f"SELECT user_id AS u, event_type AS state, value FROM events WHERE ts BETWEEN TIMESTAMP '{_FROM}' AND TIMESTAMP '{_TO}'",
    ),
    "subgraph_members": (
        "MATCH (g:Subgraph {name: 'ASIA'})-[:CONTAINS]->(n:Nation) RETURN n.n_name AS nation",
        "SELECT n_name AS nation FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'",
    ),
    "hyperedge_participants": (
        "MATCH HYPEREDGE (h:SALE) MATCH (h)-[:INVOLVES]->(x) RETURN labels(x) AS kinds, count(*) AS n, count(DISTINCT h) AS sales",
        """SELECT ['Order'] AS kinds, count(*) AS n, count(*) AS sales FROM lineitem UNION ALL SELECT ['Part'], count(*), count(*) FROM lineitem
           UNION ALL SELECT ['Supplier'], count(*), count(*) FROM lineitem""",
    ),
}

def _text_query(text: str) -> Query:
    return lambda spark, sf_dir: Session(table_graph(spark, sf_dir)).execute(text, _PARAMETERS, now_ms=_NOW_MS).df


def _operator(fn: Callable[[Graph], DataFrame]) -> Query:
    return lambda spark, sf_dir: fn(table_graph(spark, sf_dir))


def _temporal_reference(g: Graph) -> DataFrame:
    """The state each user shows at a fixed reference time."""
    current = g.node_scan(("User",), {"event_type", "_updated_at"})
    refs = current.select("_id", "_kind", F.unix_millis(F.lit(_AT).cast("timestamp")).alias("ts"))
    return ops.reference_states(current, g.version_scan(("User",), {"event_type", "_updated_at"}), refs).select(F.col("_id").alias("u"), F.col("event_type").alias("state"))


#: Tables that a writing query loads into its store: nodes by their label, then edges.
_NODES = {"Region": ("region", "r_regionkey"), "Nation": ("nation", "n_nationkey"), "Customer": ("customer", "c_custkey"), "Order": ("orders", "o_orderkey"), "Part": ("part", "p_partkey")}
_EDGES = {
    "IN_REGION": ("nation", "n_nationkey", "n_regionkey", "Nation", "Region"), "IN_NATION": ("customer", "c_custkey", "c_nationkey", "Customer", "Nation"),
    "PLACED": ("orders", "o_custkey", "o_orderkey", "Customer", "Order"),
}

#: name: (labels and types loaded at time 1000, statements run one after the other from time 2000
#: on, a thousand apart, query whose rows are the result, SQL). Ids of the kinds overlap.
WRITES: dict[str, tuple[str, tuple[str, ...], str, str]] = {
    "create_nodes_and_edges": (
        "Customer", ("MATCH (c:Customer) WHERE c.c_acctbal < 0 CREATE (d:Debt {amount: 0 - c.c_acctbal, note: null})-[:OWED_BY {since: 5}]->(c)",),
        "MATCH (d:Debt)-[r:OWED_BY]->(c:Customer) RETURN id(c) AS c, d.amount AS amount, r.since AS since",
        "SELECT c_custkey AS c, 0 - c_acctbal AS amount, CAST(5 AS BIGINT) AS since FROM customer WHERE c_acctbal < 0",
    ),
    "create_against_direction": (
        "Region Nation", ("MATCH (n:Nation), (r:Region) WHERE n.n_regionkey = r.r_regionkey CREATE (n)<-[:HOLDS]-(r)",),
        "MATCH (r:Region)-[:HOLDS]->(n:Nation) RETURN r.r_name AS region, n.n_name AS nation",
        "SELECT r_name AS region, n_name AS nation FROM nation JOIN region ON r_regionkey = n_regionkey",
    ),
    "set_properties": (
        "Region Nation", ("MATCH (n:Nation) WHERE n.n_regionkey = 1 SET n.n_name = 'renamed', n.mark = n.n_nationkey * 2", "MATCH (n:Nation) WHERE n.n_regionkey = 2 SET n.n_name = null"),
        "MATCH (x) RETURN x.n_name AS nation, x.r_name AS region, x.mark AS mark",
        """SELECT CASE n_regionkey WHEN 1 THEN 'renamed' WHEN 2 THEN NULL ELSE n_name END AS nation, CAST(NULL AS VARCHAR) AS region,
           CASE WHEN n_regionkey = 1 THEN CAST(n_nationkey * 2 AS BIGINT) END AS mark FROM nation UNION ALL SELECT NULL, r_name, NULL FROM region""",
    ),
    "set_edge_properties": (
        "Nation Customer IN_NATION", ("MATCH (c:Customer)-[r:IN_NATION]->(n:Nation) WHERE n.n_regionkey = 2 SET r.weight = c.c_acctbal",),
        "MATCH (c:Customer)-[r:IN_NATION]->(n) RETURN id(c) AS c, r.weight AS weight",
        "SELECT c_custkey AS c, CASE WHEN n_regionkey = 2 THEN c_acctbal END AS weight FROM customer JOIN nation ON n_nationkey = c_nationkey",
    ),
    "versions_of_set": (
        "Nation", ("MATCH (n:Nation) WHERE n.n_regionkey = 1 SET n.n_name = 'first'", "MATCH (n:Nation) WHERE n.n_regionkey < 2 SET n.n_name = 'second'"),
        "MATCH (n:Nation) BETWEEN TIME 1500 AND 3500 RETURN id(n) AS n, n.n_name AS name",
        "SELECT CAST(n_nationkey AS BIGINT) AS n, 'first' AS name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_nationkey, 'second' FROM nation WHERE n_regionkey < 2",
    ),
    "states_before_set": (
        "Nation", ("MATCH (n:Nation) WHERE n.n_regionkey = 1 SET n.n_name = 'later'", "MATCH (n:Nation) SET n.n_name = 'last'"),
        "MATCH (n:Nation) AT TIME 2999 RETURN id(n) AS n, n.n_name AS name",
        "SELECT CAST(n_nationkey AS BIGINT) AS n, CASE WHEN n_regionkey = 1 THEN 'later' ELSE n_name END AS name FROM nation",
    ),
    "remove_property": (
        "Customer", ("MATCH (c:Customer) WHERE c.c_mktsegment = 'BUILDING' REMOVE c.c_acctbal",), "MATCH (c:Customer) RETURN id(c) AS c, c.c_acctbal AS balance",
        "SELECT c_custkey AS c, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END AS balance FROM customer",
    ),
    "remove_label": (
        "Nation", ("MATCH (n:Nation) CREATE (p:Place:Land {k: n.n_nationkey})", "MATCH (p:Land) WHERE p.k < 10 REMOVE p:Land"),
        "MATCH (p:Place) UNWIND labels(p) AS label RETURN p.k AS k, label",
        "SELECT CAST(n_nationkey AS BIGINT) AS k, 'Place' AS label FROM nation UNION ALL SELECT n_nationkey, 'Land' FROM nation WHERE n_nationkey >= 10",
    ),
    "delete_edges": (
        "Customer Order PLACED", ("MATCH (c:Customer)-[r:PLACED]->(o:Order) WHERE o.o_totalprice > 200000 DELETE r",), "MATCH (c:Customer)-[r:PLACED]->(o) RETURN id(c) AS c, id(o) AS o",
        "SELECT o_custkey AS c, o_orderkey AS o FROM orders WHERE NOT o_totalprice > 200000",
    ),
    "delete_nodes": (
        "Customer Region", ("MATCH (c:Customer) WHERE c.c_acctbal < 1000 DELETE c",), "MATCH (x) RETURN id(x) AS x, x.r_name AS region",
        "SELECT c_custkey AS x, CAST(NULL AS VARCHAR) AS region FROM customer WHERE NOT c_acctbal < 1000 UNION ALL SELECT r_regionkey, r_name FROM region",
    ),
    "detach_delete": (
        "Region Nation Customer IN_REGION IN_NATION", ("MATCH (n:Nation) WHERE n.n_regionkey = 3 DETACH DELETE n",), "MATCH (a)-[r]->(b) RETURN type(r) AS kind, id(a) AS a, id(b) AS b",
        """SELECT 'IN_REGION' AS kind, CAST(n_nationkey AS BIGINT) AS a, CAST(n_regionkey AS BIGINT) AS b FROM nation WHERE n_regionkey <> 3
           UNION ALL SELECT 'IN_NATION', c_custkey, c_nationkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 3""",
    ),
    "merge_nodes": (
        "Nation Order", ("MATCH (o:Order) MERGE (n:Nation {n_nationkey: o.o_custkey % 40}) ON CREATE SET n.made = true ON MATCH SET n.seen = true",),
        "MATCH (n:Nation) RETURN n.n_nationkey AS k, n.made AS made, n.seen AS seen",
        """WITH keys AS (SELECT DISTINCT CAST(o_custkey % 40 AS BIGINT) AS k FROM orders), old AS (SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation)
           SELECT coalesce(keys.k, old.k) AS k, CASE WHEN old.k IS NULL THEN true END AS made, CASE WHEN old.k IS NOT NULL AND keys.k IS NOT NULL THEN true END AS seen
           FROM keys FULL JOIN old ON keys.k = old.k""",
    ),
    "merge_edges": (
        "Nation Customer Order IN_NATION PLACED",
        ("MATCH (c:Customer)-[:PLACED]->(o:Order) MATCH (c)-[:IN_NATION]->(n:Nation) MERGE (n)-[r:SERVES]->(c) ON CREATE SET r.made = 1",) * 2,
        "MATCH (n:Nation)-[r:SERVES]->(c) RETURN n.n_name AS nation, id(c) AS c, r.made AS made",
        "SELECT n_name AS nation, c_custkey AS c, CAST(1 AS BIGINT) AS made FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    ),
    "merge_any": (
        "Region Nation", ("MATCH (n:Nation) MERGE (r:Region) MERGE (n)-[:NEAR]->(r)",), "MATCH (n:Nation)-[:NEAR]->(r:Region) RETURN id(n) AS n, id(r) AS r",
        "SELECT CAST(n_nationkey AS BIGINT) AS n, (SELECT CAST(min(r_regionkey) AS BIGINT) FROM region) AS r FROM nation",
    ),
    "create_index": (
        "Part Customer Order PLACED", ("CREATE INDEX by_size ON :Part(p_size)", "CREATE INDEX ON :Part(p_brand)", "MATCH (p:Part) WHERE p.p_size > 45 SET p.p_size = 10", "DROP INDEX by_size"),
        "MATCH (p:Part) WHERE p.p_size = 10 RETURN id(p) AS p, p.p_brand AS brand", "SELECT p_partkey AS p, p_brand AS brand FROM part WHERE p_size = 10 OR p_size > 45",
    ),
    "create_snapshot": (
        "Customer", ("CREATE SNAPSHOT (s:Snap {name: 'rich'}) FROM MATCH (c:Customer) WHERE c.c_acctbal > 5000 RETURN c", "MATCH (c:Customer) WHERE c.c_acctbal > 9000 SET c.c_acctbal = 0"),
        "MATCH (s:Subgraph {name: 'rich'})-[:CONTAINS]->(c) RETURN id(c) AS c", "SELECT c_custkey AS c FROM customer WHERE c_acctbal > 5000",
    ),
    "create_hyperedge": (
        "Region Nation", ("MATCH (r:Region {r_regionkey: 2}), (n:Nation {n_nationkey: 7}) CREATE HYPEREDGE (h:Treaty) FROM (r) TO (n)",),
        "MATCH HYPEREDGE (h:Treaty) MATCH (h)-[:INVOLVES]->(x) RETURN x.r_name AS region, x.n_name AS nation",
        "SELECT r_name AS region, CAST(NULL AS VARCHAR) AS nation FROM region WHERE r_regionkey = 2 UNION ALL SELECT NULL, n_name FROM nation WHERE n_nationkey = 7",
    ),
}


def _write_query(loaded: str, statements: tuple[str, ...], result: str) -> Query:
    """A store of its own under the shared folder, filled, changed, and read."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = open_session(spark, f"{scratch_folder(spark)}/store-{uuid.uuid4().hex}")
        for name in loaded.split():
            if name in _NODES:
                table, key = _NODES[name]
                db.store.load_nodes(name, read(spark, sf_dir, table), key, now_ms=1000)
            else:
                table, src, dst, a, b = _EDGES[name]
                ends = read(spark, sf_dir, table).select(F.col(src).cast("long").alias("_src"), F.col(dst).cast("long").alias("_dst"))
                db.store.load_edges(name, ends, a, b, now_ms=1000)
        for k, text in enumerate(statements):
            db.execute(text, now_ms=2000 + 1000 * k)
        return db.execute(result, now_ms=2000 + 1000 * len(statements)).df

    return run


#: name: (operator over the graph, SQL).
OPERATORS: dict[str, tuple[Callable[[Graph], DataFrame], str]] = {
    "index_scan": (
        lambda g: ops.index_scan(g, "Customer", "c_custkey", 42).select(F.col("_id").alias("c"), F.col("c_name").alias("name")),
        "SELECT c_custkey AS c, c_name AS name FROM customer WHERE c_custkey = 42",
    ),
    "range_scan": (
        lambda g: ops.range_scan(g, "Part", "p_size", 10, 20).select(F.col("_id").alias("p"), F.col("p_size").alias("size")),
        "SELECT p_partkey AS p, CAST(p_size AS BIGINT) AS size FROM part WHERE p_size BETWEEN 10 AND 20",
    ),
    "edge_type_scan": (
        lambda g: ops.edge_type_scan(g, "IN_REGION", columns=set()).select(F.col("_src").alias("nation"), F.col("_dst").alias("region")),
        "SELECT CAST(n_nationkey AS BIGINT) AS nation, CAST(n_regionkey AS BIGINT) AS region FROM nation",
    ),
    "edge_property_scan": (
        lambda g: ops.edge_property_scan(g, "HAS_ITEM", "quantity", 50.0).select(F.col("_src").alias("o"), F.col("_dst").alias("p")),
        "SELECT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_quantity = 50",
    ),
    "find_node": (
        lambda g: ops.find_node(g, ("Part",), p_brand="Brand#17").select(F.col("_id").alias("p")),
        "SELECT min(p_partkey) AS p FROM part WHERE p_brand = 'Brand#17' HAVING count(*) > 0",
    ),
    "temporal_reference": (
        _temporal_reference,
        f"""WITH {_STATES}, old AS (SELECT user_id, max_by(event_type, seq) AS state FROM states WHERE seq < n AND ts <= TIMESTAMP '{_AT}' GROUP BY user_id)
            SELECT s.user_id AS u, coalesce(old.state, s.event_type) AS state FROM states s LEFT JOIN old USING (user_id) WHERE seq = n""",
    ),
    "find_edge": (
        lambda g: ops.find_edge(g, ("Nation", 5), ("Region", 0), "IN_REGION").select(F.col("_src").alias("nation"), F.col("_dst").alias("region")),
        "SELECT CAST(n_nationkey AS BIGINT) AS nation, CAST(n_regionkey AS BIGINT) AS region FROM nation WHERE n_nationkey = 5 AND n_regionkey = 0",
    ),
    "edges_of_a_node": (
        lambda g: ops.edges_of(g, "Supplier", 3, ("SUPPLIES",), set()).select(F.col("_src").alias("s"), F.col("_dst").alias("p")),
        "SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_suppkey = 3",
    ),
    "version_counts": (
        lambda g: ops.version_counts(g, "User").withColumnRenamed("_id", "u"),
        "SELECT user_id AS u, count(*) - 1 AS n, count(*) - 1 AS latest FROM events GROUP BY 1 HAVING count(*) > 1",
    ),
    "subgraphs_of_a_node": (
        lambda g: ops.subgraphs_of(g, "Nation", 5).withColumnRenamed("subgraph_id", "g"),
        "SELECT CAST(n_regionkey AS BIGINT) AS g FROM nation WHERE n_nationkey = 5",
    ),
    "hyperedges_of_an_entity": (
        lambda g: ops.hyperedge_counts(g, ("SALE",), "Part").withColumnRenamed("id", "p"),
        "SELECT l_partkey AS p, count(*) AS n FROM lineitem GROUP BY 1",
    ),
}


def queries() -> dict[str, Query]:
    reading = {n: _text_query(text) for n, (text, _) in TEXTS.items()} | {n: _operator(f) for n, (f, _) in OPERATORS.items()}
    return reading | {n: _write_query(*w[:3]) for n, w in WRITES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (*_, sql) in (*TEXTS.items(), *OPERATORS.items(), *WRITES.items())}


def entry(spark: SparkSession) -> DataFrame:
    """Revenue-bearing customers by region: the four-hop pattern."""
    return queries()["four_hops"](spark, "/root/testdata/sf0.001")
