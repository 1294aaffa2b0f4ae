"""Options, reading sessions and results."""

import pytest

from loomgraph.lang.errors import ExecutionError, SemanticError
from loomgraph.plans.compiler import Options
from loomgraph.plans.writer import open_session
from loomgraph.session import Session
from loomgraph.sources.tables import table_graph

SF = "/root/testdata/sf0.001"


def test_null_comparisons_follow_the_option(spark):
    text = "MATCH (r:Region) WHERE NOT (r.missing = 1) RETURN count(*) AS n"
    assert Session(table_graph(spark, SF)).execute(text).rows() == [{"n": 5}]
    text = "MATCH (r:Region) WITH r.r_name AS x, null AS y WHERE NOT (x = y) RETURN count(*) AS n"
    assert Session(table_graph(spark, SF), Options(null_is_false=False)).execute(text).rows() == [{"n": 0}]


def test_results_keep_the_order_of_return_and_a_schema(spark):
    result = Session(table_graph(spark, SF)).execute("MATCH (r:Region {r_name: 'none'}) RETURN r.r_name, r AS id, 1 AS a")
    assert result.columns == ("r.r_name", "id", "a") and result.df.columns == list(result.columns) and result.rows() == []


def test_tables_are_read_only(spark):
    session = Session(table_graph(spark, SF))
    with pytest.raises(ExecutionError):
        session.execute("CREATE (n:X)")
    with pytest.raises(SemanticError):
        session.execute("MATCH (n:Region) RETURN n MATCH (m) RETURN m")
    with pytest.raises(SemanticError):
        session.execute("MATCH (n:Region) RETURN n.r_name AS x, n AS x")
    with pytest.raises(SemanticError):
        session.execute("MATCH (n:Region) RETURN n LIMIT -1")
    with pytest.raises(SemanticError):
        session.execute("MATCH (n:Region) RETURN n.r_name AS a, n.r_name + count(*) AS b")


def test_the_far_end_is_joined_only_if_it_is_needed(spark):
    session = Session(table_graph(spark, SF))
    assert "orders.parquet" in session.explain("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.c_name, id(o)")
    plan = session.explain("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.n_name, id(r)")
    assert "region.parquet" not in plan and "region.parquet" in session.explain("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.r_name")


def test_readers_keep_their_state(spark, tmp_path):
    db = open_session(spark, str(tmp_path / "g"))
    db.execute("CREATE (n:A {x: 1})")
    first = db.store.newest()
    early = db.execute("MATCH (n:A) RETURN n.x AS x")
    db.execute("MATCH (n:A) SET n.x = 2")
    assert early.rows() == [{"x": 1}] and db.execute("MATCH (n:A) RETURN n.x AS x").rows() == [{"x": 2}]
    assert Session(db.store.graph_at(first)).execute("MATCH (n:A) RETURN n.x AS x").rows() == [{"x": 1}]
    assert db.store.graph_at(0).nodes == {}


def test_a_failed_statement_leaves_no_trace_in_its_transaction(spark, tmp_path):
    db = open_session(spark, str(tmp_path / "g"))
    with db.begin() as tx:
        tx.execute("CREATE (n:A {x: 1})-[:R]->(m:A {x: 2})")
        with pytest.raises(ExecutionError):
            tx.execute("MATCH (n:A {x: 1}) SET n.x = 5 DELETE n")
        assert [r["x"] for r in tx.execute("MATCH (n:A) RETURN n.x AS x ORDER BY x").rows()] == [1, 2]
    assert len(db.execute("MATCH (n:A)-[:R]->(m) RETURN n")) == 1
