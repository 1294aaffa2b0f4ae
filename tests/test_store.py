"""Writing statements over a stored graph, on tiny graphs."""

import pytest

from loomgraph.functions.plugins import PluginError, ScalarFunction, Trigger
from loomgraph.lang.errors import ExecutionError, SemanticError, TypeMismatch
from loomgraph.plans.writer import open_session
from pyspark.sql import functions as F
from pyspark.sql import types as T


@pytest.fixture
def db(spark, tmp_path):
    return open_session(spark, str(tmp_path / "graph"))


def values(result):
    return sorted((tuple(r.values()) for r in result.rows()), key=repr)


def test_create_match_set_remove_delete(db):
    db.execute("CREATE (a:Person {name: 'Alice', age: 30})-[:KNOWS {since: 5}]->(b:Person {name: 'Bob', age: 25})", now_ms=1000)
    db.execute("CREATE (c:Person:Worker {name: 'Carol'})", now_ms=1000)
    assert values(db.execute("MATCH (n:Person) RETURN n.name, n.age")) == [("Alice", 30), ("Bob", 25), ("Carol", None)]
    assert values(db.execute("MATCH (n:Worker) RETURN n.name, labels(n)")) == [("Carol", ["Person", "Worker"])]
    assert values(db.execute("MATCH (a)-[r:KNOWS]->(b) RETURN a.name, r.since, b.name, type(r)")) == [("Alice", 5, "Bob", "KNOWS")]
    out = db.execute("MATCH (n:Person {name: 'Bob'}) SET n.age = n.age + 1, n.city = 'Oslo' RETURN n.age AS age, n.city AS city", now_ms=2000)
    assert values(out) == [(26, "Oslo")]
    db.execute("MATCH (n:Person {name: 'Carol'}) REMOVE n:Worker", now_ms=2500)
    assert values(db.execute("MATCH (n:Worker) RETURN n.name")) == []
    with pytest.raises(ExecutionError):
        db.execute("MATCH (n:Person {name: 'Bob'}) DELETE n")
    with pytest.raises(ExecutionError):
        db.execute("MATCH (n:Person) SET n._created_at = 1")
    db.execute("MATCH (n:Person {name: 'Bob'}) DETACH DELETE n")
    assert values(db.execute("MATCH (n) RETURN n.name")) == [("Alice",), ("Carol",)]
    assert values(db.execute("MATCH (a)-[r]->(b) RETURN r")) == []


def test_states_in_time(db):
    db.execute("CREATE (n:Person {name: 'A', age: 1})", now_ms=1000)
    db.execute("MATCH (n:Person) SET n.age = 2", now_ms=2000)
    db.execute("MATCH (n:Person) SET n.age = 3", now_ms=3000)

    def at(ms):
        return values(db.execute(f"MATCH (n:Person) AT TIME {ms} RETURN n.age"))

    assert [at(ms) for ms in (500, 1000, 1999, 2000, 2500, 3000, 9000)] == [[], [(1,)], [(1,)], [(2,)], [(2,)], [(3,)], [(3,)]]
    assert values(db.execute("MATCH (n:Person) BETWEEN TIME 1500 AND 3000 RETURN n.age")) == [(2,), (3,)]
    assert values(db.execute("MATCH (n:Person) BETWEEN TIME 3000 AND 1500 RETURN n.age")) == []
    assert values(db.execute("MATCH (n:Person {age: 2}) AT TIME 2500 RETURN n.name")) == [("A",)]


def test_edges_in_time(db):
    db.execute("CREATE (a:Start {name: 'a'})-[:LINK {_valid_from: 500, _valid_to: 1500}]->(b:End {name: 'b'})", now_ms=1400)

    def at(ms):
        return len(db.execute(f"MATCH (a:Start)-[:LINK]->(b) AT TIME {ms} RETURN b.name"))

    assert [at(ms) for ms in (1399, 1400, 1499, 1500)] == [0, 1, 1, 0]
    assert len(db.execute("MATCH (a:Start)-[:LINK]->(b) BETWEEN TIME 1400 AND 9000 RETURN b.name")) == 1
    assert len(db.execute("MATCH (a:Start)-[:LINK]->(b) BETWEEN TIME 100 AND 1399 RETURN b.name")) == 0
    db.execute("MATCH (a:Start) SET a.name = 'c'", now_ms=2000)
    assert len(db.execute("MATCH (a:Start)-[:LINK]->(b) BETWEEN TIME 1500 AND 9000 RETURN b.name")) == 0


def test_merge(db):
    for _ in range(2):
        db.execute("UNWIND [1, 1, 2] AS k MERGE (n:K {k: k}) ON CREATE SET n.made = true ON MATCH SET n.seen = k * 10", now_ms=1)
    assert values(db.execute("MATCH (n:K) RETURN n.k, n.made, n.seen")) == [(1, True, 10), (2, True, 20)]
    for _ in range(2):
        db.execute("MATCH (a:K {k: 1}), (b:K {k: 2}) MERGE (a)-[:R]->(b)", now_ms=1)
    assert values(db.execute("MATCH (a)-[:R]->(b) RETURN a.k, b.k")) == [(1, 2)]


def test_match_create_joins_what_is_bound(db):
    db.execute("CREATE (a:A {x: 1})")
    db.execute("CREATE (b:B {x: 2})")
    db.execute("MATCH (a:A), (b:B) CREATE (b)<-[:R]-(a)")
    assert values(db.execute("MATCH (a:A)-[:R]->(b:B) RETURN a.x, b.x")) == [(1, 2)]
    assert db.store.node_count() == 2 and db.store.edge_count() == 1


def test_snapshots_and_hyperedges(db):
    db.execute("CREATE (a:Person {name: 'A', v: 1})", now_ms=50)
    db.execute("CREATE (b:Person {name: 'B'})", now_ms=50)
    db.execute("CREATE (c:Animal {name: 'C'})", now_ms=50)
    db.execute("MATCH (a:Person {name: 'A'}) SET a.v = 2", now_ms=200)
    db.execute("CREATE SNAPSHOT (s:Snap {name: 'people'}) AT TIME 1700 FROM MATCH (n:Person) RETURN n", now_ms=300)
    assert values(db.execute("MATCH (s:Subgraph {name: 'people'})-[:CONTAINS]->(n) RETURN n.name")) == [("A",), ("B",)]
    db.execute("MATCH (a:Person {name: 'A'}), (b:Person {name: 'B'}) CREATE HYPEREDGE (h:Met) FROM (a AT TIME 100) TO (b)", now_ms=300)
    db.execute("MATCH (a:Person {name: 'A'}) SET a.v = 3", now_ms=400)
    db.execute("CREATE HYPEREDGE (h:Empty) FROM () TO ()", now_ms=300)
    assert len(db.execute("MATCH HYPEREDGE (h) RETURN h")) == 2
    assert len(db.execute("MATCH HYPEREDGE (h:Met) RETURN h")) == 1
    assert values(db.execute("MATCH HYPEREDGE (h:Met) MATCH (h)-[:INVOLVES]->(x) RETURN x.name")) == [("A",), ("B",)]


def test_transactions_indexes_and_conflicts(db):
    with pytest.raises(RuntimeError), db.begin() as tx:
        tx.execute("CREATE (n:T {x: 1})")
        assert len(tx.execute("MATCH (n:T) RETURN n")) == 1
        raise RuntimeError
    assert len(db.execute("MATCH (n:T) RETURN n")) == 0
    with db.begin() as tx:
        tx.execute("CREATE (n:T {x: 1})")
        tx.execute("CREATE (n:T {x: 2})")
    assert len(db.execute("MATCH (n:T) RETURN n")) == 2
    db.execute("CREATE INDEX ON :T(x)")
    with pytest.raises(ExecutionError):
        db.execute("CREATE INDEX idx_T_x ON :T(y)")
    assert values(db.execute("MATCH (n:T {x: 2}) RETURN n.x")) == [(2,)]
    db.execute("DROP INDEX idx_T_x")
    with pytest.raises(ExecutionError):
        db.execute("DROP INDEX idx_T_x")
    a, b = db.store.begin(), db.store.begin()
    a.commit()
    with pytest.raises(ExecutionError):
        b.commit()


def test_errors(db):
    db.execute("CREATE (n:E {x: 1, s: 'a'})")
    for text in ("MATCH (n:E) WHERE n.x = 'a' RETURN n", "MATCH (n:E) RETURN n.s + 1", "MATCH (n:E) WHERE n.x RETURN n", "MATCH (n:E) RETURN sum(n.s)"):
        with pytest.raises(TypeMismatch):
            db.execute(text)
    for text in ("RETURN m", "MATCH (n)-[*3..2]->(m) RETURN m", "MATCH (n)-[*1..11]->(m) RETURN m", "MATCH (n:E) RETURN nope(n.x)", "MATCH (n)-[n]->(m) RETURN n", "MATCH (n) WHERE count(*) > 1 RETURN n"):
        with pytest.raises(SemanticError):
            db.execute(text)


def test_values_and_nulls(db):
    def one(text, **params):
        return db.execute(f"RETURN {text} AS v", params).rows()[0]["v"]

    assert [one(e) for e in ("7 / 2", "-7 / 2", "-7 % 3", "7 / 2.0", "1 + 2 * 3", "NOT (null = 1)", "null IS NULL", "null AND false", "1 = 1.0")] == [3, -3, -1, 3.5, 7, True, True, False, True]
    assert one("9223372036854775807 + 1") == -(1 << 63) and one("9223372036854775807 * 3") == 9223372036854775805
    assert one("-9223372036854775807 - 5") == 9223372036854775804 and one("4611686018427387905 * 6") == ((4611686018427387905 * 6 + (1 << 63)) % (1 << 64)) - (1 << 63)
    assert one("$p", p="x") == "x" and one("$missing") is None


def test_plugins(db, spark):
    class Double(ScalarFunction):
        name, returns = "double", T.LongType()

        def column(self, x):
            return x * 2

    class Slow(ScalarFunction):
        name, returns = "shout", T.StringType()

        def call(self, s):
            return s.str.upper()

    class Guard(Trigger):
        name = "guard"

        def __init__(self):
            self.seen = []

        def before_create(self, changes):
            if changes.where(F.col("properties").contains("forbidden")).count():
                raise PluginError("refused")

        def after_create(self, changes):
            self.seen += [r["label"] for r in changes.collect()]

    db.register_function(Double())
    with pytest.raises(PluginError):
        db.register_function(Double())
    assert db.execute("UNWIND [21] AS x RETURN double(x) AS v").rows() == [{"v": 42}]
    guard = Guard()
    db.register_trigger(guard)
    db.execute("CREATE (n:G {s: 'fine'})")
    with pytest.raises(PluginError):
        db.execute("CREATE (n:G {s: 'forbidden'})")
    assert guard.seen == ["G"] and len(db.execute("MATCH (n:G) RETURN n")) == 1
    db.register_function(Slow())
    assert db.execute("MATCH (n:G) RETURN shout(n.s) AS v").rows() == [{"v": "FINE"}]
    data = db.export_data("json", "MATCH (n:G) RETURN n, n.s AS s")
    assert db.import_data("json", data) == [{"s": "fine"}] and b"fine" in db.export_data("csv", "MATCH (n:G) RETURN n.s AS s")
    with pytest.raises(PluginError):
        db.export_data("none", "MATCH (n) RETURN n")
    assert db.list_functions() == [("double", "1.0"), ("shout", "1.0")]


def test_paths(db):
    db.execute("CREATE (a:C {i: 0})-[:N]->(b:C {i: 1})-[:N]->(c:C {i: 2})-[:N]->(d:C {i: 3})")
    db.execute("MATCH (d:C {i: 3}), (a:C {i: 0}) CREATE (d)-[:N]->(a)")
    assert values(db.execute("MATCH (a:C {i: 0})-[:N*]->(x) RETURN x.i")) == [(1,), (2,), (3,)]
    assert values(db.execute("MATCH (a:C {i: 0})-[:N*0..1]->(x) RETURN x.i")) == [(0,), (1,)]
    assert values(db.execute("MATCH (a:C {i: 0})-[:N*2]-(x) RETURN x.i")) == [(2,), (2,)]
    assert values(db.execute("MATCH (a:C)-[:N]->(b)-[:N]->(c)-[:N]->(d)-[:N]->(a) RETURN count(*)")) == [(4,)]
