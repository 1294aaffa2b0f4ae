"""Identity of nodes, durability of commits, hooks and nulls of a stored graph."""

import threading

import pytest
from pyspark.sql import functions as F

from loomgraph.functions.plugins import IndexPlugin, Trigger
from loomgraph.lang.errors import ExecutionError
from loomgraph.plans.writer import open_session
from loomgraph.sources.store import LoomStore


@pytest.fixture
def db(spark, tmp_path):
    return open_session(spark, str(tmp_path / "graph"))


@pytest.fixture
def shared(db, spark):
    """Two labels and two types whose ids overlap."""
    for label in ("A", "B"):
        db.store.load_nodes(label, spark.createDataFrame([(1, label.lower()), (2, "x")], "k long, v string"), "k")
    db.store.load_edges("AB", spark.createDataFrame([(1, 2)], "_src long, _dst long"), "A", "B")
    db.store.load_edges("BA", spark.createDataFrame([(1, 2), (2, 1)], "_src long, _dst long"), "B", "A")
    return db


def values(result):
    return sorted((tuple(r.values()) for r in result.rows()), key=repr)


def test_writes_touch_one_kind_only(shared):
    out = shared.execute("MATCH (n:A {k: 1}) SET n.v = 'z' RETURN n.v AS v, labels(n) AS l")
    assert values(out) == [("z", ["A"])]
    assert values(shared.execute("MATCH (n:B) RETURN n.v")) == [("b",), ("x",)]
    shared.execute("MATCH (n:A {k: 1}) DETACH DELETE n")
    assert values(shared.execute("MATCH (n) RETURN n.k, labels(n)")) == [(1, ["B"]), (2, ["A"]), (2, ["B"])]
    assert values(shared.execute("MATCH (a)-[r]->(b) RETURN type(r), a.k, b.k")) == [("BA", 1, 2)]
    with pytest.raises(ExecutionError):
        shared.execute("MATCH (n:B {k: 1}) DELETE n")


def test_merge_and_delete_of_edges_tell_kinds_apart(shared):
    shared.execute("MATCH (a:A), (b:B) WHERE a.k = b.k MERGE (a)-[r:BA]->(b) ON CREATE SET r.made = 1")
    assert values(shared.execute("MATCH (a)-[r:BA]->(b) RETURN labels(a), a.k, b.k, r.made")) == [(["A"], 1, 1, 1), (["A"], 2, 2, 1), (["B"], 1, 2, None), (["B"], 2, 1, None)]
    shared.execute("MATCH (a:A)-[r:AB]->(b) DELETE r")
    assert shared.store.edge_count() == 4
    assert shared.store.edges_of("A", 1).count() == 2 and shared.store.edges_of("B", 1, ("AB",)).count() == 0


def test_a_broken_manifest_is_passed_over(db):
    db.execute("CREATE (n:P {x: 1})")
    store = db.store
    number = store.newest()
    store.files._write(store.files.path(f"manifest-{number + 1:09d}.json"), "")
    store.files._write(store.files.path(f"manifest-{number + 2:09d}.json"), '{"next_id": 5, "no')
    assert LoomStore(db.spark, store.root).newest() == number and values(db.execute("MATCH (n:P) RETURN n.x")) == [(1,)]
    db.execute("CREATE (n:P {x: 2})")
    assert store.newest() == number + 3 and values(db.execute("MATCH (n:P) RETURN n.x")) == [(1,), (2,)]
    assert store.graph_at(number).node_scan(()).count() == 1
    with pytest.raises(ExecutionError):
        store.graph_at(number + 1)
    assert not [n for n in store.files.names() if n.startswith(".manifest")]


def test_one_of_many_writers_takes_a_number(db):
    store, won = db.store, []

    def write(k):
        if store.files.create("manifest-000000007.json", f'{{"by": {k}}}'):
            won.append(k)

    db.execute("CREATE (n:P)")
    threads = [threading.Thread(target=write, args=(k,)) for k in range(6)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert len(won) == 1 and store.files.read("manifest-000000007.json") == f'{{"by": {won[0]}}}'


def test_manifests_without_hard_links(db):
    files = db.store.files
    db.execute("CREATE (n:P)")
    files._link = lambda part, target: (_ for _ in ()).throw(RuntimeError("no links here"))
    assert files.create("manifest-000000009.json", "{}") and not files.create("manifest-000000009.json", "[]")
    assert files.read("manifest-000000009.json") == "{}"


def test_hooks_wait_for_the_commit(db):
    class Watch(Trigger):
        name = "watch"

        def __init__(self):
            self.seen = []

        def after_create(self, changes):
            self.seen += [r["label"] for r in changes.collect()]

    watch = Watch()
    db.register_trigger(watch)
    tx = db.begin()
    tx.execute("CREATE (n:Gone)")
    assert watch.seen == []
    tx.rollback()
    assert watch.seen == []
    with db.begin() as tx:
        tx.execute("CREATE (n:First)")
        tx.execute("CREATE (n:Second)")
        assert watch.seen == []
    assert watch.seen == ["First", "Second"]
    db.execute("CREATE (n:Third)")
    assert watch.seen[2:] == ["Third"]


def test_null_properties(db):
    db.execute("CREATE (p:P {n: null, m: 1})")
    db.execute("CREATE (p:P {n: 5, m: 2})-[:R {w: null}]->(q:P {m: 3})")
    db.execute("CREATE (p:P {n: null, m: 4})")
    assert values(db.execute("MATCH (p:P) RETURN p.m, p.n")) == [(1, None), (2, 5), (3, None), (4, None)]
    db.execute("MERGE (p:P {n: null, m: 9})")
    db.execute("MATCH (p:P {m: 2}) SET p.n = null, p.other = null")
    db.execute("MATCH (p:P {m: 2})-[r:R]->(q) SET r.w = $none", {"none": None})
    assert values(db.execute("MATCH (p:P) RETURN p.m, p.n")) == [(1, None), (2, None), (3, None), (4, None), (9, None)]


def test_versions_and_look_ups(db):
    db.execute("CREATE (p:P {n: 1})-[:R {w: 2}]->(q:P {n: 7})", now_ms=1000)
    for k in (2, 3):
        db.execute("MATCH (p:P) WHERE p.n < 7 SET p.n = $k", {"k": k}, now_ms=1000 * k)
    store = db.store
    one = store.look_up("P", "n", 3).first()["_id"]
    assert [r["n"] for r in store.versions("P", one).orderBy("_seq").collect()] == [1, 2]
    assert store.version("P", one, 1).first()["n"] == 1 and store.latest_version("P", one).first()["n"] == 2 and store.version("P", one, 9).count() == 0
    assert store.node("P", one).first()["n"] == 3 and store.node("Q", one).count() == 0
    edge = store.graph().edge_scan(("R",)).first()["_id"]
    assert store.edge("R", edge).first()["w"] == 2 and store.edges_of("P", one).count() == 1 and store.versions("None", 1).count() == 0
    db.execute("CREATE INDEX by_n ON :P(n)")
    db.execute("CREATE EDGE INDEX by_w ON :R(w)")
    assert [(i["name"], i["on"], i["key"], i["edge"]) for i in store.indexes()] == [("by_n", "P", "n", False), ("by_w", "R", "w", True)]
    assert sorted(r["n"] for r in store.look_up_range("P", "n", 2, 8).collect()) == [3, 7]
    assert values(db.execute("MATCH (a)-[r:R {w: 2}]->(b) RETURN a.n, b.n")) == [(3, 7)]
    db.execute("DROP INDEX by_w")
    assert len(store.indexes()) == 1
    assert store.edge_versions("R", edge).count() == 0 and store.snapshot_edge("R", edge) == 1
    db.execute("MATCH (a)-[r:R]->(b) SET r.w = 5")
    assert store.snapshot_edge("R", edge) == 2 and [r["w"] for r in store.edge_versions("R", edge).orderBy("_seq").collect()] == [2, 5]
    with pytest.raises(ExecutionError):
        store.snapshot_edge("R", edge + 99)


def test_changes_go_to_a_patch(db, spark):
    """A changed table is its files and one patch, until the patch is a large share of it."""
    db.store.load_nodes("N", spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("s")), "k")
    entry = lambda: db.store.manifest()[1]["nodes"]["N"]
    before = entry()["paths"]
    db.execute("MATCH (n:N) WHERE n.k < 10 SET n.v = 100")
    db.execute("MATCH (n:N) WHERE n.k >= 5 AND n.k < 15 SET n.v = n.v + 1, n.new = 'x'")
    db.execute("MATCH (n:N) WHERE n.k = 7 OR n.k = 19000 DELETE n")
    db.execute("CREATE (n:N {k: 20000, v: 1})")
    assert entry()["patch"] and entry()["paths"][0] == before[0] and len(entry()["paths"]) == 2
    want = {k: k % 7 for k in range(20_000)} | {20_000: 1}
    want |= {k: 100 for k in range(5)} | {k: 101 for k in range(5, 10)} | {k: k % 7 + 1 for k in range(10, 15)}
    del want[7], want[19_000]
    got = {r["k"]: (r["v"], r["new"]) for r in db.execute("MATCH (n:N) RETURN n.k AS k, n.v AS v, n.new AS new").rows()}
    assert {k: v for k, (v, _) in got.items()} == want and sorted(k for k, (_, n) in got.items() if n) == [5, 6, 8, 9, *range(10, 15)]
    db.store.load_nodes("N", spark.createDataFrame([(19_000, 3)], "k long, v long"), "k")
    assert not entry().get("patch") and len(db.execute("MATCH (n:N {k: 19000}) RETURN n")) == 1
    db.execute("MATCH (n:N) WHERE n.k = 3 SET n.v = 0.5")  # a wider type
    assert db.execute("MATCH (n:N {k: 3}) RETURN n.v AS v").rows() == [{"v": 0.5}]
    db.execute("MATCH (n:N) SET n.v = 7.0")
    assert not entry().get("patch") and db.store.node_count() == 20_000


def test_subgraphs_and_hyperedges_are_deleted(db):
    db.execute("CREATE (p:P {n: 1})", now_ms=10)
    db.execute("CREATE (p:P {n: 2})", now_ms=10)
    db.execute("CREATE SNAPSHOT (s:S {name: 'all'}) FROM MATCH (p:P) RETURN p", now_ms=20)
    db.execute("MATCH (a:P {n: 1}), (b:P {n: 2}) CREATE HYPEREDGE (h:H) FROM (a) TO (b)", now_ms=20)
    store = db.store
    graph = store.graph()
    member = graph.member_scan().orderBy("node_id").first()
    store.remove_member(member["subgraph_id"], member["node_id"], "Q")
    assert store.graph().member_scan().count() == 2
    store.remove_member(member["subgraph_id"], member["node_id"], "P")
    assert values(db.execute("MATCH (s:Subgraph)-[:CONTAINS]->(p) RETURN p.n")) == [(2,)]
    store.delete_hyperedge(graph.hyperedge_scan().first()["_id"])
    store.delete_subgraph(member["subgraph_id"])
    g = store.graph()
    assert (g.hyperedge_scan().count(), g.subgraph_scan().count(), g.member_scan().count()) == (0, 0, 0)


def test_index_plugins(db):
    import inspect

    methods = [n for n, m in vars(IndexPlugin).items() if inspect.isfunction(m)]
    body = {n: (lambda self, *a, **k: None) for n in methods if not n.startswith("__")}
    plugin = type("Mine", (IndexPlugin,), {"name": "mine", **body})()
    db.register_index_plugin(plugin)
    assert db.list_index_plugins() == [("mine", "1.0")] and db.index_plugin("mine") is plugin


@pytest.mark.parametrize("seed", range(2))
def test_paths_and_states_are_those_of_a_model(db, spark, seed):
    """Random graphs: paths that meet no node twice, and states at any time, against a plain model."""
    import random

    rng = random.Random(seed)
    n = 7
    edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(12)}
    db.store.load_nodes("N", spark.createDataFrame([(i, i * 10) for i in range(n)], "k long, v long"), "k", now_ms=1000)
    db.store.load_edges("E", spark.createDataFrame(sorted(edges), "_src long, _dst long"), "N", "N", now_ms=1000)

    def walks(path, least, most):
        found = [path[-1]] if len(path) > least else []
        if len(path) <= most:
            for a, b in edges:
                if a == path[-1] and b not in path:
                    found += walks([*path, b], least, most)
        return found

    for least, most in ((1, 3), (0, 2), (2, 4)):
        want = sorted((s, e) for s in range(n) for e in walks([s], least, most))
        assert values(db.execute(f"MATCH (a:N)-[:E*{least}..{most}]->(b) RETURN a.k, b.k")) == sorted(want, key=repr)
    states = {i: [(1000, i * 10)] for i in range(n)}
    for t in (2000, 3000):
        low = rng.randrange(n)
        db.execute("MATCH (x:N) WHERE x.k >= $low SET x.v = x.v + 1", {"low": low}, now_ms=t)
        for i in range(low, n):
            states[i].append((t, states[i][-1][1] + 1))
    for at in (999, 1000, 1500, 2000, 2999, 3000, 9000):
        want = sorted(((i, [v for t, v in s if t <= at][-1]) for i, s in states.items() if s[0][0] <= at), key=repr)
        assert values(db.execute(f"MATCH (x:N) AT TIME {at} RETURN x.k, x.v")) == want
    low, high = 1500, 2500
    want = sorted(((i, v) for i, s in states.items() for t, v in s if low <= t <= high), key=repr)
    assert values(db.execute(f"MATCH (x:N) BETWEEN TIME {low} AND {high} RETURN x.k, x.v")) == want
