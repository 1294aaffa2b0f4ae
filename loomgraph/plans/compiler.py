"""Clauses to DataFrames.

A frame is a DataFrame and what its variables are. A variable that is a node or an edge
is a group of flat columns (`n._id`, `n._kind`, `n.<property>`), so that Catalyst prunes
and pushes down; only the properties that the query names are ever taken along, and the
table of a node at the end of an edge is joined only if one of them, or a label that
its kind does not settle, is needed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as x
from ..functions.expressions import Scope, Typed
from ..lang import tree as t
from ..lang.errors import SemanticError, TypeMismatch
from ..lang.parser import MOST_HOPS
from ..operators import expansions as ops
from ..operators import temporal
from ..operators.grouping import sort_limit
from ..sources.graph import Graph

#: Labels and types with a meaning of their own.
SUBGRAPH, CONTAINS, INVOLVES = "Subgraph", "CONTAINS", "INVOLVES"


@dataclass(frozen=True)
class Options:
    """null_is_false: a comparison with null is false, not null. wrap: integers wrap around.
    most_hops: the longest path that may be asked for."""

    null_is_false: bool = True
    wrap: bool = True
    most_hops: int = MOST_HOPS


@dataclass(frozen=True)
class Binding:
    """kind: node, edge, subgraph, hyperedge or value; joined: a node's own table is part of the frame."""

    kind: str
    joined: bool = True
    type: str = "any"


@dataclass(frozen=True)
class Frame:
    df: DataFrame
    scope: dict[str, Binding] = field(default_factory=dict)
    names: tuple[str, ...] = ()  # result columns after RETURN


def col(var: str, key: str | None = None) -> F.Column:
    return F.col(f"`{var}.{key}`" if key else f"`{var}`")


def needs_of(query: t.Query) -> dict[str, set[str]]:
    """The properties that a query reads of each variable, over renamings by WITH."""
    needs: dict[str, set[str]] = defaultdict(set)
    renamed: list[tuple[str, str]] = []

    def see(e) -> None:
        for one in t.walk(e) if e is not None else ():
            if isinstance(one, t.Prop) and isinstance(one.base, t.Var):
                needs[one.base.name].add(one.key)
            if isinstance(one, t.Call) and one.name == "labels" and one.args and isinstance(one.args[0], t.Var):
                needs[one.args[0].name].add("_labels")

    def chains(cs) -> None:
        for c in cs:
            for p in (*c.nodes, *c.rels):
                for key, value in p.props:
                    needs[p.var].add(key)
                    see(value)

    def one(c) -> None:
        match c:
            case t.Match():
                chains(c.chains)
                see(c.where)
                if c.temporal:
                    see(c.temporal.first)
                    see(c.temporal.second)
            case t.Return() | t.With():
                for i in c.items:
                    see(i.expr)
                    if isinstance(i.expr, t.Var) and i.alias:
                        renamed.append((i.expr.name, i.alias))
                for s in getattr(c, "order", ()):
                    see(s.expr)
                see(getattr(c, "where", None))
            case t.Unwind():
                see(c.expr)
            case t.Create():
                chains(c.chains)
            case t.Merge():
                chains(c.chains)
                for a in (*c.on_match, *c.on_create):
                    see(a.value)
            case t.SetClause():
                for a in c.items:
                    see(a.value)
            case t.CreateSnapshot():
                one(c.match)
                for i in c.items:
                    see(i.expr)
                for _, v in c.props:
                    see(v)

    for c in query.clauses:
        one(c)
    while True:
        before = sum(map(len, needs.values()))
        for old, new in renamed:
            needs[old] |= needs[new]
        if sum(map(len, needs.values())) == before:
            return needs


class Compiler:
    """Compiles the reading clauses of one query over one graph."""

    def __init__(self, graph: Graph, needs: dict[str, set[str]], params: dict, now_ms: int, functions: dict, options: Options, written: Callable[[DataFrame], DataFrame] | None = None):
        self.graph, self.needs, self.params, self.now_ms = graph, needs, params, now_ms
        self.functions, self.options, self.written = functions, options, written

    # -- expressions

    def scope(self, frame: Frame, given: dict | None = None) -> Scope:
        columns = dict(frame.df.dtypes)

        def lookup(name: str) -> Typed:
            b = frame.scope.get(name)
            if b is None:
                raise SemanticError(f"{name} is not defined")
            return Typed(col(name), b.type) if b.kind == "value" else Typed(col(name, "_id"), b.kind)

        def prop(name: str, key: str) -> Typed:
            b = frame.scope.get(name)
            if b is None:
                raise SemanticError(f"{name} is not defined")
            if b.kind == "value":
                if b.type == "null":
                    return Typed(F.lit(None), "null")
                raise TypeMismatch(f"{name} is a {b.type} and has no properties")
            full = f"{name}.{key}"
            if full not in columns:
                return Typed(F.lit(None), "null")
            return Typed(F.col(f"`{full}`"), x.type_of(frame.df.schema[full].dataType))

        o = self.options
        return Scope(lookup, prop, self.params, self.now_ms, self.functions, o.null_is_false, o.wrap, given)

    def value(self, frame: Frame, e: t.Expr) -> Typed:
        return x.compile_value(e, self.scope(frame))

    def filtered(self, frame: Frame, e: t.Expr | None) -> Frame:
        if e is None:
            return frame
        return replace(frame, df=frame.df.where(x.compile_filter(e, self.scope(frame))))

    def instant(self, frame: Frame, e: t.Expr) -> F.Column:
        """A time: an instant, or milliseconds."""
        v = self.value(frame, e)
        if v.type == "datetime":
            return v.col
        if v.type == "int":
            return F.timestamp_millis(v.col)
        raise TypeMismatch(f"a time is a {v.type}; use datetime('...') or milliseconds")

    def start(self) -> Frame:
        return Frame(self.graph.spark.range(1).select())

    # -- scans

    def node_table(self, var: str, labels: tuple[str, ...], temporal_: t.Temporal | None, whole: bool, frame: Frame) -> DataFrame:
        """The nodes of a pattern with the needed properties; under a time, as they were then.

        whole: every state in the range of BETWEEN; else the current one."""
        columns = set(self.needs[var]) - {"_labels"}
        if temporal_ is None:
            return self.graph.node_scan(labels, columns)
        times = {"_created_at", "_updated_at"}
        current = self.graph.node_scan(labels, columns | times)
        versions = self.graph.version_scan(labels, columns | times)
        if temporal_.kind == "at":
            return temporal.nodes_at(current, versions, self.instant(frame, temporal_.first))
        if whole:
            return temporal.nodes_between(current, versions, self.instant(frame, temporal_.first), self.instant(frame, temporal_.second))
        return current

    def edge_table(self, rel: t.RelPattern, temporal_: t.Temporal | None, frame: Frame) -> DataFrame:
        columns = set(self.needs[rel.var])
        wanted = columns | ({"_valid_from", "_valid_to"} if temporal_ else set())
        edges = self.graph.edge_scan(rel.types, wanted)
        if temporal_ is not None:
            a = self.instant(frame, temporal_.first)
            edges = temporal.valid_at(edges, a) if temporal_.kind == "at" else temporal.valid_between(edges, a, self.instant(frame, temporal_.second))
            edges = edges.select(*[c for c in edges.columns if c in columns or c not in ("_valid_from", "_valid_to")])
        return edges

    def named(self, df: DataFrame, var: str) -> DataFrame:
        keep = {"_id", "_kind", "_type"} | self.needs[var]
        return df.select(*[F.col(f"`{c}`").alias(f"{var}.{c}") for c in df.columns if c in keep])

    def inline(self, frame: Frame, var: str, props) -> Frame:
        for key, value in props:
            frame = self.filtered(frame, t.Binary("=", t.Prop(t.Var(var), key), value))
        return frame

    # -- MATCH

    def match(self, frame: Frame, m: t.Match) -> Frame:
        for chain in m.chains:
            self.check_chain(frame, chain)
        if m.optional:
            return self.optional(frame, m)
        first = m.chains[0].nodes[0].var
        for chain in m.chains:
            frame = self.chain(frame, chain, m.temporal, first)
        return self.filtered(frame, m.where)

    def check_chain(self, frame: Frame, chain: t.Chain) -> None:
        kinds = {k: b.kind for k, b in frame.scope.items()}
        for p, kind in [*((n, "node") for n in chain.nodes), *((r, "edge") for r in chain.rels)]:
            known = kinds.get(p.var)
            if known is not None and known != kind and not (kind == "node" and known in ("subgraph", "hyperedge")):
                raise SemanticError(f"{p.var} is a {known} already, not a {kind}")
            kinds.setdefault(p.var, kind)
        for r in chain.rels:
            if r.hops and (r.hops[1] < r.hops[0] or r.hops[1] > self.options.most_hops):
                raise SemanticError(f"a path of {r.hops[0]} to {r.hops[1]} edges; at most {self.options.most_hops}")

    def chain(self, frame: Frame, chain: t.Chain, when: t.Temporal | None, whole: str | None) -> Frame:
        """The frame joined with a chain: from an end that is bound, else by the shared variables."""
        if chain.nodes[0].var in frame.scope:
            return self.walk(frame, chain, when, whole)
        if chain.nodes[-1].var in frame.scope and not any(r.hops for r in chain.rels):
            return self.walk(frame, turned(chain), when, whole)
        alone = self.walk(self.start(), chain, when, whole)
        if not frame.scope:
            return replace(alone, df=alone.df)
        return self.joined(frame, alone, "inner")

    def joined(self, frame: Frame, other: Frame, how: str, null_safe: bool = False) -> Frame:
        """A join on the variables both have; a product without any."""
        shared = [v for v in other.scope if v in frame.scope]
        keys = [c for v in shared for c in ((f"{v}._id", f"{v}._kind") if other.scope[v].kind == "node" else (f"{v}._id",) if other.scope[v].kind != "value" else (v,)) if c in other.df.columns and c in frame.df.columns]
        right = other.df.select(*[F.col(f"`{c}`").alias(f"__{c}" if c in keys else c) for c in other.df.columns if c in keys or c not in frame.df.columns])
        on = None
        for c in keys:
            here, there = F.col(f"`{c}`"), F.col(f"`__{c}`")
            test = here.eqNullSafe(there) if null_safe else here == there
            on = test if on is None else on & test
        out = frame.df.crossJoin(right) if on is None else frame.df.join(right, on, how)
        out = out.drop(*[f"__{c}" for c in keys])
        return Frame(out, {**other.scope, **frame.scope})

    def walk(self, frame: Frame, chain: t.Chain, when: t.Temporal | None, whole: str | None) -> Frame:
        head = chain.nodes[0]
        frame = self.first_node(frame, head, when, head.var == whole)
        for rel, node in zip(chain.rels, chain.nodes[1:], strict=True):
            frame = self.step(frame, chain.nodes[chain.rels.index(rel)].var, rel, node, when)
        return frame

    def first_node(self, frame: Frame, node: t.NodePattern, when: t.Temporal | None, whole: bool) -> Frame:
        if node.var in frame.scope:
            frame = self.labelled(frame, node, when)
            return self.inline(frame, node.var, node.props)
        if SUBGRAPH in node.labels and not self.graph.kinds_with((SUBGRAPH,)):
            scan = self.named(self.graph.subgraph_scan(), node.var)
            return self.inline(self.cross(frame, scan, node.var, Binding("subgraph", True, "subgraph")), node.var, node.props)
        scan = self.named(self.node_table(node.var, node.labels, when, whole, frame), node.var)
        return self.inline(self.cross(frame, scan, node.var, Binding("node", True, "node")), node.var, node.props)

    def cross(self, frame: Frame, scan: DataFrame, var: str, b: Binding) -> Frame:
        out = scan if not frame.df.columns and not frame.scope else frame.df.crossJoin(scan)
        return Frame(out, {**frame.scope, var: b})

    def labelled(self, frame: Frame, node: t.NodePattern, when: t.Temporal | None = None, joined: bool = False) -> Frame:
        """A bound node held to a pattern's labels, and joined with its table where something of it is needed."""
        b = frame.scope[node.var]
        if b.kind != "node":
            return frame
        kinds = self.graph.kinds_with(node.labels)
        settled = all(self.graph.nodes[k].uniform for k in kinds)
        if not b.joined and when is None and self.needs[node.var] == {"_labels"} and (shown := self.labels_of(col(node.var, "_kind"), kinds)) is not None:
            df = frame.df.where(col(node.var, "_kind").isin(*kinds)) if node.labels else frame.df
            return Frame(df.withColumn(f"{node.var}._labels", shown), {**frame.scope, node.var: Binding("node", True, "node")})
        wanted = bool(self.needs[node.var]) or when is not None and when.kind == "at"
        if b.joined or not (wanted or (node.labels and not settled)):
            if node.labels:
                if settled:
                    return replace(frame, df=frame.df.where(col(node.var, "_kind").isin(*kinds) if kinds else F.lit(False)))
                return self.node_join(frame, node, when, columns=False)
            return frame
        return self.node_join(frame, node, when, columns=True)

    def labels_of(self, kind: F.Column, kinds: list[str]) -> F.Column | None:
        """The labels of a node by its kind, where all rows of these kinds have one and the same label; else None."""
        tables = [self.graph.nodes[k] for k in kinds]
        if not kinds or not all(n.uniform and len(n.labels) == 1 for n in tables):
            return None
        shown = F.lit(None).cast("array<string>")
        for k, n in zip(kinds, tables, strict=True):
            shown = F.when(kind == k, F.array(F.lit(next(iter(n.labels))))).otherwise(shown)
        return shown

    def node_join(self, frame: Frame, node: t.NodePattern, when: t.Temporal | None, columns: bool) -> Frame:
        var = node.var
        scan = self.node_table(var, node.labels, when, False, frame)
        keep = {"_id", "_kind"} | (self.needs[var] if columns else set())
        right = scan.select(*[F.col(f"`{c}`").alias(f"__{c}" if c in ("_id", "_kind") else f"{var}.{c}") for c in scan.columns if c in keep])
        on = (col(var, "_id") == F.col("`___id`")) & (col(var, "_kind") == F.col("`___kind`"))
        out = frame.df.join(right, on, "inner" if columns else "left_semi").drop("___id", "___kind")
        return Frame(out, {**frame.scope, var: Binding("node", columns or frame.scope[var].joined, "node")})

    def step(self, frame: Frame, source: str, rel: t.RelPattern, node: t.NodePattern, when: t.Temporal | None) -> Frame:
        """One relationship of a chain: expand, then hold the far node to what is asked of it."""
        kind = frame.scope[source].kind
        bound, loose = node.var in frame.scope, node.var
        if bound:
            loose = f"__{node.var}"
        if rel.var in frame.scope and rel.named:
            raise SemanticError(f"{rel.var} is bound already")
        scope = dict(frame.scope)
        if kind == "subgraph":
            if rel.types and CONTAINS not in rel.types:
                raise SemanticError(f"a subgraph has only the relationship {CONTAINS}")
            df = ops.contains(frame.df, source, self.graph.member_scan(), loose).withColumn(f"{rel.var}._id", F.lit(None).cast("long"))
        elif kind == "hyperedge":
            df = self.involved(frame, source, loose)
            df = df.withColumn(f"{rel.var}._id", F.lit(None).cast("long"))
        else:
            edges = self.edge_table(rel, when, frame)
            if rel.hops is None:
                df = ops.expand(frame.df, source, edges, rel.var, loose, rel.direction)
            else:
                df = ops.var_length_expand(frame.df, source, edges, rel.var, loose, rel.direction, *rel.hops, written=self.written)
        scope[rel.var] = Binding("edge", True, "edge")
        joined = kind == "hyperedge"
        if bound:
            same = (F.col(f"`{loose}._id`") == col(node.var, "_id")) & (F.col(f"`{loose}._kind`") == col(node.var, "_kind"))
            df = df.where(same).drop(*[c for c in df.columns if c.startswith(f"{loose}.")])
        else:
            scope[node.var] = Binding("node", joined, "node")
        out = self.inline(Frame(df, scope), rel.var, rel.props)
        out = self.labelled(out, node, when)
        return self.inline(out, node.var, node.props)

    def involved(self, frame: Frame, source: str, target: str) -> DataFrame:
        """From hyperedges to the nodes that take part, each as it was at its own time, if it has one."""
        var = target.removeprefix("__")
        people = ops.participants(self.graph.hyperedge_scan()).where(F.col("kind") != "Subgraph")
        refs = people.select(F.col("_id").alias("__h"), F.col("id").alias("_id"), F.col("kind").alias("_kind"), "ts", "role", "place")
        wanted = self.needs[var] - {"_labels"}
        shown = self.labels_of(F.col("_kind"), self.graph.kinds_with(())) if self.needs[var] == {"_labels"} else None
        if shown is not None:  # the kind tells, so no table of nodes is read
            refs = refs.withColumn("_labels", shown)
        elif self.needs[var]:
            current = self.graph.node_scan((), wanted | {"_updated_at"})
            refs = temporal.reference_states(current, self.graph.version_scan((), wanted | {"_updated_at"}), refs)
        keep = {"_id", "_kind"} | self.needs[var]
        right = refs.select("__h", *[F.col(f"`{c}`").alias(f"{target}.{c}") for c in refs.columns if c in keep])
        return frame.df.join(right, col(source, "_id") == F.col("__h")).drop("__h")

    def optional(self, frame: Frame, m: t.Match) -> Frame:
        """OPTIONAL MATCH: the pattern with its condition as one DataFrame, then one left join.

        Where the pattern begins at a bound node and its condition names nothing else that
        is bound, the pattern's first edges stand for themselves; else the pattern starts
        from the distinct values of the bound variables that it uses."""
        inner = {p.var for c in m.chains for p in (*c.nodes, *c.rels)}
        used = {e.name for e in (t.walk(m.where) if m.where else ()) if isinstance(e, t.Var)}
        for c in m.chains:
            for p in (*c.nodes, *c.rels):
                used |= {e.name for _, v in p.props for e in t.walk(v) if isinstance(e, t.Var)}
        anchors = [v for v in inner if v in frame.scope]
        outer = [v for v in (inner | used) if v in frame.scope]
        start = self.start()
        if outer:
            columns = [c for c in frame.df.columns if any(c == v or c.startswith(f"{v}.") for v in outer)]
            start = Frame(frame.df.select(*[f"`{c}`" for c in columns]).distinct(), {v: frame.scope[v] for v in outer})
            only = m.chains[0].nodes[0] if len(m.chains) == 1 else None
            rel = m.chains[0].rels[0] if only is not None and m.chains[0].rels else None
            if outer == anchors and rel is not None and len(anchors) == 1 and only.var == anchors[0] and rel.hops is None and not only.labels and not only.props and only.var not in used and frame.scope[only.var].kind == "node":
                edges = self.edge_table(rel, m.temporal, start)
                seen = ops.directed(edges, rel.direction).select(F.col("_from").alias(f"{only.var}._id"), F.col("_from_kind").alias(f"{only.var}._kind"))
                start = Frame(seen.distinct(), {only.var: Binding("node", True, "node")}) if len(m.chains[0].rels) > 1 else None
                if start is None:
                    found = self.edge_first(rel, only.var, m.chains[0].nodes[1], m.temporal, edges)
                    return self.joined(frame, self.filtered(found, m.where), "left")
        found = start
        for chain in m.chains:
            found = self.chain(found, chain, m.temporal, None)
        found = self.filtered(found, m.where)
        if not outer:
            if not frame.scope and not frame.df.columns:
                one = self.graph.spark.range(1).select(F.lit(1).alias("__one"))
                return Frame(one.join(found.df, F.lit(True), "left").drop("__one"), found.scope)
            return Frame(frame.df.join(found.df, F.lit(True), "left"), {**found.scope, **frame.scope})
        return self.joined(frame, found, "left", null_safe=True)

    def edge_first(self, rel: t.RelPattern, source: str, node: t.NodePattern, when: t.Temporal | None, edges: DataFrame) -> Frame:
        """A one-edge pattern read from its edges alone."""
        names = {"_from": f"{source}._id", "_from_kind": f"{source}._kind", "_to": f"{node.var}._id", "_to_kind": f"{node.var}._kind"}
        seen = ops.directed(edges, rel.direction)
        df = seen.select(*[F.col(f"`{c}`").alias(names.get(c, f"{rel.var}.{c}")) for c in seen.columns])
        scope = {source: Binding("node", True, "node"), rel.var: Binding("edge", True, "edge"), node.var: Binding("node", False, "node")}
        if node.var == source:
            raise SemanticError(f"{source} cannot be both ends of an optional edge")
        frame = self.inline(Frame(df, scope), rel.var, rel.props)
        return self.inline(self.labelled(frame, node, when), node.var, node.props)

    def match_hyperedge(self, frame: Frame, m: t.MatchHyperedge) -> Frame:
        scan = self.named(self.graph.hyperedge_scan(m.types), m.var)
        return self.cross(frame, scan, m.var, Binding("hyperedge", True, "hyperedge"))

    # -- projections

    def unwind(self, frame: Frame, u: t.Unwind) -> Frame:
        v = self.value(frame, u.expr)
        if v.type == "null":
            out, kind = frame.df.withColumn(u.var, F.lit(None).cast("string")).where(F.lit(False)), "null"
        elif v.type != "list":
            raise TypeMismatch(f"UNWIND of a {v.type}")
        else:
            out = frame.df.select("*", F.explode(v.col).alias(u.var))
            kind = x.type_of(out.schema[u.var].dataType)
        return Frame(out, {**frame.scope, u.var: Binding("value", True, kind)})

    def item_names(self, items: tuple[t.Item, ...]) -> list[str]:
        names = [i.alias or x.rendered(i.expr) for i in items]
        twice = {n for n in names if names.count(n) > 1}
        if twice:
            raise SemanticError(f"two columns named {', '.join(sorted(twice))}")
        return names

    def grouped(self, frame: Frame, items: tuple[t.Item, ...], entities: bool) -> tuple[DataFrame, dict, dict[str, Binding]]:
        """Rows of groups, columns that stand for the items' expressions, and entities carried along."""
        scope = self.scope(frame)
        keys, values, given, carried = {}, {}, {}, {}
        for i, item in enumerate(items):
            if x.has_aggregate(item.expr):
                continue
            v = x.compile_value(item.expr, scope)
            keys[f"__k{i}"] = v.col
            given[item.expr] = Typed(F.col(f"__k{i}"), v.type)
            if isinstance(item.expr, t.Var) and frame.scope[item.expr.name].kind != "value":
                var = item.expr.name
                if f"{var}._kind" in frame.df.columns:
                    keys[f"__k{i}_kind"] = col(var, "_kind")
                if entities:
                    carried[var] = frame.scope[var]
                    for c in frame.df.columns:
                        if c.startswith(f"{var}.") and c not in (f"{var}._id", f"{var}._kind"):
                            values[c] = F.first(F.col(f"`{c}`"))
        for item in items:
            for e in t.walk(item.expr):
                if isinstance(e, t.Call) and e.name in x.AGGREGATES and e not in given:
                    name = f"__a{len(values)}"
                    c, kind = self.aggregate(e, scope, frame)
                    values[name] = c
                    given[e] = Typed(F.col(name), kind)
        named = [c.alias(n) for n, c in keys.items()]
        if values:
            df = frame.df.groupBy(*named).agg(*[c.alias(n) for n, c in values.items()])
        else:
            df = frame.df.select(*named).distinct()
        for i, item in enumerate(items):
            if isinstance(item.expr, t.Var) and item.expr.name in carried:
                df = df.withColumn(f"{item.expr.name}._id", F.col(f"__k{i}"))
                if f"__k{i}_kind" in df.columns:
                    df = df.withColumn(f"{item.expr.name}._kind", F.col(f"__k{i}_kind"))
        return df, given, carried

    def aggregate(self, e: t.Call, scope: Scope, frame: Frame) -> tuple[F.Column, str]:
        if e.star:
            if e.name != "count":
                raise SemanticError(f"{e.name}(*)")
            return F.count(F.lit(1)), "int"
        if len(e.args) != 1:
            raise SemanticError(f"{e.name}() takes one value")
        if any(x.has_aggregate(a) for a in e.args):
            raise SemanticError(f"{e.name}() of a group's value")
        v = x.compile_value(e.args[0], scope)
        if e.name == "count":
            cols = [v.col]
            if e.distinct and isinstance(e.args[0], t.Var) and f"{e.args[0].name}._kind" in frame.df.columns:
                cols.append(col(e.args[0].name, "_kind"))
            return (F.count_distinct(*cols) if e.distinct else F.count(v.col)), "int"
        if e.name == "collect":
            return (F.collect_set(v.col) if e.distinct else F.collect_list(v.col)), "list"
        if e.name in ("sum", "avg"):
            if v.type not in ("int", "float", "null"):
                raise TypeMismatch(f"{e.name}() of a {v.type}")
            kind = "long" if v.type != "float" else "double"
            c = v.col.cast(kind)
            if e.name == "sum":
                total = F.sum_distinct(c) if e.distinct else F.sum(c)
                return F.coalesce(total, F.lit(0).cast(kind)), "int" if kind == "long" else "float"
            return (F.avg(c) if not e.distinct else F.expr("1") * F.sum_distinct(c) / F.count_distinct(c)), "float"
        if v.type not in ("int", "float", "string", "datetime", "bool", "null", "any"):
            raise TypeMismatch(f"{e.name}() of a {v.type}")
        return (F.min(v.col) if e.name == "min" else F.max(v.col)), v.type

    def with_(self, frame: Frame, w: t.With) -> Frame:
        names = self.item_names(w.items)
        given, base, source = None, frame, frame.df
        if any(x.has_aggregate(i.expr) for i in w.items):
            source, given, _ = self.grouped(frame, w.items, True)
            base = Frame(source, {k: b for k, b in frame.scope.items() if b.kind != "value" and f"{k}._id" in source.columns})
            self.only_grouped(w.items, given)
        scope = self.scope(base, given)
        columns, bindings = [], {}
        for item, name in zip(w.items, names, strict=True):
            var = item.expr.name if isinstance(item.expr, t.Var) else None
            if var is not None and var in base.scope and base.scope[var].kind != "value":
                bindings[name] = base.scope[var]
                columns += [F.col(f"`{c}`").alias(name + c[len(var) :]) for c in base.df.columns if c.startswith(f"{var}.")]
            else:
                v = x.compile_value(item.expr, scope)
                bindings[name] = Binding("value", True, v.type)
                columns.append((v.col.cast("string") if v.type == "null" else v.col).alias(name))
        df = source.select(*columns)
        return self.filtered(Frame(df.distinct() if w.distinct else df, bindings), w.where)

    def only_grouped(self, items: tuple[t.Item, ...], given: dict) -> None:
        """Beside aggregates an item may use only what is itself a key."""

        def check(e) -> None:
            if e in given:
                return
            if isinstance(e, t.Var):
                raise SemanticError(f"{e.name} is neither grouped nor aggregated")
            for part in t.parts(e):
                check(part)

        for i in items:
            if x.has_aggregate(i.expr):
                check(i.expr)

    def return_(self, frame: Frame, r: t.Return) -> Frame:
        names = self.item_names(r.items)
        given, base = None, frame
        grouped = any(x.has_aggregate(i.expr) for i in r.items)
        if grouped:
            source, given, _ = self.grouped(frame, r.items, False)
            self.only_grouped(r.items, given)
            base = Frame(source, {})
        scope = self.scope(base, given)
        values = [x.compile_value(i.expr, scope) for i in r.items]
        columns = [(v.col.cast("string") if v.type == "null" else v.col).alias(n) for v, n in zip(values, names, strict=True)]
        hidden, order = [], []
        for k, s in enumerate(r.order):
            at = next((n for i, n in zip(r.items, names, strict=True) if i.expr == s.expr or (isinstance(s.expr, t.Var) and s.expr.name == n)), None)
            if at is not None:
                order.append((F.col(f"`{at}`"), s.descending))
                continue
            if r.distinct:
                raise SemanticError("ORDER BY after DISTINCT takes what is returned")
            by_alias = {t.Var(n): Typed(v.col, v.type) for v, n in zip(values, names, strict=True)}
            v = x.compile_value(s.expr, self.scope(base, {**by_alias, **(given or {})}))
            hidden.append(v.col.alias(f"__s{k}"))
            order.append((F.col(f"__s{k}"), s.descending))
        df = base.df.select(*columns, *hidden)
        if r.distinct:
            df = df.distinct()
        df = sort_limit(df, order, self.count(r.skip, "SKIP"), self.count(r.limit, "LIMIT"))
        df = df.select(*[f"`{n}`" for n in names])
        return Frame(df, {n: Binding("value", True, v.type) for v, n in zip(values, names, strict=True)}, tuple(names))

    def count(self, e: t.Expr | None, what: str) -> int | None:
        if e is None:
            return None
        n = e.value if isinstance(e, t.Literal) else self.params.get(e.name) if isinstance(e, t.Param) else None
        if not isinstance(n, int) or isinstance(n, bool) or n < 0:
            raise SemanticError(f"{what} takes an integer that is not negative")
        return n


def turned(chain: t.Chain) -> t.Chain:
    """The same chain read from its other end."""
    other = {"out": "in", "in": "out", "both": "both"}
    return t.Chain(chain.nodes[::-1], tuple(replace(r, direction=other[r.direction]) for r in chain.rels[::-1]))
