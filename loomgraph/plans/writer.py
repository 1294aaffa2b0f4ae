"""Statements that change a stored graph.

A statement's rows are written down and numbered before they change anything, so every
write sees the same rows however often a task is run again. Of several assignments to
one thing the last row's counts; MERGE creates one thing for each distinct key.
"""

from __future__ import annotations

import copy
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expressions as x
from ..lang import tree as t
from ..lang.errors import ExecutionError, SemanticError, TypeMismatch

from ..session import Result, Session, read_clause
from ..sources.graph import ENTITY, Graph
from ..sources.store import HYPEREDGE_SYSTEM, MEMBER_SYSTEM, SUBGRAPH_SYSTEM, Change, LoomStore
from .compiler import Binding, Compiler, Frame, Options, col, needs_of

_READ_ONLY = {"_created_at", "_updated_at"}
_EDGE_TIMES = ("_valid_from", "_valid_to")


class StoreSession(Session):
    """A session that writes. Each statement is one commit, but inside `begin()`."""

    def __init__(self, store: LoomStore, options: Options | None = None, track_times: bool = True, keep_versions: bool = True):
        self.store, self.change = store, None
        self.waiting: list = []  # hooks of an open transaction, which run after its commit
        self.track_times, self.keep_versions = track_times, keep_versions
        super().__init__(Graph(store.spark), options)

    def graph(self) -> Graph:
        return self.change.graph() if self.change is not None else self.store.graph()

    def begin(self) -> Transaction:
        if self.change is not None:
            raise ExecutionError("a transaction is open already")
        return Transaction(self)

    def _run(self, query: t.Query, params: dict, now_ms: int) -> Result:
        own = self.change is None
        change = self.store.begin() if own else self.change
        before = copy.deepcopy(change.manifest)
        writer = _Writer(self, change, needs_of(query), params, now_ms)
        try:
            frame = writer.run(query)
            if own and writer.wrote:
                change.commit()
        except BaseException:
            if not own:  # the statement leaves no trace in its transaction
                change.manifest, change._graph = before, None
            raise
        if own:
            for hook, changes in writer.after:
                hook(changes)
        else:
            self.waiting += writer.after
        return Result(frame.df if frame.names else self.spark.createDataFrame([], "none string").select(), frame.names)


class Transaction:
    """Statements that are committed together, or not at all."""

    def __init__(self, session: StoreSession):
        self.session = session
        session.change, session.waiting = session.store.begin(), []

    def execute(self, text: str, params: dict | None = None, now_ms: int | None = None) -> Result:
        if self.session.change is None:
            raise ExecutionError("the transaction has ended")
        return self.session.execute(text, params, now_ms)

    def commit(self) -> None:
        change, self.session.change = self.session.change, None
        if change is None:
            raise ExecutionError("the transaction has ended")
        change.commit()
        waiting, self.session.waiting = self.session.waiting, []
        for hook, changes in waiting:
            hook(changes)

    def rollback(self) -> None:
        self.session.change, self.session.waiting = None, []

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if self.session.change is not None:
            self.commit() if kind is None else self.rollback()


class _Writer:
    """Runs one statement against a change."""

    def __init__(self, session: StoreSession, change: Change, needs: dict, params: dict, now_ms: int):
        self.session, self.change, self.needs, self.params, self.now_ms = session, change, needs, params, now_ms
        self.wrote, self.after = False, []
        self.now = x.timestamp(now_ms)

    def compiler(self) -> Compiler:
        s = self.session
        functions = {n: p.typed for n, p in s.plugins.functions.held.items()}
        return Compiler(self.change.graph(), self.needs, self.params, self.now_ms, functions, s.options, s._written)

    def run(self, query: t.Query) -> Frame:
        frame = self.compiler().start()
        steps = {
            t.Create: self.create, t.SetClause: self.set, t.Remove: self.remove, t.Delete: self.delete, t.Merge: self.merge, t.CreateIndex: self.create_index,
            t.DropIndex: self.drop_index, t.CreateSnapshot: self.snapshot, t.CreateHyperedge: self.hyperedge,
        }
        for k, clause in enumerate(query.clauses):
            step = steps.get(type(clause))
            if step is None:
                frame = read_clause(self.compiler(), frame, clause, k == len(query.clauses) - 1)
            else:
                self.wrote = True
                frame = step(frame, clause)
        return frame

    # -- helpers

    def staged(self, frame: Frame) -> tuple[Frame, int]:
        """The frame, written down, with a row number."""
        df, n = self.change.staged(frame.df, "__row")
        return Frame(df, frame.scope), n

    def refreshed(self, frame: Frame) -> Frame:
        """The frame without row numbers, and with what its nodes and edges are now."""
        df = frame.df.drop("__row", "__created")
        graph = self.change.graph()
        for var, b in frame.scope.items():
            wanted = self.needs[var]
            if b.kind not in ("node", "edge") or not wanted or f"{var}._id" not in df.columns:
                continue
            keep = [c for c in df.columns if not c.startswith(f"{var}.") or c in (f"{var}._id", f"{var}._kind", f"{var}._type")]
            scan = graph.node_scan((), wanted - {"_labels"}) if b.kind == "node" else graph.edge_scan((), wanted)
            names = [c for c in scan.columns if c in wanted and f"{var}.{c}" not in keep]
            if not names:
                continue
            home = "_kind" if b.kind == "node" else "_type"
            right = scan.select(F.col("_id").alias("__id"), F.col(home).alias("__home"), *[F.col(f"`{c}`").alias(f"{var}.{c}") for c in names])
            same = (col(var, "_id") == F.col("__id")) & (col(var, home) == F.col("__home"))
            df = df.select(*[f"`{c}`" for c in keep]).join(right, same, "left").drop("__id", "__home")
        return Frame(df, {v: Binding(b.kind, True, b.type) for v, b in frame.scope.items()})

    def props(self, frame: Frame, props, edge: bool) -> dict[str, F.Column]:
        """The columns of a pattern's properties."""
        out = {}
        for key, e in props:
            if key in _READ_ONLY or (key in _EDGE_TIMES and not edge):
                raise ExecutionError(f"{key} is read-only")
            v = self.compiler().value(frame, e)
            if v.type in ("node", "edge", "subgraph", "hyperedge"):
                raise TypeMismatch(f"{key} cannot hold a {v.type}")
            c = F.lit(None) if v.type == "null" else v.col  # without a type: it takes the property's
            if key in _EDGE_TIMES:
                c = F.timestamp_millis(v.col) if v.type == "int" else v.col.cast("timestamp")
            out[key] = c
        return out

    def fire(self, when: str, what: str, df: DataFrame, entity: str, label: F.Column) -> None:
        """Hooks before a change now, hooks after it once it is committed."""
        triggers = list(self.session.plugins.triggers.held.values())
        if not triggers:
            return
        shown = [c for c in df.columns if not c.startswith("__")]
        changes = df.select(
            F.lit(entity).alias("entity_type"), F.col("_id").alias("id"), label.alias("label"), F.to_json(F.struct(*[f"`{c}`" for c in shown])).alias("properties"), F.lit(what).alias("operation")
        )
        for one in triggers:
            getattr(one, f"before_{what}")(changes)
            self.after.append((getattr(one, f"after_{what}"), changes))

    def new_nodes(self, rows: DataFrame, labels: tuple[str, ...], names: dict[str, str]) -> None:
        """Append nodes: `_id` and properties (table name to row column)."""
        kind = labels[0] if labels else ""
        times = {"_created_at": self.now, "_updated_at": self.now} if self.session.track_times else {}
        df = rows.select("_id", *[F.col(f"`{c}`").alias(n) for n, c in names.items()])
        df = df.withColumns({"_labels": F.array(*map(F.lit, labels)).cast("array<string>"), "_ver": F.lit(0).cast("long"), **times})
        self.fire("before", "create", df, "node", F.lit(kind))
        self.change.append_nodes(kind, df, list(labels))

    def new_edges(self, rows: DataFrame, type: str, names: dict[str, str]) -> None:
        times = {"_created_at": self.now, "_updated_at": self.now} if self.session.track_times else {}
        if self.session.track_times and "_valid_from" not in names:
            times["_valid_from"] = self.now
        df = rows.select("_id", "_src", "_src_kind", "_dst", "_dst_kind", *[F.col(f"`{c}`").alias(n) for n, c in names.items()]).withColumns(times)
        self.fire("before", "create", df, "edge", F.lit(type))
        self.change.append_edges(type, df)

    # -- CREATE

    def create(self, frame: Frame, c: t.Create) -> Frame:
        for chain in c.chains:
            self.compiler().check_chain(frame, chain)
        frame, n = self.staged(frame)
        for chain in c.chains:
            frame = self.create_chain(frame, chain, n)
        return self.refreshed(frame)

    def create_chain(self, frame: Frame, chain: t.Chain, n: int) -> Frame:
        new = [p for k, p in enumerate(chain.nodes) if p.var not in frame.scope and p.var not in {q.var for q in chain.nodes[:k]}]
        for rel in chain.rels:
            if len(rel.types) != 1:
                raise SemanticError("a new relationship has one type")
            if rel.hops:
                raise SemanticError("a path of many edges cannot be created")
        per_row = len(new) + len(chain.rels)
        first = self.change.take_ids(n * per_row)
        scope = dict(frame.scope)
        df, made, written = frame.df, {}, []
        for j, node in enumerate(new):
            made[node.var] = (F.col("__row") * per_row + F.lit(first + j)).alias(f"{node.var}._id")
            values = self.props(frame, node.props, False)
            written.append((node, {k: c.alias(f"__{node.var}.{k}") for k, c in values.items()}))
        edges = []
        for j, rel in enumerate(chain.rels):
            made[rel.var] = (F.col("__row") * per_row + F.lit(first + len(new) + j)).alias(f"{rel.var}._id")
            edges.append((rel, {k: c.alias(f"__{rel.var}.{k}") for k, c in self.props(frame, rel.props, True).items()}))
        kinds = [F.lit(p.labels[0] if p.labels else "").alias(f"{p.var}._kind") for p in new]
        types = [F.lit(r.types[0]).alias(f"{r.var}._type") for r in chain.rels]
        extra = [c for _, cs in (*written, *edges) for c in cs.values()]
        df = df.select("*", *made.values(), *kinds, *types, *extra)
        for node, values in written:
            rows = df.withColumn("_id", col(node.var, "_id"))
            self.new_nodes(rows, node.labels, {k: f"__{node.var}.{k}" for k in values})
            scope[node.var] = Binding("node", True, "node")
        for rel, values in edges:
            at = chain.rels.index(rel)
            a, b = chain.nodes[at].var, chain.nodes[at + 1].var
            if rel.direction == "in":
                a, b = b, a
            rows = df.withColumns({"_id": col(rel.var, "_id"), "_src": col(a, "_id"), "_src_kind": col(a, "_kind"), "_dst": col(b, "_id"), "_dst_kind": col(b, "_kind")})
            self.new_edges(rows.where(F.col("_src").isNotNull() & F.col("_dst").isNotNull()), rel.types[0], {k: f"__{rel.var}.{k}" for k in values})
            scope[rel.var] = Binding("edge", True, "edge")
        return Frame(df.drop(*[f"__{p.var}.{k}" for p, vs in (*written, *edges) for k in vs]), scope)

    # -- SET and REMOVE

    def set(self, frame: Frame, c: t.SetClause) -> Frame:
        staged, _ = self.staged(frame)
        self.assign(staged, c.items)
        return self.refreshed(staged)

    def assign(self, frame: Frame, items: tuple[t.Assign, ...]) -> None:
        by_var: dict[str, dict[str, F.Column]] = {}
        for a in items:
            b = frame.scope.get(a.var)
            if b is None:
                raise SemanticError(f"{a.var} is not defined")
            if b.kind not in ("node", "edge"):
                raise TypeMismatch(f"SET on a {b.type if b.kind == 'value' else b.kind}")
            by_var.setdefault(a.var, {}).update(self.props(frame, [(a.key, a.value)], b.kind == "edge"))
        for var, values in by_var.items():
            self.update(frame, var, values)

    def update(self, frame: Frame, var: str, values: dict[str, F.Column], without_label: str | None = None) -> None:
        """New values of a variable's things, the last row's for each."""
        node = frame.scope[var].kind == "node"
        home = "_kind" if node else "_type"
        new = F.struct(*[c.alias(k) for k, c in values.items()]) if values else F.struct(F.lit(1).alias("__none"))
        rows = frame.df.where(col(var, "_id").isNotNull()).select(col(var, "_id").alias("__id"), col(var, home).alias("__home"), new.alias("__new"), "__row")
        last = rows.groupBy("__id", "__home").agg(F.max_by("__new", "__row").alias("__new"))
        homes = [r["__home"] for r in last.select("__home").distinct().collect()]  # as many as there are labels or types
        graph = self.change.graph()
        for one in homes:
            table = graph.nodes[one].df if node else next(e.df for e in graph.edges if e.type == one)
            ups = last.where(F.col("__home") == one).select("__id", "__new")
            joined = table.join(ups, table["_id"] == F.col("__id"))
            columns = {k: F.col(f"__new.`{k}`") for k in values}
            if self.session.track_times:
                columns["_updated_at"] = self.now
            if node:
                columns["_ver"] = F.col("_ver") + 1
                if without_label is not None:
                    columns["_labels"] = F.array_remove("_labels", without_label)
                if self.session.keep_versions:
                    old = joined.select(*[f"`{c}`" for c in table.columns])
                    self.change.append_versions(one, old.withColumn("_seq", F.col("_ver") + 1))
            changed = joined.withColumns(columns).drop("__id", "__new")
            self.fire("before", "update", changed, "node" if node else "edge", F.lit(one))
            if node:
                self.change.patch_nodes(one, changed, uniform=False if without_label is not None else None)
            else:
                self.change.patch_edges(one, changed)

    def remove(self, frame: Frame, c: t.Remove) -> Frame:
        staged, _ = self.staged(frame)
        for var, key, label in c.items:
            b = staged.scope.get(var)
            if b is None:
                raise SemanticError(f"{var} is not defined")
            if key is not None:
                if key in _READ_ONLY or (b.kind == "node" and key in _EDGE_TIMES):
                    raise ExecutionError(f"{key} is read-only")
                self.update(staged, var, {key: F.lit(None)})
            elif b.kind == "node":
                self.update(staged, var, {}, label)
            else:
                raise TypeMismatch(f"a {b.kind} has no labels")
        return self.refreshed(staged)

    # -- DELETE

    def delete(self, frame: Frame, c: t.Delete) -> Frame:
        staged, _ = self.staged(frame)
        ids: dict[str, list[DataFrame]] = {"node": [], "edge": []}
        for e in c.exprs:
            if not isinstance(e, t.Var) or e.name not in staged.scope:
                raise SemanticError("DELETE takes variables")
            b = staged.scope[e.name]
            if b.kind not in ids:
                raise TypeMismatch(f"DELETE of a {b.kind}")
            home = col(e.name, "_kind" if b.kind == "node" else "_type")
            ids[b.kind].append(staged.df.select(col(e.name, "_id").alias("__id"), home.alias("__home")).where(F.col("__id").isNotNull()))
        if ids["edge"]:
            gone = reduce(lambda a, b: a.unionByName(b), ids["edge"]).distinct()
            same = (F.col("_id") == F.col("__id")) & (F.col("__type") == F.col("__home"))
            self.drop_edges(lambda df: df.join(gone, same, "left_semi"))
        if ids["node"]:
            gone = reduce(lambda a, b: a.unionByName(b), ids["node"]).distinct()
            at_src, at_dst = ((F.col(x) == F.col("__id")) & (F.col(f"{x}_kind") == F.col("__home")) for x in ("_src", "_dst"))
            if c.detach:
                self.drop_edges(lambda df: df.join(gone, at_src, "left_semi").unionByName(df.join(gone, at_dst, "left_semi")).dropDuplicates(["_id"]))
            else:
                left = self.change.graph().edge_scan((), set())
                if not left.join(gone, at_src, "left_semi").limit(1).isEmpty() or not left.join(gone, at_dst, "left_semi").limit(1).isEmpty():
                    raise ExecutionError("a node still has relationships; use DETACH DELETE")
            for kind, table in self.change.graph().nodes.items():
                here = gone.where(F.col("__home") == kind)
                hit = table.df.join(here, F.col("_id") == F.col("__id"), "left_semi")
                if not hit.limit(1).isEmpty():
                    self.fire("before", "delete", hit, "node", F.lit(kind))
                    self.change.patch_nodes(kind, gone=hit)
        return Frame(staged.df.drop("__row"), staged.scope)

    def drop_edges(self, hit) -> None:
        for e in self.change.graph().edges:
            typed = e.df.withColumn("__type", F.lit(e.type))
            found = hit(typed).drop("__type")
            if not found.limit(1).isEmpty():
                self.fire("before", "delete", found, "edge", F.lit(e.type))
                self.change.patch_edges(e.type, gone=found)

    # -- MERGE

    def merge(self, frame: Frame, c: t.Merge) -> Frame:
        for chain in c.chains:
            self.compiler().check_chain(frame, chain)
        frame, _ = self.staged(frame)
        for chain in c.chains:
            frame = Frame(frame.df.withColumn("__created", F.lit(False)), frame.scope)
            for node in chain.nodes:
                if node.var not in frame.scope:
                    frame = self.merge_node(frame, node)
            for k, rel in enumerate(chain.rels):
                if len(rel.types) != 1 or rel.hops:
                    raise SemanticError("MERGE of a relationship takes one type")
                frame = self.merge_edge(frame, chain.nodes[k].var, rel, chain.nodes[k + 1].var)
            if c.on_create or c.on_match:
                full = self.with_props(frame, (*c.on_create, *c.on_match))
                for items, made in ((c.on_create, True), (c.on_match, False)):
                    if items:
                        self.assign(Frame(full.df.where(F.col("__created") == made), full.scope), items)
        return self.refreshed(frame)

    def with_props(self, frame: Frame, items) -> Frame:
        """The frame with the properties that assignments read, as they are now."""
        if not any(isinstance(e, t.Prop) for a in items for e in t.walk(a.value)):
            return frame
        kept = frame.df.select("__row", "__created")
        fresh = self.refreshed(Frame(frame.df.drop("__created").withColumnRenamed("__row", "__r"), frame.scope))
        return Frame(fresh.df.withColumnRenamed("__r", "__row").join(kept, "__row"), fresh.scope)

    def merge_node(self, frame: Frame, node: t.NodePattern) -> Frame:
        values = self.props(frame, node.props, False)
        values, void = self.typed(frame, values)
        names = {k: f"__p{i}" for i, k in enumerate(values)}
        rows = frame.df.select("*", *[c.alias(names[k]) for k, c in values.items()])
        scan = self.change.graph().node_scan(node.labels, set(values))
        missing = [k for k in values if k not in scan.columns]
        found = scan.select(F.col("_id").alias("__fid"), F.col("_kind").alias("__fkind"), *[F.col(f"`{k}`").alias(f"__f{names[k]}") for k in values if k in scan.columns])
        least = F.min(F.struct("__fid", "__fkind")).alias("__best")
        if missing or void:  # nothing equals a property that no node has, or null
            rows = rows.withColumn("__best", F.lit(None).cast("struct<__fid:bigint,__fkind:string>"))
        elif not values:  # any node of the labels will do: the least one, a single row
            rows = rows.join(F.broadcast(found.agg(least)), how="cross")
        else:
            on = reduce(lambda a, b: a & b, [F.col(names[k]) == F.col(f"__f{names[k]}") for k in values])
            best = rows.select("__row", *names.values()).join(found, on).groupBy("__row").agg(least)
            rows = rows.join(best, "__row", "left")
        fresh = rows.where(F.col("__best").isNull()).select(*names.values()).distinct()
        keys, n = self.change.staged(fresh.withColumn("__any", F.lit(1)), "__k")
        first = self.change.take_ids(n)
        keys = keys.withColumn("_id", F.col("__k") + F.lit(first)).drop("__k", "__any")
        kind = node.labels[0] if node.labels else ""
        if n:
            self.new_nodes(keys, node.labels, names)
        back = keys.select(F.col("_id").alias("__new"), *[F.col(c).alias(f"__n{c}") for c in names.values()])
        on = F.col("__best").isNull()
        for c in names.values():
            on = on & F.col(c).eqNullSafe(F.col(f"__n{c}"))
        rows = rows.join(back, on, "left")
        rows = rows.withColumns({
            f"{node.var}._id": F.coalesce(F.col("__best.__fid"), F.col("__new")), f"{node.var}._kind": F.coalesce(F.col("__best.__fkind"), F.lit(kind)),
            "__created": F.col("__created") | F.col("__best").isNull(),
        })
        return self.written(Frame(rows.drop("__best", "__new", *names.values(), *[f"__n{c}" for c in names.values()]), {**frame.scope, node.var: Binding("node", True, "node")}))

    def typed(self, frame: Frame, values: dict[str, F.Column]) -> tuple[dict[str, F.Column], set[str]]:
        """The properties that have a type, and the keys of those that are a bare null."""
        schema = frame.df.select(*[c.alias(k) for k, c in values.items()]).schema
        void = {f.name for f in schema.fields if isinstance(f.dataType, T.NullType)}
        return {k: c for k, c in values.items() if k not in void}, void

    def written(self, frame: Frame) -> Frame:
        """The frame as files: what was found must not change when what was made is read."""
        path = f"{self.change.store.root}/{self.change.folder()}"
        frame.df.write.parquet(path)
        return Frame(self.change.spark.read.parquet(path), frame.scope)

    def merge_edge(self, frame: Frame, a: str, rel: t.RelPattern, b: str) -> Frame:
        values, _ = self.typed(frame, self.props(frame, rel.props, True))
        names = {k: f"__p{i}" for i, k in enumerate(values)}
        if rel.direction == "in":
            a, b = b, a
        ends = {"_src": col(a, "_id"), "_src_kind": col(a, "_kind"), "_dst": col(b, "_id"), "_dst_kind": col(b, "_kind")}
        rows = frame.df.select("*", *[c.alias(n) for n, c in ends.items()], *[c.alias(names[k]) for k, c in values.items()])
        edges = self.change.graph().edge_scan(rel.types, set())
        at = {"__fs": "_src", "__fsk": "_src_kind", "__fd": "_dst", "__fdk": "_dst_kind"}
        seen = edges.select(F.col("_id").alias("__fid"), *[F.col(c).alias(n) for n, c in at.items()])
        if rel.direction == "both":
            turned = {"__fs": "__fd", "__fsk": "__fdk", "__fd": "__fs", "__fdk": "__fsk"}
            seen = seen.unionByName(seen.select("__fid", *[F.col(c).alias(n) for n, c in turned.items()]))
        found = seen.groupBy(*at).agg(F.min("__fid").alias("__fid"))

        def ends_are(names: dict[str, str]) -> F.Column:
            return reduce(lambda x, y: x & y, [F.col(c) == F.col(n) for n, c in names.items()])

        rows = rows.join(found, ends_are(at), "left").drop(*at)
        fresh = rows.where(F.col("__fid").isNull()).groupBy(*ends).agg(*[F.first(c).alias(c) for c in names.values()], F.lit(1).alias("__any"))
        keys, n = self.change.staged(fresh, "__k")
        first = self.change.take_ids(n)
        keys = keys.withColumn("_id", F.col("__k") + F.lit(first)).drop("__k", "__any")
        if n:
            self.new_edges(keys, rel.types[0], names)
        made = {"__ns": "_src", "__nsk": "_src_kind", "__nd": "_dst", "__ndk": "_dst_kind"}
        back = keys.select(F.col("_id").alias("__new"), *[F.col(c).alias(n) for n, c in made.items()])
        rows = rows.join(back, F.col("__fid").isNull() & ends_are(made), "left").drop(*made)
        rows = rows.withColumns({f"{rel.var}._id": F.coalesce("__fid", "__new"), f"{rel.var}._type": F.lit(rel.types[0]), "__created": F.col("__created") | F.col("__fid").isNull()})
        return self.written(Frame(rows.drop("__fid", "__new", *ends, *names.values()), {**frame.scope, rel.var: Binding("edge", True, "edge")}))

    # -- indexes

    def create_index(self, frame: Frame, c: t.CreateIndex) -> Frame:
        name = c.name or f"{'eidx' if c.edge else 'idx'}_{c.on}_{c.key}"
        if any(i["name"] == name for i in self.change.manifest["indexes"]):
            raise ExecutionError(f"index {name} exists already")
        self.change.manifest["indexes"] = [*self.change.manifest["indexes"], {"name": name, "on": c.on, "key": c.key, "edge": c.edge}]
        graph = self.change.graph()
        if c.edge:
            for e in graph.edge_tables((c.on,)):
                self.change.replace_edges(e.type, e.df)
        else:
            for kind in graph.kinds_with((c.on,)):
                self.change.replace_nodes(kind, graph.nodes[kind].df)
        return frame

    def drop_index(self, frame: Frame, c: t.DropIndex) -> Frame:
        left = [i for i in self.change.manifest["indexes"] if i["name"] != c.name]
        if len(left) == len(self.change.manifest["indexes"]):
            raise ExecutionError(f"no index {c.name}")
        self.change.manifest["indexes"] = left
        return frame

    # -- snapshots and hyperedges

    def snapshot(self, frame: Frame, c: t.CreateSnapshot) -> Frame:
        compiler = self.compiler()
        inner = compiler.match(compiler.start(), c.match)
        taken = []
        for item in c.items:
            if not isinstance(item.expr, t.Var) or item.expr.name not in inner.scope:
                raise SemanticError("a snapshot returns variables of its pattern")
            if inner.scope[item.expr.name].kind == "node":
                var = item.expr.name
                taken.append(inner.df.select(col(var, "_id").alias("node_id"), col(var, "_kind").alias("node_kind")).where(F.col("node_id").isNotNull()))
        anchor = c.anchor or (c.match.temporal.first if c.match.temporal is not None and c.match.temporal.kind == "at" else None)
        one = compiler.start()
        when = self.now if anchor is None else compiler.instant(one, anchor)
        number = self.change.take_ids(1)
        values = self.props(one, c.props, False)
        row = self.change.spark.range(1).select(
            F.lit(number).cast("long").alias("_id"), F.array(*map(F.lit, c.labels)).cast("array<string>").alias("_labels"), when.alias("_temporal_anchor"), self.now.alias("_created_at"), *[v.alias(k) for k, v in values.items()]
        )
        self.change.write_table("subgraphs", row, SUBGRAPH_SYSTEM)
        if taken:
            members = reduce(lambda a, b: a.unionByName(b), taken).distinct().withColumn("subgraph_id", F.lit(number).cast("long"))
            self.change.write_table("members", members, MEMBER_SYSTEM)
        return self.bound(frame, c.var, "subgraph", number)

    def bound(self, frame: Frame, var: str | None, kind: str, number: int) -> Frame:
        if var is None:
            return frame
        return Frame(frame.df.withColumn(f"{var}._id", F.lit(number).cast("long")), {**frame.scope, var: Binding(kind, True, kind)})

    def hyperedge(self, frame: Frame, c: t.CreateHyperedge) -> Frame:
        if len(c.types) > 1:
            raise SemanticError("a hyperedge has one type")
        compiler = self.compiler()

        def entity(e: t.Expr) -> F.Column:
            var = e.node.name if isinstance(e, t.AtTime) else e.name
            b = frame.scope.get(var)
            if b is None or b.kind == "value" or b.kind == "edge":
                raise SemanticError(f"{var} cannot take part in a hyperedge")
            kind = col(var, "_kind") if b.kind == "node" else F.lit("Subgraph" if b.kind == "subgraph" else "HyperEdge")
            ts = F.unix_millis(compiler.instant(frame, e.time)) if isinstance(e, t.AtTime) else F.lit(None)
            return F.struct(kind.alias("kind"), col(var, "_id").alias("id"), ts.cast("long").alias("ts"))

        sides = [F.array(*map(entity, side)).cast(f"array<{ENTITY}>") if side else F.array().cast(f"array<{ENTITY}>") for side in (c.sources, c.targets)]
        rows = frame.df.select(sides[0].alias("_sources"), sides[1].alias("_targets")).orderBy("_sources", "_targets").limit(1)
        number = self.change.take_ids(1)
        new = rows.select(F.lit(number).cast("long").alias("_id"), F.lit(c.types[0] if c.types else None).cast("string").alias("_type"), "_sources", "_targets", self.now.alias("_created_at"))
        self.change.write_table("hyperedges", new, HYPEREDGE_SYSTEM)
        return self.bound(frame, c.var, "hyperedge", number)


def open_session(spark, root: str, **options) -> StoreSession:
    """A session on the store under `root`, which is made by the first write."""
    return LoomStore(spark, root).session(**options)
