"""Sessions: query text in, DataFrames out."""

from __future__ import annotations

import tempfile
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Row as SparkRow

from .functions.plugins import CsvSerializer, IndexPlugin, JsonSerializer, Plugins, ScalarFunction, Serializer, Trigger
from .lang import tree as t
from .lang.errors import ExecutionError, SemanticError
from .lang.parser import parse
from .plans.compiler import Compiler, Frame, Options, needs_of
from .sources.graph import Graph

#: The parameter that fixes a query's time, in milliseconds.
NOW = "__query_start_ms__"
_READS = (t.Match, t.MatchHyperedge, t.Unwind, t.With, t.Return)


@dataclass(frozen=True)
class Result:
    """A query's result: `df` is lazy, `columns` are in the order of RETURN."""

    df: DataFrame
    columns: tuple[str, ...]

    def rows(self) -> list[dict]:
        return [r.asDict(recursive=True) for r in self.df.collect()]

    def __iter__(self):
        for r in self.df.toLocalIterator():
            yield r.asDict(recursive=True)

    def __len__(self) -> int:
        return self.df.count() if self.columns else 0

    def one(self) -> SparkRow | None:
        return self.df.first()


class Session:
    """Reads one graph. `LoomStore.session()` gives one that writes as well."""

    def __init__(self, graph: Graph, options: Options | None = None):
        self._graph, self.options, self.plugins = graph, options or Options(), Plugins()
        self.register_serializer(JsonSerializer())
        self.register_serializer(CsvSerializer())

    @property
    def spark(self) -> SparkSession:
        return self._graph.spark

    def graph(self) -> Graph:
        return self._graph

    def execute(self, text: str, params: dict | None = None, now_ms: int | None = None) -> Result:
        """Run a query. `now_ms` (or the parameter __query_start_ms__) fixes its time."""
        query = parse(text)
        params = dict(params or {})
        now_ms = now_ms if now_ms is not None else params.get(NOW)
        now_ms = int(time.time() * 1000) if now_ms is None else int(now_ms)
        return self._run(query, params, now_ms)

    def compiler(self, query: t.Query, params: dict, now_ms: int, graph: Graph | None = None) -> Compiler:
        functions = {n: p.typed for n, p in self.plugins.functions.held.items()}
        return Compiler(graph or self.graph(), needs_of(query), params, now_ms, functions, self.options, self._written)

    def _written(self, df: DataFrame) -> DataFrame:
        """A long path's frontier, cut off from what made it: a checkpoint in the shared folder."""
        scratch_folder(self.spark)
        return df.checkpoint(eager=True)

    def _run(self, query: t.Query, params: dict, now_ms: int) -> Result:
        compiler = self.compiler(query, params, now_ms)
        frame = compiler.start()
        for k, clause in enumerate(query.clauses):
            if not isinstance(clause, _READS):
                raise ExecutionError("this graph is read-only")
            frame = read_clause(compiler, frame, clause, k == len(query.clauses) - 1)
        return Result(frame.df, frame.names)

    def explain(self, text: str, params: dict | None = None, mode: str = "formatted") -> str:
        """Spark's plan of a query."""
        plan = self.execute(text, params).df._jdf.queryExecution()
        return plan.explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))

    # -- plugins

    def register_function(self, plugin: ScalarFunction) -> None:
        self.plugins.functions.register(plugin)

    def register_index_plugin(self, plugin: IndexPlugin) -> None:
        self.plugins.indexes.register(plugin)

    def register_serializer(self, plugin: Serializer) -> None:
        self.plugins.serializers.register(plugin)

    def register_trigger(self, plugin: Trigger) -> None:
        self.plugins.triggers.register(plugin)

    def list_functions(self) -> list[tuple[str, str]]:
        return self.plugins.functions.list()

    def list_index_plugins(self) -> list[tuple[str, str]]:
        return self.plugins.indexes.list()

    def list_serializers(self) -> list[tuple[str, str]]:
        return self.plugins.serializers.list()

    def list_triggers(self) -> list[tuple[str, str]]:
        return self.plugins.triggers.list()

    def index_plugin(self, name: str) -> IndexPlugin:
        return self.plugins.indexes.get(name)

    def export_data(self, format: str, text: str, params: dict | None = None) -> bytes:
        """A query's rows through a serializer, on the driver; for large results write `df` instead.
        Columns that are nodes or edges are left out."""
        serializer = self.plugins.serializers.get(format)
        query = parse(text)
        result = self.execute(text, params)
        entity = entity_columns(query)
        return serializer.export([{k: v for k, v in r.items() if k not in entity} for r in result.rows()])

    def import_data(self, format: str, data: bytes) -> list[dict]:
        return self.plugins.serializers.get(format).load(data)


def scratch_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which all executors share: the one of `spark.checkpoint.dir`; one of our
    own only where that is unset and Spark runs on this machine alone."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ExecutionError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="loomgraph-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def entity_columns(query: t.Query) -> set[str]:
    """Result columns that are whole pattern variables."""
    patterns = {p.var for c in query.clauses if isinstance(c, (t.Match, t.Create, t.Merge)) for chain in c.chains for p in (*chain.nodes, *chain.rels)}
    patterns |= {c.var for c in query.clauses if isinstance(c, t.MatchHyperedge)}
    last = query.clauses[-1]
    if not isinstance(last, t.Return):
        return set()
    return {i.alias or i.expr.name for i in last.items if isinstance(i.expr, t.Var) and i.expr.name in patterns}


def read_clause(compiler: Compiler, frame: Frame, clause: t.Clause, last: bool) -> Frame:
    match clause:
        case t.Match():
            return compiler.match(frame, clause)
        case t.MatchHyperedge():
            return compiler.match_hyperedge(frame, clause)
        case t.Unwind():
            return compiler.unwind(frame, clause)
        case t.With():
            return compiler.with_(frame, clause)
        case t.Return():
            if not last:
                raise SemanticError("RETURN ends a query")
            return compiler.return_(frame, clause)
    raise SemanticError(f"{type(clause).__name__} does not read")
