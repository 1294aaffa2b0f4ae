"""Extension points: scalar functions, index plugins, serializers and triggers."""

from __future__ import annotations

import csv
import io
import json
from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .expressions import Typed, type_of
from ..lang.errors import QueryError


class PluginError(QueryError):
    """A plugin is registered twice, unknown, or refuses."""


class Plugin(ABC):
    """What every plugin has."""

    name: str = "plugin"
    version: str = "1.0"


class ScalarFunction(Plugin):
    """A function of a query. `returns` is a Spark type; `column` gives a Spark expression, or
    `call` a Python function of pandas Series (run in Arrow batches) where Spark has none."""

    returns: T.DataType = T.StringType()

    def column(self, *args: F.Column) -> F.Column:
        return F.pandas_udf(self.call, self.returns)(*args)

    def call(self, *args):
        raise NotImplementedError

    def typed(self, args: list[Typed]) -> Typed:
        for a in args:
            if a.type in ("node", "edge", "subgraph", "hyperedge"):
                raise PluginError(f"{self.name}() takes values, not a {a.type}")
        return Typed(self.column(*[a.col for a in args]), type_of(self.returns))


class IndexPlugin(Plugin):
    """A lookup structure that its caller drives; queries never consult it."""

    index_type: str = "index"

    @abstractmethod
    def insert(self, key, node_id: int) -> None: ...

    @abstractmethod
    def remove(self, key, node_id: int) -> None: ...

    @abstractmethod
    def lookup(self, key) -> list[int]: ...


class Serializer(Plugin):
    """Rows to bytes and back; rows are dicts."""

    format: str = "format"

    @abstractmethod
    def export(self, rows: list[dict]) -> bytes: ...

    @abstractmethod
    def load(self, data: bytes) -> list[dict]: ...


class JsonSerializer(Serializer):
    name, format = "json", "json"

    def export(self, rows: list[dict]) -> bytes:
        return json.dumps(rows, default=str, ensure_ascii=False).encode()

    def load(self, data: bytes) -> list[dict]:
        return json.loads(data.decode())


class CsvSerializer(Serializer):
    name, format = "csv", "csv"

    def export(self, rows: list[dict]) -> bytes:
        out = io.StringIO()
        if rows:
            writer = csv.DictWriter(out, list(rows[0]))
            writer.writeheader()
            writer.writerows(rows)
        return out.getvalue().encode()

    def load(self, data: bytes) -> list[dict]:
        return list(csv.DictReader(io.StringIO(data.decode())))


class Trigger(Plugin):
    """Hooks around a statement's changes. Each gets a DataFrame of the changes (entity_type,
    id, label, properties as JSON, operation); an error in a before-hook undoes the
    statement, for nothing is committed before it."""

    def before_create(self, changes: DataFrame) -> None: ...

    def after_create(self, changes: DataFrame) -> None: ...

    def before_update(self, changes: DataFrame) -> None: ...

    def after_update(self, changes: DataFrame) -> None: ...

    def before_delete(self, changes: DataFrame) -> None: ...

    def after_delete(self, changes: DataFrame) -> None: ...


@dataclass
class Registry:
    """Plugins of one kind by name."""

    kind: str
    key: Callable[[Plugin], str]
    held: dict[str, Plugin] = field(default_factory=dict)

    def register(self, plugin: Plugin) -> None:
        name = self.key(plugin)
        if name in self.held:
            raise PluginError(f"{self.kind} {name} is registered already")
        self.held[name] = plugin

    def get(self, name: str) -> Plugin:
        if name not in self.held:
            raise PluginError(f"no {self.kind} {name}")
        return self.held[name]

    def list(self) -> list[tuple[str, str]]:
        return sorted((p.name, p.version) for p in self.held.values())

    def __contains__(self, name: str) -> bool:
        return name in self.held


@dataclass
class Plugins:
    """All registries of a session."""

    functions: Registry = field(default_factory=lambda: Registry("function", lambda p: p.name.lower()))
    indexes: Registry = field(default_factory=lambda: Registry("index plugin", lambda p: p.name))
    serializers: Registry = field(default_factory=lambda: Registry("serializer", lambda p: p.format))
    triggers: Registry = field(default_factory=lambda: Registry("trigger", lambda p: p.name))
