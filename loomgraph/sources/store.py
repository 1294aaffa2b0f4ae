"""A graph kept as Parquet: immutable data folders and numbered manifests.

A statement writes new folders and, last, one manifest that lists the folders of every
table. A manifest gets its name only when it is whole, and only if no other has it: a
reader never meets half of one, keeps the manifest it began with, and a writer whose
number is taken by another fails, and what it wrote is never listed. Folders that no
manifest lists are leftovers of broken writes and are ignored, and so is a manifest that
cannot be read: the newest whole one counts. A node's identity is its kind and its id. Nodes lie in one table for each first
label (their kind), edges in one for each type. New rows are only ever appended. Changed
and deleted rows go to one patch beside a table, which is laid over it when it is read; so
a statement writes about what it changes, and a table is written anew only when its patch
has grown to a share of it.
"""

from __future__ import annotations

import copy
import json
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import operators as ops
from ..lang.errors import ExecutionError
from .graph import ENTITY, EdgeTable, Graph, NodeTable, common_type, normalised

NODE_SYSTEM = "_id long, _labels array<string>, _created_at timestamp, _updated_at timestamp, _ver long"
EDGE_SYSTEM = "_id long, _src long, _src_kind string, _dst long, _dst_kind string, _created_at timestamp, _updated_at timestamp, _valid_from timestamp, _valid_to timestamp"
SUBGRAPH_SYSTEM = "_id long, _labels array<string>, _temporal_anchor timestamp, _created_at timestamp"
MEMBER_SYSTEM = "subgraph_id long, node_id long, node_kind string"
HYPEREDGE_SYSTEM = f"_id long, _type string, _sources array<{ENTITY}>, _targets array<{ENTITY}>, _created_at timestamp"
#: Stores whose files appear when they are closed; a rename is a copy there.
_WHOLE = {"s3", "s3a", "s3n", "gs", "oss", "wasb", "wasbs", "abfs", "abfss"}
#: Folders of one table before an append writes it anew; the share of a table's bytes that its patch may have.
MOST_FOLDERS, PATCH_SHARE = 64, 0.25

_EMPTY = {"next_id": 1, "nodes": {}, "edges": {}, "versions": {}, "subgraphs": None, "members": None, "hyperedges": None, "indexes": []}


class Files:
    """The few file operations of the store, on any file system Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.jvm, self.root = spark.sparkContext, spark._jvm, root.rstrip("/")
        path = self.path("")
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def size(self, names: list[str]) -> int:
        """Bytes under some folders."""
        return sum(self.fs.getContentSummary(self.path(n)).getLength() for n in names)

    def names(self) -> list[str]:
        if not self.fs.exists(self.path("")):
            return []
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(""))]

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """A new file with this text, which appears whole or not at all; False if there is one already."""
        if (self.fs.getScheme() or "file") in _WHOLE:
            return self._write(self.path(name), text)  # visible only when it is closed
        part = self.path(f".{name}.{uuid.uuid4().hex}")
        self._write(part, text)
        try:
            for step in (self._link, self._rename) if self.fs.getScheme() == "file" else (self._rename,):
                try:
                    step(part, self.path(name))
                    return True
                except Exception as e:
                    if "AlreadyExists" in str(e) or "already exists" in str(e):
                        return False
                    if step == self._rename:  # a disk without hard links takes the other way
                        raise
        finally:
            self.fs.delete(part, False)
        return False

    def _link(self, part, target) -> None:
        files = self.jvm.java.nio.file
        made, wanted = (files.Paths.get(self.fs.makeQualified(p).toUri().getPath(), self.spark._gateway.new_array(self.jvm.java.lang.String, 0)) for p in (part, target))
        files.Files.createLink(wanted, made)

    def _rename(self, part, target) -> None:
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.makeQualified(part).toUri(), self.fs.getConf())
        context.rename(part, target, self.spark._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))

    def _write(self, path, text: str) -> bool:
        try:
            stream = self.fs.create(path, False)
        except Exception as e:
            if "already exists" in str(e) or "AlreadyExists" in str(e):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True


class LoomStore:
    """A graph under a folder. `graph()` is its newest state; `begin()` starts a change."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, self.root)

    def numbers(self) -> list[int]:
        """Numbers of all manifests, newest first."""
        return sorted((int(n[9:-5]) for n in self.files.names() if n.startswith("manifest-") and n.endswith(".json")), reverse=True)

    def newest(self) -> int:
        return self.manifest()[0]

    def manifest(self, number: int | None = None) -> tuple[int, dict]:
        """A commit's number and manifest; without a number those of the newest that can be read."""
        for one in self.numbers() if number is None else [number] * (number > 0):
            try:
                return one, json.loads(self.files.read(f"manifest-{one:09d}.json"))
            except ValueError:
                if number is not None:
                    raise ExecutionError(f"commit {number} is broken") from None
        return 0, copy.deepcopy(_EMPTY)

    def graph(self) -> Graph:
        return self.begin().graph()

    def begin(self) -> Change:
        top = max(self.numbers(), default=0)  # before the reading: a commit in between is a conflict
        _, manifest = self.manifest()
        return Change(self, top, manifest)

    def graph_at(self, number: int) -> Graph:
        """The graph as commit `number` left it; 0 is the empty one."""
        number, manifest = self.manifest(number)
        return Change(self, number, manifest).graph()

    def session(self, **options):
        from ..plans.writer import StoreSession

        return StoreSession(self, **options)

    # -- whole tables, for loading at scale

    def load_nodes(self, label: str, df: DataFrame, id_column: str | None = None, now_ms: int = 0, batch: tuple[str, int] | None = None) -> None:
        """Append a table as nodes of a label; ids are `id_column`'s, else new ones. `batch` (a
        stream's name and number) is committed with the rows, and a number that is not new adds none."""
        change = self.begin()
        if not change.first_time(batch):
            return
        plain = normalised(df)
        if id_column is None:
            plain = change.numbered(plain)
        else:
            plain = plain.withColumn("_id", F.col(f"`{id_column}`").cast("long"))
            top = plain.agg(F.max("_id").alias("m")).first()["m"] or 0
            change.manifest["next_id"] = max(change.manifest["next_id"], top + 1)
            if change.manifest["nodes"].get(label, {}).get("patch"):  # whose deleted rows may come again
                change.replace_nodes(label, change.graph().nodes[label].df)
        now = F.timestamp_millis(F.lit(now_ms).cast("long"))
        change.append_nodes(label, plain.withColumns({"_labels": F.array(F.lit(label)), "_created_at": now, "_updated_at": now, "_ver": F.lit(0).cast("long")}), [label])
        change.commit()

    def load_edges(self, type: str, df: DataFrame, src_kind: str, dst_kind: str, now_ms: int = 0, batch: tuple[str, int] | None = None) -> None:
        """Append a table (`_src`, `_dst`, properties) as edges of a type; `batch` as for nodes."""
        change = self.begin()
        if not change.first_time(batch):
            return
        plain = change.numbered(normalised(df))
        now = F.timestamp_millis(F.lit(now_ms).cast("long"))
        more = {"_src_kind": F.lit(src_kind), "_dst_kind": F.lit(dst_kind), "_created_at": now, "_updated_at": now}
        more |= {c: F.lit(None).cast("timestamp") for c in ("_valid_from", "_valid_to") if c not in plain.columns}
        change.append_edges(type, plain.withColumns(more))
        change.commit()

    # -- what has no syntax

    def node_count(self) -> int:
        return self.graph().node_scan((), set()).count()

    def edge_count(self) -> int:
        return self.graph().edge_scan((), set()).count()

    def node(self, kind: str, id: int) -> DataFrame:
        """The node of a kind with an id; one row or none."""
        return ops.node_of(self.graph(), kind, id)

    def edge(self, type: str, id: int) -> DataFrame:
        """The edge of a type with an id; one row or none."""
        return ops.edge_of(self.graph(), type, id)

    def edges_of(self, kind: str, id: int, types: tuple[str, ...] = ()) -> DataFrame:
        """The edges that begin or end at a node."""
        return ops.edges_of(self.graph(), kind, id, types)

    def versions(self, kind: str, id: int) -> DataFrame:
        """Earlier states of a node, oldest first in `_seq`."""
        return ops.versions_of(self.graph(), kind, id)

    def version(self, kind: str, id: int, number: int) -> DataFrame:
        """One earlier state of a node by its number; one row or none."""
        return self.versions(kind, id).where(F.col("_seq") == number)

    def latest_version(self, kind: str, id: int) -> DataFrame:
        """The last of a node's earlier states; one row or none."""
        return self.versions(kind, id).orderBy(F.desc("_seq")).limit(1)

    def snapshot_edge(self, type: str, id: int) -> int:
        """Keep an edge's present state as its next version, and give the version's number. Statements
        keep versions of nodes only."""
        change = self.begin()
        now = ops.edge_of(change.graph(), type, id)
        if now.isEmpty():
            raise ExecutionError(f"no edge {id} of type {type}")
        number = 1 + (self.edge_versions(type, id).agg(F.max("_seq").alias("n")).first()["n"] or 0)
        held = change.manifest.setdefault("edge_versions", {})
        rows = now.drop("_type").withColumn("_seq", F.lit(number).cast("long"))
        held[type] = change._put(held.get(type), rows, EDGE_SYSTEM + ", _seq long", True, [])
        change.commit()
        return number

    def edge_versions(self, type: str, id: int) -> DataFrame:
        """The kept states of an edge by `_seq`; no rows without any."""
        change = self.begin()
        entry = change.manifest.get("edge_versions", {}).get(type)
        if entry is None:
            return self.spark.createDataFrame([], EDGE_SYSTEM + ", _seq long")
        return change._read(entry).where(F.col("_id") == id)

    def indexes(self) -> list[dict]:
        """name, on (label or type), key and edge of every index."""
        return [dict(i) for i in self.manifest()[1]["indexes"]]

    def look_up(self, label: str, key: str, value) -> DataFrame:
        """Nodes by a property's value; with an index on it only the files that may have it are read."""
        return ops.index_scan(self.graph(), label, key, value)

    def look_up_range(self, label: str, key: str, low, high) -> DataFrame:
        return ops.range_scan(self.graph(), label, key, low, high)

    def delete_subgraph(self, subgraph_id: int) -> None:
        change = self.begin()
        g = change.graph()
        change.write_table("subgraphs", g.subgraph_scan().where(F.col("_id") != subgraph_id), SUBGRAPH_SYSTEM, False)
        change.write_table("members", g.member_scan().where(F.col("subgraph_id") != subgraph_id), MEMBER_SYSTEM, False)
        change.commit()

    def remove_member(self, subgraph_id: int, node_id: int, kind: str | None = None) -> None:
        """Take a node (of a kind, where ids are not unique) out of a subgraph."""
        change = self.begin()
        one = (F.col("subgraph_id") == subgraph_id) & (F.col("node_id") == node_id)
        kept = change.graph().member_scan().where(~(one if kind is None else one & (F.col("node_kind") == kind)))
        change.write_table("members", kept, MEMBER_SYSTEM, False)
        change.commit()

    def delete_hyperedge(self, hyperedge_id: int) -> None:
        change = self.begin()
        change.write_table("hyperedges", change.graph().hyperedge_scan().where(F.col("_id") != hyperedge_id), HYPEREDGE_SYSTEM, False)
        change.commit()


class Change:
    """A state of the graph that is being made; nothing of it is visible before `commit`."""

    def __init__(self, store: LoomStore, number: int, manifest: dict):
        self.store, self.spark, self.number, self.manifest = store, store.spark, number, copy.deepcopy(manifest)
        self._graph: Graph | None = None

    # -- reading

    def _read(self, entry: dict) -> DataFrame:
        """A table's rows, its patch laid over them."""
        schema = T.StructType.fromJson(entry["schema"])
        rows = self.spark.read.schema(schema).parquet(*[f"{self.store.root}/{p}" for p in entry["paths"]])
        if not entry.get("patch"):
            return rows
        patch = self._patch(entry)
        return rows.join(patch.select("_id"), "_id", "left_anti").select(rows.columns).unionByName(patch.where("NOT __gone").drop("__gone"))

    def _patch(self, entry: dict) -> DataFrame:
        """The newest state of changed rows, and deleted ones (`__gone`); one row an id."""
        schema = T.StructType.fromJson(entry["schema"]).add("__gone", "boolean")
        return self.spark.read.schema(schema).parquet(f"{self.store.root}/{entry['patch']}")

    def graph(self) -> Graph:
        if self._graph is None:
            m = self.manifest
            nodes = {k: NodeTable(self._read(e), frozenset(e["labels"]), e["uniform"]) for k, e in m["nodes"].items()}
            edges = tuple(EdgeTable(k, self._read(e)) for k, e in m["edges"].items())
            versions = {k: self._read(e) for k, e in m["versions"].items()}
            single = {n: self._read(m[n]) if m[n] else None for n in ("subgraphs", "members", "hyperedges")}
            self._graph = replace(Graph(self.spark, nodes, edges, versions), **single)
        return self._graph

    # -- writing

    def first_time(self, batch: tuple[str, int] | None) -> bool:
        """Note a stream's batch; False if it, or a later one, is in already."""
        if batch is None:
            return True
        seen = self.manifest.setdefault("batches", {})
        if seen.get(batch[0], -1) >= batch[1]:
            return False
        seen[batch[0]] = batch[1]
        return True

    def folder(self) -> str:
        return f"data/{uuid.uuid4().hex}"

    def numbered(self, df: DataFrame, column: str = "_id") -> DataFrame:
        """`df`, written down, with new ids that follow on from all before them."""
        rows, n = self.staged(df, "__row")
        first = self.take_ids(n)
        return rows.withColumn(column, F.col("__row") + F.lit(first)).drop("__row")

    def take_ids(self, n: int) -> int:
        first = self.manifest["next_id"]
        self.manifest["next_id"] = first + n
        return first

    def staged(self, df: DataFrame, row: str) -> tuple[DataFrame, int]:
        """`df`, written down and read again, with rows numbered from 0 in `row`, and their count.

        Numbers follow from each partition's count (one row a partition on the driver), so
        no sort and no single task is needed."""
        voids = {f.name: F.lit(None).cast("string") for f in df.schema.fields if isinstance(f.dataType, T.NullType)}
        path = f"{self.store.root}/{self.folder()}"
        df.withColumns(voids).withColumn("__m", F.monotonically_increasing_id()).write.parquet(path)
        rows = self.spark.read.parquet(path)
        part = F.shiftright("__m", 33)
        counts = {r["p"]: r["count"] for r in rows.groupBy(part.alias("p")).count().collect()}
        before, total = {}, 0
        for p in sorted(counts):
            before[p], total = total, total + counts[p]
        shift = F.lit(0).cast("long")
        if len(before) > 1:
            table = self.spark.createDataFrame(list(before.items()), "__p long, __before long")
            rows = rows.join(F.broadcast(table), part == F.col("__p")).drop("__p")
            shift = F.col("__before")
        rows = rows.withColumn(row, shift + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__m", "__before")
        return rows, total

    def _aligned(self, df: DataFrame, system: str, entry: dict | None) -> tuple[DataFrame, T.StructType, bool]:
        """Rows with the columns of a table: the system ones, its properties, new ones; and
        whether the table's own types had to widen."""
        wanted = {f.name: f.dataType for f in T.StructType.fromDDL(system).fields}
        wide = False
        if entry:
            wanted |= {f["name"]: T.StructType.fromJson(entry["schema"])[f["name"]].dataType for f in entry["schema"]["fields"]}
        for f in df.schema.fields:
            if isinstance(f.dataType, T.NullType):
                continue  # a property that is only ever null has no type yet, and no column
            if f.name not in wanted:
                wanted[f.name] = f.dataType
            elif wanted[f.name] != f.dataType and not f.name.startswith("_"):
                try:
                    both = common_type(wanted[f.name], f.dataType, f.name)
                except TypeError as e:
                    raise ExecutionError(str(e)) from e
                wide |= both != wanted[f.name]
                wanted[f.name] = both
        have = set(df.columns)
        out = df.select(*[(F.col(f"`{n}`") if n in have else F.lit(None)).cast(d).alias(n) for n, d in wanted.items()])
        return out, T.StructType([T.StructField(n, d) for n, d in wanted.items()]), wide

    def _put(self, entry: dict | None, df: DataFrame, system: str, append: bool, index: list[str]) -> dict:
        rows, schema, wide = self._aligned(df, system, entry)
        if append and entry and (wide or len(entry["paths"]) >= MOST_FOLDERS):
            old, _, _ = self._aligned(self._read(entry), system, {"schema": schema.jsonValue()})
            rows, append = old.unionByName(rows), False
        keys = [k for k in index if k in rows.columns]
        if keys:  # an index keeps its keys together in files, so their ranges can be skipped
            rows = rows.sortWithinPartitions(*[f"`{k}`" for k in keys])
        path = self.folder()
        rows.write.parquet(f"{self.store.root}/{path}")
        self._graph = None
        if append and entry:
            return {"paths": [*entry["paths"], path], "schema": schema.jsonValue(), "patch": entry.get("patch")}
        return {"paths": [path], "schema": schema.jsonValue()}

    def _patched(self, entry: dict, system: str, index: list[str], changed: DataFrame | None, gone: DataFrame | None) -> dict:
        """The table with rows in the state of `changed` and without the ids of `gone`."""
        self._graph = None
        rows = self._read(entry).where(F.lit(False)) if changed is None else changed
        rows, schema, wide = self._aligned(rows, system, entry)
        if wide:  # a property's type widened, which files in place cannot
            old, _, _ = self._aligned(self._read(entry), system, {"schema": schema.jsonValue()})
            return self._put({**entry}, old.join(rows.select("_id"), "_id", "left_anti").select(rows.columns).unionByName(rows), system, False, index)
        patch = rows.withColumn("__gone", F.lit(False))
        if gone is not None:
            patch = patch.unionByName(gone.select("_id", F.lit(True).alias("__gone")), allowMissingColumns=True)
        new = {**entry, "schema": schema.jsonValue()}
        path = self.folder()
        if entry.get("patch"):
            part = f"{self.store.root}/{self.folder()}"
            patch.write.parquet(part)
            patch = self.spark.read.schema(patch.schema).parquet(part)
            patch = self._patch(new).join(patch.select("_id"), "_id", "left_anti").select(patch.columns).unionByName(patch)
        patch.write.parquet(f"{self.store.root}/{path}")
        new["patch"] = path
        if self.store.files.size([path]) > PATCH_SHARE * self.store.files.size(entry["paths"]):
            return self._put({**entry}, self._read(new), system, False, index)
        return new

    def _index_keys(self, on: set[str], edge: bool) -> list[str]:
        return [i["key"] for i in self.manifest["indexes"] if i["edge"] == edge and i["on"] in on]

    def append_nodes(self, kind: str, df: DataFrame, labels: list[str]) -> None:
        entry = self.manifest["nodes"].get(kind)
        put = self._put(entry, df, NODE_SYSTEM, True, self._index_keys({kind, *labels}, False))
        before = set(entry["labels"]) if entry else set(labels)
        put["uniform"] = (entry["uniform"] if entry else True) and before == set(labels)
        put["labels"] = sorted(before | set(labels))
        self.manifest["nodes"][kind] = put

    def replace_nodes(self, kind: str, df: DataFrame, uniform: bool | None = None) -> None:
        entry = self.manifest["nodes"][kind]
        put = self._put({**entry}, df, NODE_SYSTEM, False, self._index_keys(set(entry["labels"]), False))
        self.manifest["nodes"][kind] = put | {"labels": entry["labels"], "uniform": entry["uniform"] if uniform is None else uniform}

    def patch_nodes(self, kind: str, changed: DataFrame | None = None, gone: DataFrame | None = None, uniform: bool | None = None) -> None:
        entry = self.manifest["nodes"][kind]
        put = self._patched(entry, NODE_SYSTEM, self._index_keys(set(entry["labels"]), False), changed, gone)
        self.manifest["nodes"][kind] = put | {"labels": entry["labels"], "uniform": entry["uniform"] if uniform is None else uniform}

    def patch_edges(self, type: str, changed: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        self.manifest["edges"][type] = self._patched(self.manifest["edges"][type], EDGE_SYSTEM, self._index_keys({type}, True), changed, gone)

    def append_versions(self, kind: str, df: DataFrame) -> None:
        self.manifest["versions"][kind] = self._put(self.manifest["versions"].get(kind), df, NODE_SYSTEM + ", _seq long", True, [])

    def append_edges(self, type: str, df: DataFrame) -> None:
        self.manifest["edges"][type] = self._put(self.manifest["edges"].get(type), df, EDGE_SYSTEM, True, self._index_keys({type}, True))

    def replace_edges(self, type: str, df: DataFrame) -> None:
        self.manifest["edges"][type] = self._put({**self.manifest["edges"][type]}, df, EDGE_SYSTEM, False, self._index_keys({type}, True))

    def write_table(self, name: str, df: DataFrame, system: str, append: bool = True) -> None:
        """subgraphs, members or hyperedges."""
        entry = self.manifest[name]
        self.manifest[name] = self._put({**entry} if entry else None, df, system, append, [])

    def commit(self) -> int:
        """Make the change the newest state, or fail if another one came first."""
        number = self.number + 1
        if not self.store.files.create(f"manifest-{number:09d}.json", json.dumps(self.manifest)):
            raise ExecutionError(f"another change was committed as number {number}")
        self.number = number
        return number
