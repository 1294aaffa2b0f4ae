"""Helpers shared by the document operators: scratch tables, text batches, labels."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The rest class of crc32(doc_id) mod 4 that no model may learn from.
HELD_OUT_CLASS = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path is only ever given to Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of `spark.checkpoint.dir`; one of our own only where it is unset, and
    only in local mode, as no other machine could read it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext.getCheckpointDir()
        if not held and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = held or "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        if not held:
            spark.sparkContext.setCheckpointDir(root)
            root = spark.sparkContext.getCheckpointDir() or root
    return root.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{scratch_root(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back: the lineage ends at files
    every executor can read again, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = path or scratch_path(spark, what)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def join_often(rows: DataFrame, table: DataFrame, key: str, most: int = 10_000) -> DataFrame:
    """`rows` joined with `table` (one row a key, which counts its `rows`) on `key`.

    Fewer than `most` keys can each hold more than one row in `most`; these are broadcast, a bound
    that does not grow, and only the rows of the other keys are dealt by key."""
    total = table.agg(F.sum("rows").alias("n")).first()["n"] or 0
    often = F.col("rows") > max(10_000, total // most)
    hot, rare = table.where(often).drop("rows"), table.where(~often).drop("rows")
    if hot.isEmpty():
        return rows.join(rare, key)
    some = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rare, key)
    return some.unionByName(rest)


def text_or_empty(column: str = "text") -> F.Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def held_out(doc_id: str = "doc_id") -> F.Column:
    """True where crc32 of the id as text leaves the held-out rest; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == HELD_OUT_CLASS, F.lit(False))


def give_back() -> None:
    """Return memory that nothing uses to the machine: workers wait for further tasks beside those that run."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library, which has its own ways


def map_text(
    df: DataFrame, fn: Callable[[list], dict[str, list]], schema: str, rows: int = 1000, after: Callable[[], None] | None = None
) -> DataFrame:
    """Apply `fn` to the last column of `df` in slices of at most `rows` rows.

    All columns but the last are carried through; `fn` gets a list of Python
    values and returns lists for the columns of `schema`, which is a DDL string of
    the new columns. Slices bound what a Python worker holds at a time. `after` is called at the
    end of each task, to give up what `fn` remembers: a worker lives on for tasks of other kinds.
    """
    spark_schema = _ddl(df, schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark_schema)
    kept = df.columns[:-1]
    new = [n for n in arrow.names if n not in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    part = batch.slice(at, rows)
                    got = fn(part.column(part.num_columns - 1).to_pylist())
                    columns = [part.column(i).cast(arrow.field(n).type) for i, n in enumerate(kept)]
                    columns += [pa.array(got[n], type=arrow.field(n).type) for n in new]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        finally:
            if after is not None:
                after()
            give_back()

    return df.mapInArrow(run, spark_schema)


def _ddl(df: DataFrame, schema: str):
    from pyspark.sql import types as T

    new = T.StructType.fromDDL(schema)
    return T.StructType([*df.schema.fields[:-1], *new.fields])


def bounded_labelled(docs: DataFrame, labels: DataFrame, target: str, limit: int) -> DataFrame:
    """target, doc_id, text: about `limit` labelled documents at most, outside the held-out class.

    The share kept of each class of `target` is set from the class counts so that
    rare classes are kept whole first; rows are chosen by a hash of their id, so
    the choice is the same on every run. An id with several labels has the largest of them, an
    id with several texts the first in order, so that repeated rows make no more of them. What is
    joined to the documents has at most `limit` rows, a bound that does not grow, so it is broadcast.
    """
    train = (
        labels.select("doc_id", F.col(target).cast("int").alias("target"))
        .where(F.col("doc_id").isNotNull() & F.col("target").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("target").alias("target"))
    )
    counts = {r["target"]: r["count"] for r in train.groupBy("target").count().collect()}
    share, left, room = {}, len(counts), limit
    for value, n in sorted(counts.items(), key=lambda x: x[1]):
        share[value] = min(1.0, room / left / n)
        room, left = room - min(n, room / left), left - 1
    unit = (F.xxhash64("doc_id", F.lit("sample")).bitwiseAND(F.lit((1 << 30) - 1))) / float(1 << 30)
    keep = F.lit(False)
    for value, p in share.items():
        keep = keep | ((F.col("target") == value) & (unit < p))
    chosen = train.where(keep).limit(int(limit * 1.1) + 100)
    found = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.max("target").alias("target"), F.min("text").alias("text")).select("target", "doc_id", "text")
