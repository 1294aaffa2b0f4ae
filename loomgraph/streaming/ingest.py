"""Streams of nodes and edges into a store, batch by batch, and counts over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..sources.store import LoomStore


def changes_into(store: LoomStore, stream: DataFrame, label: str | None = None, type: str | None = None, id_column: str | None = None, src_kind: str = "", dst_kind: str = "") -> DataStreamWriter:
    """A writer that appends each micro-batch as nodes of `label`, or as edges of `type`.

    The last batch's number is committed with its rows, so a batch that is delivered again
    after a failure is not appended twice. Set a checkpointLocation and start it."""
    if (label is None) == (type is None):
        raise ValueError("either a label or a type")
    stream_id = f"{label or type}"

    def batch(df: DataFrame, number: int) -> None:
        if label is not None:
            store.load_nodes(label, df, id_column, batch=(stream_id, number))
        else:
            store.load_edges(type, df, src_kind, dst_kind, batch=(stream_id, number))

    return stream.writeStream.foreachBatch(batch)


def windowed_counts(stream: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events of each key in each window; events later than `late` are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")
