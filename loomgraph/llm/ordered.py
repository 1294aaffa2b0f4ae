"""Documents in ascending id order over many partitions, without a global sort in one task."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Accuracy of the quantiles that place the cuts; partitions at most. Beyond these they grow, which
#: is safe: a partition is sorted by Spark, which spills, and read as a stream of rows.
ACCURACY, MOST_PARTS = 1e-3, 20_000


def sizes(docs: DataFrame) -> tuple[int, int]:
    """Rows, and bytes of their texts."""
    row = docs.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(text_or_empty())).alias("bytes")).first()
    return row["rows"], row["bytes"] or 0


def parts_for(total_bytes: int, target_bytes: int, most: int = MOST_PARTS) -> int:
    """Partitions so that each holds about `target_bytes` of text, but no more than `most`."""
    return int(max(1, min(most, -(-total_bytes // target_bytes))))


def id_cuts(docs: DataFrame, parts: int) -> list[int]:
    """Ascending ids that cut the documents into up to `parts` ranges of like size."""
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    got = docs.select(F.col("doc_id").cast("double").alias("d")).approxQuantile("d", shares, min(ACCURACY, 0.2 / parts))
    return sorted({int(x) for x in got})


def part_column(cuts: list[int]) -> F.Column:
    """The number of the range of doc_id: how many cuts are not above it; null ids come first."""
    if not cuts:
        return F.lit(0)

    @F.pandas_udf("int")
    def part(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: 0 if pd.isna(x) else bisect_right(cuts, x)).astype("int32")

    return part(F.col("doc_id"))


def by_id(docs: DataFrame, cuts: list[int], lookahead: bool = False) -> DataFrame:
    """part, ahead, doc_id, text, dealt by `part` and sorted by ahead, doc_id (null first), text.

    With `lookahead` every part also gets the rows of the smallest id of the next part
    that has rows (of the first part, for the last one), marked ahead, so a reader of
    one part can see the document that follows its last one.
    """
    rows = docs.select(part_column(cuts).alias("part"), F.lit(False).alias("ahead"), "doc_id", text_or_empty().alias("text"))
    if lookahead:
        ids = docs.select("doc_id", part_column(cuts).alias("part"))
        firsts = ids.groupBy("part").agg(F.min("doc_id").alias("least"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls"))
        found = sorted((r["part"], None if r["nulls"] else r["least"]) for r in firsts.collect())  # one row a part
        before = {least: found[k - 1][0] for k, (_, least) in enumerate(found)}
        none = before.pop(None, None)
        target = F.lit(None).cast("int")
        if before:
            pairs = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if len(before) <= 64 else None
            target = pairs[F.col("doc_id")] if pairs is not None else _looked_up(before)(F.col("doc_id"))
        if none is not None:
            target = F.when(F.col("doc_id").isNull(), F.lit(none)).otherwise(target)
        copies = F.array_compact(F.array(F.struct("part", "ahead"), F.when(target.isNotNull(), F.struct(target.cast("int").alias("part"), F.lit(True).alias("ahead")))))
        rows = rows.select(F.explode(copies).alias("to"), "doc_id", "text").select("to.part", "to.ahead", "doc_id", "text")
    dealt = rows.repartitionById(len(cuts) + 1, F.col("part"))
    return dealt.sortWithinPartitions("ahead", F.asc_nulls_first("doc_id"), "text")


def _looked_up(table: dict[int, int]):
    @F.pandas_udf("int")
    def find(ids: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else table.get(x) for x in ids], dtype="Int32")

    return find
