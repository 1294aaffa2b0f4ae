"""Order and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sort_limit(rows: DataFrame, order: list[tuple[F.Column, bool]], skip: int | None = None, limit: int | None = None) -> DataFrame:
    """Sorted (column, descending), null first ascending and last descending, then cut."""
    if order:
        rows = rows.orderBy(*[c.desc_nulls_last() if down else c.asc_nulls_first() for c, down in order])
    if skip:
        rows = rows.offset(skip)
    return rows if limit is None else rows.limit(limit)
