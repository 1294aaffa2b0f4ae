"""States of nodes and validity of edges in time.

A state's time is `_updated_at`, else `_created_at`. Earlier states are numbered by
`_seq`; the current one has none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STATE = "__state"


def state_time(df: DataFrame) -> F.Column:
    """The time of a state; null where a table keeps no times."""
    have = [F.col(c) for c in ("_updated_at", "_created_at") if c in df.columns]
    return F.coalesce(*have, F.lit(None).cast("timestamp")) if have else F.lit(None).cast("timestamp")


def nodes_at(current: DataFrame, versions: DataFrame | None, at: F.Column) -> DataFrame:
    """The nodes of `current` as they were at a time; those that did not exist yet are left out.

    The current state if its time is not later; else the last earlier state (by number)
    whose time is not later; else the first state, if the node was created by then.
    Labels are the current ones. Tables without times hold nodes that always exist.
    One partial aggregation per node over its states that qualify."""
    if "_created_at" not in current.columns:
        return current
    live = current.where(F.col("_created_at") <= at)
    if versions is None:
        return live
    props = [c for c in current.columns if c not in ("_id", "_kind", "_labels")]
    have = set(versions.columns)
    now = live.select("_id", "_kind", F.col("_labels").alias("__labels"), F.when(state_time(live) <= at, F.lit(2)).otherwise(F.lit(-1)).alias("__rank"), F.lit(0).cast("long").alias("__order"), F.lit(True).alias("__live"), *[f"`{c}`" for c in props])
    old_props = [(F.col(f"`{c}`") if c in have else F.lit(None)).cast(dict(current.dtypes)[c]).alias(c) for c in props]
    passed = state_time(versions) <= at
    created = F.col("_created_at") <= at if "_created_at" in have else F.lit(False)
    old = versions.where(passed | created).select(
        "_id", "_kind", F.lit(None).cast("array<string>").alias("__labels"), F.when(passed, F.lit(1)).otherwise(F.lit(0)).alias("__rank"),
        F.when(passed, F.col("_seq")).otherwise(-F.col("_seq")).alias("__order"), F.lit(False).alias("__live"), *old_props,
    )
    picked = now.unionByName(old).groupBy("_id", "_kind").agg(
        F.max("__live").alias("__live"), F.first("__labels", ignorenulls=True).alias("_labels"),
        F.max_by(F.struct(F.col("__rank"), *[f"`{c}`" for c in props]), F.struct("__rank", "__order")).alias(_STATE),
    )
    picked = picked.where(F.col("__live") & (F.col(f"{_STATE}.__rank") >= 0))
    return picked.select("_id", "_kind", "_labels", *[F.col(f"{_STATE}.`{c}`").alias(c) for c in props])


def nodes_between(current: DataFrame, versions: DataFrame | None, low: F.Column, high: F.Column) -> DataFrame:
    """One row for every state of the nodes of `current`, the current one included, with a time
    in [low, high]. Tables without times hold nodes that always exist, in one state."""
    if not {"_created_at", "_updated_at"} & set(current.columns):
        return current
    inside = current.where(state_time(current).between(low, high))
    if versions is None:
        return inside
    old = versions.where(state_time(versions).between(low, high))
    have = set(versions.columns)
    props = [(F.col(f"`{c}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t in current.dtypes if c not in ("_id", "_kind", "_labels")]
    labels = current.select("_id", "_kind", "_labels")
    old = old.select("_id", "_kind", *props).join(labels, ["_id", "_kind"])
    return inside.unionByName(old.select(inside.columns))


def valid_at(edges: DataFrame, at: F.Column) -> DataFrame:
    """Edges in force at a time: `_valid_from` <= t and `_valid_to` open or later; without `_valid_from` always."""
    if "_valid_from" not in edges.columns:
        return edges
    end = F.col("_valid_to").isNull() | (_instant(edges, "_valid_to") > at) if "_valid_to" in edges.columns else F.lit(True)
    return edges.where(F.col("_valid_from").isNull() | ((_instant(edges, "_valid_from") <= at) & end))


def valid_between(edges: DataFrame, low: F.Column, high: F.Column) -> DataFrame:
    """Edges in force at some time of [low, high]: `_valid_from` <= high and `_valid_to` open or after low."""
    if "_valid_from" not in edges.columns:
        return edges
    end = F.col("_valid_to").isNull() | (_instant(edges, "_valid_to") > low) if "_valid_to" in edges.columns else F.lit(True)
    return edges.where(F.col("_valid_from").isNull() | ((_instant(edges, "_valid_from") <= high) & end))


def _instant(df: DataFrame, column: str) -> F.Column:
    """Validity may be kept as instants or as milliseconds."""
    kind = dict(df.dtypes)[column]
    return F.timestamp_millis(column) if kind in ("bigint", "int") else F.col(column)


def reference_states(current: DataFrame, versions: DataFrame | None, refs: DataFrame, at: str = "ts") -> DataFrame:
    """For references (`_id`, `_kind`, `at` in milliseconds or null): the node's state that a
    temporal reference shows, the last earlier state (by number) with `_updated_at` not
    later than `at`, else the current one."""
    base = refs.join(current, ["_id", "_kind"], "left")
    if versions is None or "_updated_at" not in versions.columns:
        return base
    keys = refs.select("_id", "_kind", at).where(F.col(at).isNotNull()).distinct()
    props = [c for c in versions.columns if c in current.columns and c not in ("_id", "_kind", "_labels")]
    old = versions.join(keys, ["_id", "_kind"]).where(F.col("_updated_at") <= F.timestamp_millis(at))
    last = old.groupBy("_id", "_kind", at).agg(F.max_by(F.struct(*[f"`{c}`" for c in props]), "_seq").alias(_STATE))
    joined = base.join(last, ["_id", "_kind", at], "left")
    found = F.col(_STATE).isNotNull()
    return joined.select(*[F.when(found, F.col(f"{_STATE}.`{c}`")).otherwise(F.col(f"`{c}`")).alias(c) if c in props else F.col(f"`{c}`") for c in base.columns])
