"""Writes as merges: guarded, keyed, and with checked endpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def guarded_merge(rows: DataFrame, key: list[str], guard: Column, arrival: Column, create_only: tuple[str, ...] = ()) -> DataFrame:
    """The state after applying rows in order of arrival, each only where its guard is strictly larger than the stored one.

    The winner has the largest guard and, of those, the first arrival; columns of create_only keep what arrived first. One
    aggregation with partial combine and no sort: a key with any number of rows meets in no one task. A null guard never
    replaces anything. Arrival must be unique for a key.
    """
    cols = [c for c in rows.columns if c not in key]
    late = F.struct(F.coalesce(guard, F.lit(-(2**62))).alias("g"), (-arrival).alias("a"))
    first = [c for c in cols if c in create_only]
    agg = [F.max_by(F.struct(*[c for c in cols if c not in create_only]), late).alias("_w")] + ([F.min_by(F.struct(*first), arrival).alias("_f")] if first else [])
    out = rows.groupBy(*key).agg(*agg)
    return out.select(*key, *[F.col(f"_f.{c}" if c in create_only else f"_w.{c}").alias(c) for c in cols])


def last_wins(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The last row of each key."""
    cols = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*cols), order).alias("_w")).select(*key, *[F.col(f"_w.{c}") for c in cols])


def first_wins(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    cols = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*cols), order).alias("_w")).select(*key, *[F.col(f"_w.{c}") for c in cols])


def dangling(edges: DataFrame, nodes: DataFrame, end: str, node: str = "vid") -> DataFrame:
    """Edges whose end is no node."""
    return edges.join(nodes.select(F.col(node).alias(end)), end, "left_anti")


def linked(edges: DataFrame, nodes: dict[str, DataFrame]) -> DataFrame:
    """Edges, one per rid, after a check that every end is there; nodes: end column -> node table. Raises on a dangling edge."""
    for end, table in nodes.items():
        if not dangling(edges, table, end).isEmpty():
            raise ValueError(f"edges with a missing {end}; nothing is written")
    return first_wins(edges, ["rid"], F.struct(*[c for c in edges.columns if c != "rid"]))
