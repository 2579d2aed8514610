"""Supersession chains over facts: which fact replaced which, and what held when.

A slot is what a newer fact can replace: the entity and predicate of a single-valued predicate, what is counted of a counted one,
the value itself of any other. Within a slot facts are ordered by time of assertion, turn and id, a total order, so that the
result doesn't depend on the order of the input. Slots of any size are ordered month by month (see history.neighbours).

Facts without subject or predicate belong to no slot; a null value is an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import vocab
from factloom.functions.ids import edge_id
from factloom.functions.text import fold, strip
from factloom.operators.history import MONTH_S, neighbours


def slot(predicate: str = "predicate", value: str = "value_text") -> Column:
    v = fold(F.coalesce(F.col(value), F.lit("")))
    counted = strip(F.regexp_replace(v, vocab.LEADING_COUNT, ""))
    p = F.col(predicate)
    return F.when(p.isin(vocab.FUNCTIONAL), F.lit("")).when(p.isin(vocab.COUNTED), F.when(counted != "", counted).otherwise(v)).otherwise(v)


def _ordered(facts: DataFrame, keys: list[str], order: list[str], carry: list[str]) -> DataFrame:
    """facts with before and after, structs of carry, by order within keys."""
    f = facts
    for k in keys:
        f = f.where(F.col(k).isNotNull())
    first = F.coalesce(F.col(order[0]), F.lit(0))
    f = f.withColumns({"_o": F.struct(*[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in order]), "_m": F.floor(first / MONTH_S)})
    return neighbours(f, keys, "_m", "_o", carry).drop("_m", "_o")


CHAIN_ORDER = ["asserted_at", "turn_idx", "vid"]
HISTORY_ORDER = ["valid_from", "asserted_at", "turn_idx", "vid"]


def superseded(facts: DataFrame, entity: str = "subject_vid") -> DataFrame:
    """facts with status, valid_to and superseded_by as the chain gives them."""
    f = facts.withColumn("slot", slot())
    f = _ordered(f, ["instance_id", entity, "predicate", "slot"], CHAIN_ORDER, ["vid", "valid_from"])
    end = F.greatest(F.coalesce(F.col("after.valid_from"), F.lit(0)), F.coalesce("valid_from", F.lit(0)))
    return f.withColumns({
        "superseded_by": F.col("after.vid"),
        "status": F.when(F.col("after").isNull(), "current").otherwise("superseded"),
        "valid_to": F.when(F.col("after").isNull(), F.lit(0)).otherwise(end).cast("bigint"),
    }).drop("before", "after")


def pairs(facts: DataFrame, entity: str = "subject_vid") -> DataFrame:
    """src (newer), dst (older), rid, instance_id of each supersession."""
    s = superseded(facts, entity).where("superseded_by is not null")
    return s.select(F.col("superseded_by").alias("src"), F.col("vid").alias("dst"), edge_id("superseded_by", "SUPERSEDES", "vid").alias("rid"), "instance_id")


def predecessors(facts: DataFrame) -> DataFrame:
    """fact_id, replaced (the fact_id before it in its slot, by subject key)."""
    f = _ordered(facts.withColumn("slot", slot()), ["instance_id", "subject_key", "predicate", "slot"], CHAIN_ORDER, ["fact_id"])
    return f.where("before is not null").select("instance_id", "vid", "fact_id", F.col("before.fact_id").alias("replaced"))


def _changes(facts: DataFrame) -> DataFrame:
    f = facts.withColumn("_v", fold(F.coalesce("value_text", F.lit(""))))
    f = _ordered(f, ["instance_id", "subject_key", "predicate"], HISTORY_ORDER, ["_v"])
    return f.withColumn("changed", F.col("before").isNull() | (F.col("before._v") != F.col("_v"))).drop("before", "after", "_v")


def change_history(facts: DataFrame) -> DataFrame:
    """The facts of each (subject, predicate) that changed its value, in the order of validity."""
    return _changes(facts).where("changed").select("instance_id", "subject_key", "predicate", F.coalesce("valid_from", F.lit(0)).alias("changed_at"), "value_text", "fact_id", "vid")


def since_current(facts: DataFrame) -> DataFrame:
    """since: when the newest value of each (subject, predicate) became true, which may be before it was last restated."""
    keys = ["instance_id", "subject_key", "predicate"]
    # The trailing run begins at the last change; its start is the least valid_from in it, which is that row's own, as rows are in that order.
    last = change_history(facts).groupBy(*keys).agg(F.max(F.struct("changed_at", "vid")).alias("m"))
    return last.select(*keys, F.col("m.changed_at").alias("since"))


def current(facts: DataFrame, missing_is_current: bool = True) -> DataFrame:
    """Facts of status current; a null status counts as current unless told otherwise."""
    status = F.coalesce("status", F.lit("current")) if missing_is_current else F.col("status")
    return facts.where(status == "current")
