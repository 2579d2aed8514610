"""Type-two history of slots: one row for each version of a value, with the period in which it held.

The stored dimension has a row for each start of a slot: its own end (0: none), the hash of its attributes, the rank of the update
that stands for it, `until` (its end date, null while it is open) and `opens` (whether it begins a version, its hash being another
than that of the row it adjoins). merge() brings a batch of updates into it: each update is compared with the stored row of its
start by rank and hash (`verdict`: new, changed, restated, kept), rows that a new start follows are closed at it, and rows with
another hash than the one before open a version. Batches may come in any order; an update that comes late splits the version it
falls into. versions() gives each run from its opening row to the end of its last.

Of the updates of a slot with one start, the latest asserted stands; it lasts until its own end or the next start.

Rows shuffle once, by slot, for comparing, closing and opening together. A slot may hold a third of all rows: slots of more than
HOT rows are counted first and take another way, with updates reduced by partial aggregation and windows over one slot and one
month of starts, of which only the first and last row meet in a window over the whole slot.

Null values are a value of their own; rows without slot or without any start give no version; exact repeats change nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import squash
from factloom.session import discarded, written

SLOT = ["subject_vid", "predicate"]
MONTH_S = 2_629_746
#: Rows from which a slot is split.
HOT = 1_000_000
#: Batches that a log at rest is merged in, by time of arrival.
BATCHES = 3
ROW = [*SLOT, "start_at", "end_at", "attr_hash", "rank"]


def standing(updates: DataFrame, value: Column | None = None, tie: tuple[str, ...] = ("received_at", "log_id")) -> DataFrame:
    """The updates that have a slot and a start as rows of a dimension: start_at, end_at, attr_hash, and rank, the larger of which stands."""
    u = updates.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in SLOT)))
    u = u.withColumns({"start_at": F.coalesce("valid_from", "asserted_at"), "attr_hash": F.xxhash64(F.coalesce(squash("value_text") if value is None else value, F.lit("\x00")))}).where(F.col("start_at").isNotNull())
    rank = F.struct(F.coalesce("asserted_at", F.lit(-(2**62))).alias("asserted_at"), *[F.col(c) for c in tie if c in updates.columns])
    return u.select(*SLOT, "start_at", F.coalesce("valid_to", F.lit(0)).cast("bigint").alias("end_at"), "attr_hash", rank.alias("rank"))


def _verdict(fresh: Column, old: Column) -> Column:
    same = (old["attr_hash"] == F.col("attr_hash")) & (old["end_at"] == F.col("end_at"))
    return F.when(~fresh, "kept").when(old.isNull(), "new").when(same, "restated").otherwise("changed")


def _own_end() -> Column:
    return F.when(F.col("end_at") == 0, F.lit(None)).otherwise(F.greatest("end_at", "start_at"))


def _compared(rows: DataFrame) -> DataFrame:
    """ROW, verdict, until, opens of slots of bounded size: one exchange by slot serves every window."""
    start = Window.partitionBy(*SLOT, "start_at")
    w = Window.partitionBy(*SLOT).orderBy("start_at")
    best = F.row_number().over(start.orderBy(F.desc("rank"), F.desc("end_at"), F.desc("attr_hash"), "fresh"))
    r = rows.repartition(*SLOT).withColumns({"_n": best, "_old": F.max(F.when(~F.col("fresh"), F.struct("attr_hash", "end_at"))).over(start)}).where("_n = 1")
    r = r.withColumn("until", F.least(_own_end(), F.lead("start_at").over(w)))  # least skips nulls: null is open
    adjoins = (F.lag("attr_hash").over(w) == F.col("attr_hash")) & (F.lag("until").over(w) == F.col("start_at"))
    return r.select(*ROW, _verdict(F.col("fresh"), F.col("_old")).alias("verdict"), "until", (~F.coalesce(adjoins, F.lit(False))).alias("opens"))


def _compared_hot(rows: DataFrame) -> DataFrame:
    """The same of slots of any size."""
    order = F.struct("rank", "end_at", "attr_hash", (~F.col("fresh")).alias("stored"))
    best = rows.groupBy(*SLOT, "start_at").agg(F.max_by(F.struct("end_at", "attr_hash", "rank", "fresh"), order).alias("b"), F.max(F.when(~F.col("fresh"), F.struct("attr_hash", "end_at"))).alias("_old"))
    s = best.select(*SLOT, "start_at", "b.*", "_old").withColumn("month", F.floor(F.col("start_at") / MONTH_S))
    s = neighbours(s, SLOT, "month", "start_at", ["start_at", "end_at", "attr_hash"])
    before_until = F.when(F.col("before.end_at") == 0, F.col("start_at")).otherwise(F.least(F.greatest("before.end_at", "before.start_at"), F.col("start_at")))
    adjoins = (F.col("before.attr_hash") == F.col("attr_hash")) & (before_until == F.col("start_at"))
    return s.select(*ROW, _verdict(F.col("fresh"), F.col("_old")).alias("verdict"), F.least(_own_end(), F.col("after.start_at")).alias("until"), (~F.coalesce(adjoins, F.lit(False))).alias("opens"))


def hot_slots(rows: DataFrame, most: int = HOT) -> DataFrame | None:
    """The slots of more than `most` rows, None if there are none."""
    hot = rows.groupBy(*SLOT).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*SLOT)
    few = hot.limit(100_001).count()
    return None if not few else F.broadcast(hot) if few <= 100_000 else hot


def _apart(rows: DataFrame, hot: DataFrame | None, cold_way, hot_way) -> DataFrame:
    if hot is None:
        return cold_way(rows)
    return cold_way(rows.join(hot, SLOT, "left_anti")).unionByName(hot_way(rows.join(hot, SLOT, "left_semi")))


def merge(dimension: DataFrame | None, updates: DataFrame, most: int = HOT) -> DataFrame:
    """The dimension after a batch of standing() updates: ROW, verdict, until, opens."""
    rows = updates.select(*ROW, F.lit(True).alias("fresh"))
    if dimension is not None:
        rows = rows.unionByName(dimension.select(*ROW, F.lit(False).alias("fresh")))
    return _apart(rows, hot_slots(rows, most), _compared, _compared_hot)


def neighbours(df: DataFrame, keys: list[str], bucket: str, order: str, cols: list[str]) -> DataFrame:
    """Adds before and after, structs of cols of the rows next to each in its group, without one task for a large group."""
    row = F.struct(*cols)
    w = Window.partitionBy(*keys, bucket).orderBy(order)
    ends = df.groupBy(*keys, bucket).agg(F.min_by(row, order).alias("_f"), F.max_by(row, order).alias("_l"))
    across = Window.partitionBy(*keys).orderBy(bucket)
    ends = ends.select(*keys, bucket, F.lag("_l").over(across).alias("_b"), F.lead("_f").over(across).alias("_a"))
    inner = df.withColumns({"_lag": F.lag(row).over(w), "_lead": F.lead(row).over(w)})
    return inner.join(ends, [*keys, bucket]).withColumns({"before": F.coalesce("_lag", "_b"), "after": F.coalesce("_lead", "_a")}).drop("_lag", "_lead", "_b", "_a")


def _versions(dimension: DataFrame) -> DataFrame:
    w = Window.partitionBy(*SLOT).orderBy("start_at")
    r = dimension.repartition(*SLOT).withColumn("_run", F.sum(F.col("opens").cast("int")).over(w))
    return r.groupBy(*SLOT, "_run").agg(F.min("start_at").alias("valid_from"), F.max(F.coalesce("until", F.lit(2**62))).alias("e"), F.min("attr_hash").alias("attr_hash")).select(*SLOT, "valid_from", F.when(F.col("e") == 2**62, 0).otherwise(F.col("e")).alias("valid_to"), "attr_hash")


def _versions_hot(dimension: DataFrame) -> DataFrame:
    s = dimension.withColumn("month", F.floor(F.col("start_at") / MONTH_S))
    s = neighbours(s, SLOT, "month", "start_at", ["opens"])
    # Of a run only its first and last row matter; the last carries the end.
    s = s.withColumn("_last", F.coalesce(F.col("after.opens"), F.lit(True)))
    edge = s.where(F.col("opens") | F.col("_last")).withColumn("close", F.when(F.col("_last"), F.struct(F.coalesce("until", F.lit(0)).alias("at"))))
    w = Window.partitionBy(*SLOT, "month").orderBy("start_at").rowsBetween(0, Window.unboundedFollowing)
    heads = edge.groupBy(*SLOT, "month").agg(F.min_by("close", F.when(F.col("close").isNotNull(), F.col("start_at"))).alias("_c"))
    later = Window.partitionBy(*SLOT).orderBy("month").rowsBetween(1, Window.unboundedFollowing)
    heads = heads.select(*SLOT, "month", F.first("_c", ignorenulls=True).over(later).alias("_n"))
    out = edge.withColumn("_own", F.first("close", ignorenulls=True).over(w)).where("opens").join(heads, [*SLOT, "month"])
    return out.select(*SLOT, F.col("start_at").alias("valid_from"), F.coalesce("_own", "_n")["at"].alias("valid_to"), "attr_hash")


def versions(dimension: DataFrame, most: int = HOT) -> DataFrame:
    """subject_vid, predicate, valid_from, valid_to (0: open), attr_hash of each version."""
    d = dimension.select(*SLOT, "start_at", "until", "opens", "attr_hash")
    out = _apart(d, hot_slots(d, most), _versions, _versions_hot)
    return out.where((F.col("valid_to") == 0) | (F.col("valid_to") > F.col("valid_from")))


def single_valued(facts: DataFrame, canon: DataFrame) -> DataFrame:
    """Updates of predicates that hold one value. canon is the vocabulary; Spark broadcasts it by its size."""
    keep = canon.where("single_valued").select("predicate").distinct()
    return facts.join(keep, "predicate", "left_semi")


def fact_versions(facts: DataFrame, canon: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The versions after merging the log in batches, by time of arrival, into the stored dimension."""
    cols = [*SLOT, "value_text", "valid_from", "valid_to", "asserted_at", "received_at", "log_id"]
    arrived = F.coalesce(F.unix_micros("received_at"), F.lit(0))
    bounds = facts.select(F.percentile_approx(arrived, [i / batches for i in range(1, batches)], 200).alias("q")).first().q if batches > 1 else []
    number = reduce(lambda n, x: n + (arrived >= x).cast("int"), bounds or [], F.lit(0))
    dimension = None
    for i in range(batches):
        old, dimension = dimension, written(merge(dimension, standing(single_valued(facts.select(cols).where(number == i), canon))), "history")
        discarded(old)
    return versions(dimension).select(*SLOT, "valid_from", "valid_to")
