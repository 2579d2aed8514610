"""Exactly one copy of each message out of an at-least-once stream.

A keyed state store (RocksDB) holds for each message its keeper: the delivery received first, then of the smallest id. Messages share
a state by shards of their hash, some hundreds in each, as a call of the state's function costs far more than an entry does. Timers on
the event-time watermark (latest arrival so far) expire an entry that was last seen a horizon ago and put its keeper out to an archive.
A message without state is looked up in the archive of the batches before, so that copies later than the horizon are still known
for what they are. State, timers and offsets are Spark's checkpoint of a micro-batch; what a batch puts out is written below its
number and counts once the batch is in the checkpoint's commit log, so that a batch that is run again after a failure replaces its
own results and nothing else.

The stream may come in any order: a copy received before the keeper replaces it, and the former keeper is put out as dropped. An
expired message that comes again has a new life in the state; of the keepers of its lives only the first received stays. Copies
are reduced within each batch of rows before they shuffle: only the best one goes to its message's state, the others are dropped
on the spot, spread over all tasks, so that a message with a third of all rows meets in no one task.

Null parts of the key are a value of their own, a null arrival time is later than any other, repeats of one delivery id are one
delivery, and an empty stream gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.text import fold
from factloom.session import passing, scratch

LATEST = 2**62
DROPPED = "delivery_id bigint"
EVENTS = "kind string, message string, at bigint, id bigint"
STATE = "entries string"
#: Shards of messages; a stream of very many messages takes more, so that a shard holds some hundreds. It can't change within a stream.
SHARDS = 256
#: Folders that the archive is spread over by the message's hash; a batch reads only those that its messages fall in.
BUCKETS = 16
#: Micro-batches that a table at rest is replayed in.
BATCHES = 4
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def message_key() -> Column:
    """(run_id, arm, instance_id), the id without case and surrounding white space."""
    return F.to_json(F.struct(F.coalesce("run_id", F.lit("\x00")).alias("r"), F.coalesce("arm", F.lit("\x00")).alias("a"), F.coalesce(fold("instance_id"), F.lit("\x00")).alias("i")))


def _reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The best copy of each message with its shard; further copies with no message and a negative shard of few values."""
    for b in batches:
        b = b.sort_values(["at", "id"], kind="stable")
        again = b.duplicated("message")
        yield b[~again]
        spare = b[again & ~b.duplicated(["message", "id"])]
        yield spare.assign(shard=-1 - spare["id"] % 32, message=None)


def _settled(horizon_ms: int):
    """The function of one shard's rows and state: rows of EVENTS."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = max(state.getCurrentWatermarkMs(), 0)
        kinds: list[tuple] = []
        held = {m: (a, i, t) for m, a, i, t in json.loads(state.get[0])} if state.exists else {}
        touched: dict[str, int | None] = {}  # and the keeper that each had
        if not state.hasTimedOut:
            if key[0] < 0:
                for f in frames:
                    yield pd.DataFrame({"kind": "lost", "message": None, "at": f["at"], "id": f["id"]})
                return
            for f in frames:
                for m, a, i in zip(f["message"].tolist(), f["at"].tolist(), f["id"].tolist(), strict=True):
                    at, id_, seen = held.get(m, (None, None, now))
                    touched.setdefault(m, id_)
                    if id_ is None or (a, i) < (at, id_):
                        if id_ is not None and id_ != i:
                            kinds.append(("lost", None, at, id_))
                        at, id_ = a, i
                    elif i != id_:
                        kinds.append(("lost", None, a, i))
                    held[m] = (at, id_, max(seen, a // 1000 if a < LATEST else 0))
            kinds += [("keeper", m, *held[m][:2]) for m, was in touched.items() if held[m][1] != was]
        over = [m for m, (_, _, seen) in held.items() if seen + horizon_ms < now and m not in touched]
        kinds += [("gone", m, *held.pop(m)[:2]) for m in over]
        if held:
            state.update((json.dumps([(m, *x) for m, x in held.items()]),))
            state.setTimeoutTimestamp(max(min(seen for _, _, seen in held.values()) + horizon_ms, now) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(kinds, columns=["kind", "message", "at", "id"])

    return run


def settled(deliveries: DataFrame, horizon_s: int, shards: int = SHARDS) -> DataFrame:
    """Rows of EVENTS of a stream of deliveries: keeper (a message's new best copy), lost (a copy to be dropped), gone (an expired entry)."""
    at = F.coalesce(F.unix_micros("received_at"), F.lit(LATEST))
    rows = deliveries.where("delivery_id is not null").select(message_key().alias("message"), at.alias("at"), F.col("delivery_id").alias("id"), F.col("received_at").cast("timestamp").alias("on"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("message"), F.lit(shards)))
    rows = rows.mapInPandas(_reduced, "message string, at bigint, id bigint, on timestamp, shard bigint").withWatermark("on", "0 seconds")
    # Spark filters what is older than the watermark before the state sees it. Late copies are cases here, so the column
    # is emptied behind the watermark; the mark itself has been taken from it by then.
    empty = F.lit(None).cast("timestamp").alias("on", metadata={"spark.watermarkDelayMs": 0})
    rows = rows.select("shard", "message", "at", "id", empty)
    return rows.groupBy("shard").applyInPandasWithState(_settled(horizon_s * 1000), EVENTS, STATE, "append", "EventTimeTimeout")


def _listed(spark: SparkSession, folder: str) -> list[str]:
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def committed(spark: SparkSession, root: str) -> list[int]:
    """The batches that the checkpoint's commit log holds."""
    return sorted(int(n) for n in _listed(spark, f"{root}/checkpoint/commits") if n.isdigit())


def absorb(root: str):
    """The foreachBatch function that writes a batch's events below root and looks its keepers up in the archive."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.when(F.col("kind") == "lost", F.lit(0)).otherwise(F.pmod(F.xxhash64("message"), F.lit(BUCKETS))).cast("int")
        # Written once: reading the batch again would run the state again.
        batch.withColumn("bucket", bucket).repartition("kind", "bucket").write.mode("overwrite").partitionBy("kind", "bucket").parquet(f"{root}/events/{number}")
        late = spark.createDataFrame([], DROPPED)
        earlier = [n for n in committed(spark, root) if n < number and "kind=gone" in _listed(spark, f"{root}/events/{n}")]
        if earlier and "kind=keeper" in _listed(spark, f"{root}/events/{number}"):
            where = f"{root}/events/{number}/kind=keeper"
            buckets = [int(x.removeprefix("bucket=")) for x in _listed(spark, where) if x.startswith("bucket=")]
            schema = "message string, at bigint, id bigint, bucket int"
            keepers = spark.read.schema(schema).parquet(where)
            gone = reduce(DataFrame.unionByName, (spark.read.schema(schema).parquet(f"{root}/events/{n}/kind=gone") for n in earlier))
            gone = gone.where(F.col("bucket").isin(buckets)).groupBy("message").agg(F.min(F.struct("at", "id")).alias("old"))
            met = keepers.join(gone, "message").select(F.struct("at", "id").alias("new"), "old").where("new.id <> old.id")
            late = met.select(F.when(F.col("old") < F.col("new"), F.col("new.id")).otherwise(F.col("old.id")).alias("delivery_id"))
        late.write.mode("overwrite").parquet(f"{root}/late/{number}")

    return run


def stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """The deliveries below path as a stream; path is a folder of Parquet files or one file."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        return reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())
    return reader.parquet(path)


def replayed(spark: SparkSession, path: str, batches: int = BATCHES) -> str:
    """A folder with the deliveries of a table at rest in as many files as batches, by batch_no: the stream that they came in."""
    where = scratch(spark, "deliveries")
    rows = spark.read.parquet(path).select("delivery_id", "received_at", "run_id", "arm", "instance_id", "batch_no")
    rows.repartitionByRange(batches, F.coalesce("batch_no", F.lit(0)), "delivery_id").drop("batch_no").write.parquet(where)
    passing(spark, where)
    return where


def dropped_deliveries(spark: SparkSession, path: str, horizon_s: int = 7 * 86400, files_per_batch: int = 1000, root: str | None = None) -> DataFrame:
    """delivery_id of each delivery that is a further copy, after running the stream over all that is there.

    With root given, a second call goes on where the first ended.
    """
    own = root is None
    root = root or scratch(spark, "delivery")
    schema = spark.read.parquet(path).select("delivery_id", "received_at", "run_id", "arm", "instance_id").schema
    events = settled(stream(spark, path, schema, files_per_batch), horizon_s)
    # The number of state partitions stays what it is at a stream's first start; both settings hold for this query only.
    ours = {"spark.sql.streaming.stateStore.providerClass": STORE, "spark.sql.shuffle.partitions": str(min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))}
    before = {k: spark.conf.get(k, None) for k in ours}
    for k, v in ours.items():
        spark.conf.set(k, v)
    try:
        query = events.writeStream.foreachBatch(absorb(root)).outputMode("append").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    if own:
        passing(spark, root)
    out = spark.createDataFrame([], DROPPED)
    for n in committed(spark, root):
        out = out.unionByName(spark.read.schema(DROPPED).parquet(f"{root}/late/{n}"))
        if "kind=lost" in _listed(spark, f"{root}/events/{n}"):
            out = out.unionByName(spark.read.schema("id bigint").parquet(f"{root}/events/{n}/kind=lost").select(F.col("id").alias("delivery_id")))
    return out.distinct()
