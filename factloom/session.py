"""Session builder and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession


def session(app: str = "factloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC; conf overrides the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for k, v in (defaults | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a local one only where that is unset (tests, one machine)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = os.path.join(tempfile.gettempdir(), "factloom-shared")
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def passing(spark: SparkSession, path: str) -> None:
    """Has a path deleted when the driver ends; until then every lazy result that reads it stays valid."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """df, materialised as a table in the shared folder: the lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    passing(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discarded(df: DataFrame | None) -> None:
    """Deletes the table of a written() that nothing reads any more, as in a loop whose next round is written."""
    if df is not None and (path := getattr(df, "_written_to", None)):
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores; a table of few small files is dealt out, larger ones are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def ship(spark: SparkSession, what: object) -> Broadcast:
    """A broadcast of an object with its class, for executors that don't have this package; read it with pickle.loads(b.value)."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(what))
