"""Metrics in the Prometheus text format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Milliseconds of the units that a metric's name ends in.
UNIT_MS = {"seconds": 1000.0, "microseconds": 0.001, "milliseconds": 1.0}


def lines(spark: SparkSession, path: str) -> DataFrame:
    """name, labelled, value, at of each sample; comments and unreadable values are left out."""
    t = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).where("value <> '' and not startswith(value, '#')")
    head = F.regexp_extract("value", r"^(\S+?)(?:\{.*\})?\s", 1)
    return t.select(head.alias("name"), F.regexp_extract("value", r"^([^ ]*)", 1).contains("{").alias("labelled"), F.regexp_extract("value", r"\s(\S+)\s*$", 1).try_cast("double").alias("sample"), "at").where("sample is not null and name <> ''")


def scalars(samples: DataFrame) -> DataFrame:
    """name, value of each sample without labels; the last of a name counts."""
    return samples.where("not labelled").groupBy("name").agg(F.max_by("sample", "at").alias("value"))


def histograms(samples: DataFrame) -> DataFrame:
    """metric, unit, sum, count, mean_ms, summed over labels; the unit is the end of the metric's name."""
    p = r"^(.*_(seconds|microseconds|milliseconds))_(sum|count)$"
    s = samples.where(F.col("name").rlike(p)).select(F.regexp_extract("name", p, 1).alias("metric"), F.regexp_extract("name", p, 2).alias("unit"), F.regexp_extract("name", p, 3).alias("part"), "sample")
    g = s.groupBy("metric", "unit").agg(F.sum(F.when(F.col("part") == "sum", F.col("sample")).otherwise(0.0)).alias("sum"), F.sum(F.when(F.col("part") == "count", F.col("sample")).otherwise(0.0)).alias("count"))
    scale = F.element_at(F.create_map(*[F.lit(x) for kv in UNIT_MS.items() for x in kv]), F.col("unit"))
    return g.withColumn("mean_ms", F.when(F.col("count") > 0, F.round(F.col("sum") * scale / F.col("count"), 3)).otherwise(0.0))


# The counters that a server's cost is told by.
SERVER_SCALARS = ["graph_queries_total", "graph_mutations_total", "graph_vertices_total"]


def server_cost(samples: DataFrame) -> DataFrame:
    """scope, metric, value, unit, note: the mean of every histogram in milliseconds, and the counters of SERVER_SCALARS that are there."""
    h = histograms(samples)
    note = F.concat(F.lit("mean over "), F.col("count").cast("bigint").cast("string"), F.lit(" samples; exported in "), "unit")
    timed = h.select(F.lit("server").alias("scope"), "metric", F.col("mean_ms").alias("value"), F.lit("ms").alias("unit"), note.alias("note"))
    counted = scalars(samples).where(F.col("name").isin(SERVER_SCALARS)).select(F.lit("server").alias("scope"), F.col("name").alias("metric"), "value", F.lit("count").alias("unit"), F.lit("").alias("note"))
    return timed.unionByName(counted)
