"""Conversation logs from JSON, and logs of rows from JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.merge import last_wins

RAW = """question_id string, question_type string, question string, answer string, question_date string, haystack_session_ids array<string>, haystack_dates array<string>,
haystack_sessions array<array<struct<role:string, content:string, has_answer:boolean>>>, answer_session_ids array<string>"""


def parse_date(c: Column) -> Column:
    """"2023/04/10 (Mon) 17:50" as epoch seconds; null if it is no date."""
    t = F.regexp_replace(c, r"\s*\([^)]*\)\s*", " ")
    p = r"^(\d{4})/(\d{1,2})/(\d{1,2}) (\d{1,2}):(\d{2})$"
    day = F.unix_date(F.when(t.rlike(p), F.regexp_replace(t, p, "$1-$2-$3")).try_cast("date")).cast("bigint")
    return day * 86400 + F.regexp_extract(t, p, 4).try_cast("bigint") * 3600 + F.regexp_extract(t, p, 5).try_cast("bigint") * 60


def instances(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per question with its sessions, sorted by date (ties in file order) and numbered. Files of JSON lines (lines) are split among tasks, JSON arrays are read file by file: array_lines() turns one into lines once."""
    raw = spark.read.schema(RAW).option("multiLine", not lines).json(path)
    zipped = F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions")
    rows = F.transform(zipped, lambda s, i: F.struct(parse_date(s["haystack_dates"]).alias("timestamp"), i.alias("pos"), s["haystack_session_ids"].alias("session_id"), s["haystack_sessions"].alias("turns")))
    turn = lambda t, i: F.struct(i.cast("int").alias("idx"), t["role"].alias("role"), t["content"].alias("content"), F.coalesce(t["has_answer"], F.lit(False)).alias("has_answer"))
    sessions = F.transform(F.array_sort(rows), lambda s, i: F.struct(s["session_id"].alias("session_id"), i.cast("int").alias("idx"), s["timestamp"].alias("timestamp"), F.transform(s["turns"], turn).alias("turns")))
    return raw.select(F.col("question_id").alias("instance_id"), "question_type", "question", F.coalesce(F.col("answer"), F.lit("")).alias("answer"), parse_date(F.col("question_date")).alias("asked_at"), F.coalesce(F.col("question_id").endswith("_abs"), F.lit(False)).alias("is_abstention"), sessions.alias("sessions"), "answer_session_ids")


def array_lines(spark: SparkSession, path: str, to: str) -> None:
    """Writes a JSON array, the file of a published corpus, as JSON lines that further reads split."""
    spark.read.schema(RAW).option("multiLine", True).json(path).repartition(spark.sparkContext.defaultParallelism).write.mode("overwrite").json(to)


def instance(all_: DataFrame, instance_id: str) -> DataFrame:
    """One instance; KeyError if there is none."""
    one = all_.where(F.col("instance_id") == instance_id).limit(1)
    if one.isEmpty():
        raise KeyError(instance_id)
    return one


def sessions(instances_: DataFrame) -> DataFrame:
    return instances_.select("instance_id", F.inline("sessions"))


def turns(instances_: DataFrame) -> DataFrame:
    return sessions(instances_).select("instance_id", "session_id", F.inline("turns"))


def done_rows(spark: SparkSession, path: str, schema: str, key: list[str]) -> DataFrame:
    """Rows of a log of JSON lines, the last one of each key; lines of files are ordered by file and place."""
    rows = spark.read.schema(schema).json(path).withColumn("_at", F.struct(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")))
    return last_wins(rows, key, F.col("_at")).drop("_at")


def remaining(todo: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """What a resumed run still has to do."""
    return todo.join(done.select(*key), key, "left_anti")
