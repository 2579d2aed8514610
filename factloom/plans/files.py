"""Queries over files of the formats that the engine reads and writes, made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.memory import Memory
from factloom.plans import sql
from factloom.plans.graph import FACTS
from factloom.session import passing, scratch
from factloom.sources import corpus, metrics, store
from factloom.sources.tables import table


def _folder(spark: SparkSession, name: str) -> str:
    where = scratch(spark, name)
    passing(spark, where)
    return where


def corpus_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Conversations written as the corpus' JSON and read back: sessions in order of their dates, numbered, with their turns counted."""
    s = table(spark, d, "sessions").where("key is not null and instance_id is not null and received_at is not null").select("instance_id", "key", F.date_format("received_at", "yyyy/MM/dd (E) HH:mm").alias("date"))
    t = table(spark, d, "turns").where("session_id is not null").groupBy(F.col("session_id").alias("key")).agg(F.array_sort(F.collect_list(F.struct("idx", "role", "content", "has_answer"))).alias("t"))
    s = s.join(t, "key", "left").select("instance_id", "key", "date", F.coalesce(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"), x["has_answer"].alias("has_answer"))), F.array().cast("array<struct<role: string, content: string, has_answer: boolean>>")).alias("turns"))
    g = s.groupBy("instance_id").agg(F.array_sort(F.collect_list(F.struct("key", "date", "turns"))).alias("s"))  # the format has one object a conversation log
    i = table(spark, d, "instances").select("instance_id", "question_type", "question", "answer").join(g, "instance_id")
    one = lambda c: F.transform("s", lambda x: x[c])
    path = _folder(spark, "corpus")
    i.select(F.col("instance_id").alias("question_id"), "question_type", "question", "answer", F.lit("2024/01/02 (Tue) 03:04").alias("question_date"), one("key").alias("haystack_session_ids"), one("date").alias("haystack_dates"), one("turns").alias("haystack_sessions")).write.json(path)
    read = corpus.instances(spark, path, lines=True)
    return corpus.sessions(read).select("instance_id", "session_id", "idx", "timestamp", F.size("turns").alias("turns"))


def corpus_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions written as the corpus' JSON and read back: numbers as text, abstentions by id, dates as epochs."""
    i = table(spark, d, "instances").where("instance_id is not null")
    path = _folder(spark, "corpus")
    i.select(F.col("instance_id").alias("question_id"), "question_type", "question", "answer", F.date_format(F.timestamp_seconds("asked_at"), "yyyy/MM/dd (E) HH:mm").alias("question_date")).write.json(path)
    return corpus.instances(spark, path, lines=True).select("instance_id", "question_type", "question", "answer", "asked_at", "is_abstention")


def log_last_rows(spark: SparkSession, d: str) -> DataFrame:
    """Answers logged as JSON lines, in two runs, and what a resumed run finds done."""
    r = table(spark, d, "results").select("delivery_id", "arm", "answer").distinct()
    path = _folder(spark, "log")
    store.append_lines(r.where("arm <> 'vector_rag'"), path)
    store.append_lines(r.where("arm = 'vector_rag'"), path)
    done = corpus.done_rows(spark, path, "delivery_id bigint, arm string, answer string", ["delivery_id"])
    left = corpus.remaining(r, done.where("arm = 'full_context'"), ["delivery_id"])
    return done.join(left.select("delivery_id", F.lit(True).alias("left_over")), "delivery_id", "left").select("delivery_id", "arm", "answer", F.coalesce("left_over", F.lit(False)).alias("left_over"))


def csv_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts written as CSV and read back."""
    path = _folder(spark, "csv")
    store.to_csv(table(spark, d, "facts").groupBy("predicate", "status").agg(F.count("*").alias("n")), path)
    return spark.read.option("header", True).schema("predicate string, status string, n bigint").csv(path)


def snapshot_versions(spark: SparkSession, d: str) -> DataFrame:
    """Facts written as two versions of a table: what a reader of each version sees."""
    s = store.Snapshots(spark, _folder(spark, "versions"))
    f = table(spark, d, "facts").select("log_id", "status")
    marks = [s.write("facts", f.where("status = 'current'")), s.write("facts", f)]
    parts = [s.read("facts", v).groupBy("status").agg(F.count("*").alias("n")).withColumn("version", F.lit(v).cast("bigint")) for v in marks]
    return parts[0].unionByName(parts[1])


def metric_means(spark: SparkSession, d: str) -> DataFrame:
    """Latencies written as metrics in the text format of a scrape, and the server's cost read from it."""
    g = table(spark, d, "results").where("latency_ms is not null and arm is not null").groupBy("arm").agg(F.round(F.sum("latency_ms"), 3).alias("s"), F.count("*").alias("n"))
    lines = g.select(F.explode(F.array(F.concat(F.lit("# HELP "), "arm"), F.concat(F.col("arm"), F.lit('_milliseconds_sum{kind="read"} '), F.col("s").cast("decimal(20,3)").cast("string")), F.concat(F.col("arm"), F.lit('_milliseconds_count{kind="read"} '), F.col("n").cast("string")))).alias("value"))
    total = g.agg(F.sum("n").alias("n")).select(F.concat(F.lit("graph_queries_total "), F.col("n").cast("string")).alias("value"))
    path = _folder(spark, "metrics")
    lines.unionByName(total).coalesce(1).write.text(path)
    return metrics.server_cost(metrics.lines(spark, path)).select("metric", "value", "unit", "note")


def memory_facts(spark: SparkSession, d: str) -> DataFrame:
    """The facts of a memory that the tables' extractions were added to, with their chains."""
    m = Memory(spark, _folder(spark, "memory"))
    m.add(table(spark, d, "extracted_facts"), table(spark, d, "sessions"), table(spark, d, "turns"))
    return m.facts().select("vid", "fact_id", "instance_id", "status", "valid_to", "superseded_by")


QUERIES = {f.__name__: f for f in (corpus_sessions, corpus_questions, log_last_rows, csv_counts, snapshot_versions, metric_means, memory_facts)}

ORACLE = {
    "corpus_sessions": """WITH s AS (SELECT instance_id, key, epoch(date_trunc('minute', received_at))::BIGINT AS ts FROM sessions WHERE key IS NOT NULL AND instance_id IS NOT NULL AND received_at IS NOT NULL AND instance_id IN (SELECT instance_id FROM instances)), t AS (SELECT session_id, count(*)::INT AS n FROM turns GROUP BY 1)
 SELECT instance_id, key AS session_id, (row_number() OVER (PARTITION BY instance_id ORDER BY ts, key) - 1)::INT AS idx, ts AS timestamp, coalesce(n, 0) AS turns FROM s LEFT JOIN t ON t.session_id = s.key""",
    "corpus_questions": "SELECT instance_id, question_type, question, coalesce(answer, '') AS answer, asked_at // 60 * 60 AS asked_at, ends_with(instance_id, '_abs') AS is_abstention FROM instances WHERE instance_id IS NOT NULL",
    "log_last_rows": "SELECT DISTINCT delivery_id, arm, answer, arm <> 'full_context' AS left_over FROM results",
    "csv_counts": "SELECT predicate, status, count(*) AS n FROM facts GROUP BY 1, 2",
    "snapshot_versions": "SELECT status, count(*) AS n, 1::BIGINT AS version FROM facts WHERE status = 'current' GROUP BY 1 UNION ALL SELECT status, count(*), 2 FROM facts GROUP BY 1",
    "metric_means": """WITH g AS (SELECT arm, round(sum(latency_ms), 3) AS s, count(*) AS n FROM results WHERE latency_ms IS NOT NULL AND arm IS NOT NULL GROUP BY 1) SELECT arm || '_milliseconds' AS metric, round(s / n, 3) AS value, 'ms' AS unit, 'mean over ' || n || ' samples; exported in milliseconds' AS note FROM g
 UNION ALL SELECT 'graph_queries_total', sum(n)::DOUBLE, 'count', '' FROM g""",
    "memory_facts": f"""WITH {FACTS}, c AS (SELECT *, lead(vid) OVER w AS nxt, lead(vf) OVER w AS nvf FROM (SELECT *, {sql.slot()} AS slot FROM fr) WINDOW w AS (PARTITION BY instance_id, subject_key, predicate, slot ORDER BY said_at, turn_idx, vid))
 SELECT vid, substr(kk, 1, 16) AS fact_id, instance_id, CASE WHEN nxt IS NULL THEN 'current' ELSE 'superseded' END AS status, CASE WHEN nxt IS NULL THEN 0 ELSE greatest(nvf, vf) END AS valid_to, nxt AS superseded_by FROM c""",
}
