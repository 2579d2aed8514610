"""Three ways to answer the same questions, with rows of one schema: all sessions in one prompt, the nearest turns, the cascade.

Replies of the reader are an input table (instance_id, arm, text, prompt_tokens, completion_tokens, latency_ms).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import vocab
from factloom.operators import retrieval
from factloom.operators.answer import ABSTAIN

COLUMNS = ["arm", "instance_id", "answer", "abstained", "reason", "gate_detail", "appealed", "appeal_won", "overflow", "provider", "prompt_chars", "prompt_tokens", "completion_tokens", "round_trips", "latency_ms"]


def _rows(shown: DataFrame, replies: DataFrame, arm: str, overflow: Column | None = None) -> DataFrame:
    """Rows of an arm without gates. shown: instance_id, prompt_chars."""
    r = replies.where(F.col("arm") == arm).drop("arm").join(shown, "instance_id")
    text = F.trim(F.coalesce("text", F.lit("")))
    over = F.lit(False) if overflow is None else overflow
    return r.select(
        F.lit(arm).alias("arm"), "instance_id", text.alias("answer"), F.upper(text).startswith(ABSTAIN).alias("abstained"), F.lit("").alias("reason"), F.lit("").alias("gate_detail"), F.lit(False).alias("appealed"), F.lit(False).alias("appeal_won"),
        over.alias("overflow"), F.when(over, "overflow").otherwise("").alias("provider"), "prompt_chars", "prompt_tokens", "completion_tokens", F.lit(0).alias("round_trips"), "latency_ms",
    ).select(COLUMNS)


def full_context(turns: DataFrame, replies: DataFrame, ceiling: int | None = None) -> DataFrame:
    """Every session whole. Beyond the ceiling, in tokens of the prompt, another provider takes the request: an overflow."""
    size = F.length(retrieval.turn_line()).cast("bigint") + 1
    shown = turns.where("session_id is not null and instance_id is not null").groupBy("instance_id").agg(F.sum(size).alias("prompt_chars"))
    return _rows(shown, replies, "full_context", None if ceiling is None else F.coalesce(F.col("prompt_tokens") > ceiling, F.lit(False)))


def vector_rag(chunks: DataFrame, questions: DataFrame, replies: DataFrame, k: int = vocab.TOP_K) -> DataFrame:
    """The k turns of an instance nearest to its question. chunks: instance_id, id, text, embedding; questions: instance_id, embedding.

    Each chunk meets the one question of its instance; the k best of a bucket of chunks are kept before buckets meet.
    """
    q = questions.select("instance_id", F.col("embedding").alias("_q"))
    dot = F.aggregate(F.zip_with("embedding", "_q", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    c = chunks.join(q, "instance_id").where("size(embedding) = size(_q)").select("instance_id", "id", F.length("text").cast("bigint").alias("chars"), F.round(dot, 9).alias("score"), F.pmod(F.xxhash64("id"), F.lit(16)).alias("b"))
    for keys in (["instance_id", "b"], ["instance_id"]):
        c = c.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))).where(F.col("n") <= k)
    return _rows(c.groupBy("instance_id").agg(F.sum("chars").alias("prompt_chars")), replies, "vector_rag")


def gated(answers: DataFrame, requests: DataFrame, replies: DataFrame, arm: str = "gated") -> DataFrame:
    """The cascade's rows: answers of answer.answered, with what its requests and replies cost. A question that a gate stops costs no reply."""
    said = requests.groupBy("instance_id").agg(F.max(F.when(F.col("attempt") == 1, F.length("prompt"))).cast("bigint").alias("prompt_chars"))
    r = replies.where(F.col("arm") == arm).select("instance_id", "prompt_tokens", "completion_tokens", "latency_ms")
    a = answers.join(said, "instance_id", "left").join(r, "instance_id", "left")
    read = F.exists("trace", lambda t: t.startswith("5 citation"))
    cost = lambda c: F.when(read, F.coalesce(c, F.lit(0))).otherwise(0).alias(c)
    return a.select(F.lit(arm).alias("arm"), "instance_id", "answer", "abstained", "reason", "gate_detail", "appealed", "appeal_won", F.lit(False).alias("overflow"), F.lit("").alias("provider"), cost("prompt_chars"), cost("prompt_tokens"), cost("completion_tokens"), "round_trips", F.coalesce("latency_ms", F.lit(0.0)).alias("latency_ms")).select(COLUMNS)
