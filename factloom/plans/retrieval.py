"""Queries of what a reader gets to see."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import vocab
from factloom.operators import graph, retrieval
from factloom.plans import sql
from factloom.plans.facts import entities, questions, stored
from factloom.plans.graph import CITE, CLEAN
from factloom.sources.tables import table


def session_transcript(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.transcripts(table(spark, d, "turns"))


def turn_chunks(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.chunks(table(spark, d, "turns"), table(spark, d, "sessions"))


def _named(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d).join(entities(spark, d).select(F.col("vid").alias("subject_vid"), F.col("name").alias("subject_name")), "subject_vid", "left")


def fact_lines(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).select("vid", retrieval.fact_line(vocab.MAX_SPAN).alias("line"))


def fact_relevance(spark: SparkSession, d: str) -> DataFrame:
    f = stored(spark, d, "instance_id", "predicate", "value_text", "snippet").join(questions(spark, d).select("instance_id", "question"), "instance_id")
    return f.select("vid", retrieval.relevance(F.coalesce("question", F.lit(""))).alias("score"))


def narrow_groups(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.narrowed(questions(spark, d), stored(spark, d, "instance_id", "subject_key", "predicate", "value_text", "snippet", "asserted_at"))


def grounding(spark: SparkSession, d: str) -> DataFrame:
    c = graph.cleaned(table(spark, d, "extracted_facts"), graph.turn_counts(table(spark, d, "turns")))
    return retrieval.grounded_rows(c, table(spark, d, "turns")).select("extract_id", "grounded")


def turn_tokens(spark: SparkSession, d: str) -> DataFrame:
    """How many tokens each turn has."""
    from factloom.functions.tokens import token_counts

    return token_counts(table(spark, d, "turns"), "turn_id", "content")


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 20 = 0 and embedding is not null").select("vec_id", "embedding")  # the stated query set
    return retrieval.nearest(q, v).select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def retrieved_minus_cited(spark: SparkSession, d: str) -> DataFrame:
    """For each answer, how many stored facts of its instance it did not cite."""
    from factloom.operators.gates import cited_ids

    f = stored(spark, d).select("instance_id", "fact_id").distinct()
    n = f.groupBy("instance_id").agg(F.count("*").alias("n"))
    a = table(spark, d, "results").select(F.col("delivery_id").alias("id"), F.lower(F.trim("instance_id")).alias("instance_id"), F.explode_outer(cited_ids(F.col("cited_fact_ids"))).alias("fact_id"))
    c = a.join(f.withColumn("hit", F.lit(1)), ["instance_id", "fact_id"], "left").groupBy("id", "instance_id").agg(F.count("hit").alias("cited"))
    return c.join(n, "instance_id").select("id", (F.col("n") - F.col("cited")).alias("uncited"))


def uncited_facts(spark: SparkSession, d: str) -> DataFrame:
    """The facts that a reader was shown and did not cite, by question."""
    from factloom.operators.answer import retrieved
    from factloom.operators.gates import cited_ids
    from factloom.plans.answer import replies

    f = retrieved(questions(spark, d), stored(spark, d)).where("shown").select("instance_id", "fact_id")
    cited = replies(spark, d).where("attempt = 1").select("instance_id", F.explode(cited_ids(F.col("cited"))).alias("fact_id"))
    return f.join(cited, ["instance_id", "fact_id"], "left_anti")


def vector_topk_index(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vectors by way of the cell index: exact scores over the cells probed."""
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 20 = 0 and embedding is not null").select("vec_id", "embedding")  # the stated query set
    return retrieval.nearest_by_cells(q, v).select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


QUERIES = {f.__name__: f for f in (session_transcript, turn_chunks, fact_lines, fact_relevance, narrow_groups, grounding, turn_tokens, vector_topk, vector_topk_index, retrieved_minus_cited, uncited_facts)}

_LINE = "'[' || idx || '] ' || coalesce(role, '') || ': ' || coalesce(content, '')"
_TEXT = f"tr AS (SELECT session_id, string_agg({_LINE}, chr(10) ORDER BY idx, turn_id) AS text FROM turns WHERE session_id IS NOT NULL GROUP BY 1)"
_DAY = lambda c: f"strftime(to_timestamp({c}) AT TIME ZONE 'UTC', '%Y-%m-%d')"
_REL = f"len(list_intersect(list_distinct({sql.words("coalesce(question, '')")}), list_distinct({sql.words("predicate || ' ' || coalesce(value_text, '') || ' ' || coalesce(snippet, '')")})))"
_G = f"""{sql.STORED}, f AS (SELECT s.instance_id, vid, subject_key, predicate, {sql.slot()} AS slot, asserted_at, {_REL} AS score FROM stored s JOIN instances i ON i.instance_id = s.instance_id),
g AS (SELECT instance_id, subject_key, predicate, slot, max(score) AS score, count(*) AS n, min((asserted_at, vid)) AS o FROM f GROUP BY 1, 2, 3, 4),
r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY instance_id ORDER BY score DESC, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY instance_id) AS total FROM g)"""
_FLAT = lambda c: f"lower(regexp_replace({c}, '\\s+', ' ', 'g'))"

ORACLE = {
    "session_transcript": f"WITH {_TEXT} SELECT * FROM tr",
    "turn_chunks": f"SELECT turn_id, '[' || {_DAY('floor(epoch(s.received_at))')} || '] session ' || s.idx || ', turn ' || t.idx || ' (' || coalesce(role, '') || '): ' || coalesce(content, '') AS chunk FROM turns t JOIN sessions s ON s.key = t.session_id",
    "fact_lines": f"""WITH {sql.STORED} SELECT s.vid, fact_id || ' | ' || {_DAY('coalesce(valid_from, 0)')} || ' | ' || coalesce(e.name, '') || ' | ' || predicate || ' | ' || coalesce(value_text, '') || ' | "' || substr(coalesce(snippet, ''), 1, 240) || '"' || CASE WHEN coalesce(valid_to, 0) <> 0 THEN ' [superseded ' || {_DAY('valid_to')} || ']' ELSE '' END AS line
 FROM stored s LEFT JOIN entities e ON e.vid = s.subject_vid""",
    "fact_relevance": f"WITH {sql.STORED} SELECT vid, ({_REL})::INT AS score FROM stored s JOIN instances i ON i.instance_id = s.instance_id",
    "narrow_groups": f"WITH {_G} SELECT f.instance_id, f.vid FROM f JOIN r ON r.instance_id = f.instance_id AND r.subject_key IS NOT DISTINCT FROM f.subject_key AND r.predicate IS NOT DISTINCT FROM f.predicate AND r.slot = f.slot WHERE total <= {vocab.NARROW_CAP} OR before < {vocab.NARROW_CAP}",
    "grounding": f"WITH {CLEAN}, {_TEXT} SELECT extract_id, trim({_FLAT('evidence_span')}) <> '' AND contains({_FLAT("coalesce(text, '')")}, trim({_FLAT('evidence_span')})) AS grounded FROM clean LEFT JOIN tr USING (session_id)",
    "vector_topk": """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)
 SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""",
    "retrieved_minus_cited": f"""WITH {CITE}, ff AS (SELECT DISTINCT instance_id, fact_id FROM stored), n AS (SELECT instance_id, count(*) AS n FROM ff GROUP BY 1), c AS (SELECT id, cit.instance_id, len(list_filter(cited, lambda y: list_contains(ids, y))) AS k FROM cit LEFT JOIN (SELECT instance_id, list(fact_id) AS ids FROM ff GROUP BY 1) l ON l.instance_id = cit.instance_id)
 SELECT id, n - coalesce(k, 0) AS uncited FROM c JOIN n ON n.instance_id = c.instance_id""",
}
