"""Queries that answer questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import vocab
from factloom.operators import answer
from factloom.plans import sql
from factloom.plans.facts import entities, questions, stored
from factloom.plans.graph import _CASCADE, _MEETS, _aliases
from factloom.plans.retrieval import _REL
from factloom.sources.tables import table

INVENTED = "deadbeefdeadbeef"


def replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies of a reader that cites the first and the last fact id of the instance, and an invented one where no answer is known."""
    ids = stored(spark, d).groupBy("instance_id").agg(F.min("fact_id").alias("lo"), F.max("fact_id").alias("hi"))
    r = table(spark, d, "instances").select("instance_id", "answer", "is_abstention").join(ids, "instance_id", "left")
    first = F.filter(F.array("lo", "hi", F.when(F.col("is_abstention"), F.lit(INVENTED))), lambda x: x.isNotNull())
    one = r.select("instance_id", F.lit(1).alias("attempt"), F.coalesce("answer", F.lit(answer.ABSTAIN)).alias("text"), first.alias("cited"))
    two = r.select("instance_id", F.lit(2).alias("attempt"), F.lit("As the facts say").alias("text"), F.filter(F.array("hi"), lambda x: x.isNotNull()).alias("cited"))
    return one.unionByName(two)


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return answer.answered(questions(spark, d), entities(spark, d), stored(spark, d), _aliases(spark, d), replies(spark, d))


def answer_rows(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).drop("trace", "window").withColumn("cited", F.array_join("cited", ","))


def answer_explained(spark: SparkSession, d: str) -> DataFrame:
    return answer.explained(_rows(spark, d), stored(spark, d), entities(spark, d))


def answer_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Provenance of what each reply cites of the stored facts."""
    from factloom.operators.retrieval import evidence

    r = replies(spark, d).where("attempt = 1").select(F.col("instance_id").alias("id"), "instance_id", "cited")
    return evidence(r, stored(spark, d))


def shown_facts(spark: SparkSession, d: str) -> DataFrame:
    f = answer.retrieved(questions(spark, d), stored(spark, d))
    return f.select("instance_id", "vid", "scoped", "shown")


def reader_requests(spark: SparkSession, d: str) -> DataFrame:
    return answer.requests(questions(spark, d), stored(spark, d), entities(spark, d)).select("id", "instance_id", "attempt", F.length("prompt").alias("chars"), F.sha2("prompt", 256).alias("key"))


QUERIES = {f.__name__: f for f in (answer_rows, answer_explained, answer_evidence, shown_facts, reader_requests)}

_SHOWN = f"""inw AS (SELECT f.*, w.w_start IS NOT NULL AS windowed, coalesce(w.w_start IS NOT NULL AND ({_MEETS}), false) AS meets FROM stored f JOIN ww w ON w.instance_id = f.instance_id),
sc AS (SELECT *, NOT bool_or(meets) OVER (PARTITION BY instance_id) OR meets AS scoped FROM inw),
nf AS (SELECT s.instance_id, vid, subject_key, predicate, {sql.slot()} AS slot, asserted_at, {_REL} AS score FROM sc s JOIN instances i ON i.instance_id = s.instance_id WHERE scoped),
ng AS (SELECT instance_id, subject_key, predicate, slot, max(score) AS score, count(*) AS n, min((asserted_at, vid)) AS o FROM nf GROUP BY 1, 2, 3, 4),
nr AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY instance_id ORDER BY score DESC, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY instance_id) AS total FROM ng),
nk AS (SELECT nf.vid FROM nf JOIN nr ON nr.instance_id = nf.instance_id AND nr.subject_key IS NOT DISTINCT FROM nf.subject_key AND nr.predicate IS NOT DISTINCT FROM nf.predicate AND nr.slot = nf.slot WHERE total <= {vocab.NARROW_CAP} OR before < {vocab.NARROW_CAP}),
sh AS (SELECT *, vid IN (SELECT vid FROM nk) AS shown FROM sc)"""
_REPLIES = f"""ids AS (SELECT instance_id, min(fact_id) AS lo, max(fact_id) AS hi FROM stored GROUP BY 1),
rep AS (SELECT i.instance_id, coalesce(answer, 'ABSTAIN') AS text, list_filter([lo, hi, CASE WHEN is_abstention THEN '{INVENTED}' END], lambda x: x IS NOT NULL) AS c0, list_filter([hi], lambda x: x IS NOT NULL) AS cited2 FROM instances i LEFT JOIN ids USING (instance_id)),
repl AS (SELECT instance_id, trim(text) AS text, list_filter(c0, lambda x, j: list_position(c0, x) = j) AS cited, cited2 FROM rep)"""
_ANSWER = f"""{_CASCADE}, {_SHOWN}, {_REPLIES},
per_i AS (SELECT instance_id, count(*) AS n_all, count(*) FILTER (scoped) AS n_scoped, count(*) FILTER (shown) AS n_shown, list(fact_id) FILTER (shown) AS s1, list(fact_id) FILTER (shown OR windowed) AS s2, bool_or(windowed) AS windowed, coalesce(bool_or(shown AND length(snippet) > 240), false) AS wide FROM sh GROUP BY 1),
b AS (SELECT c.*, coalesce(n_all, 0) AS n_all, n_shown, coalesce(windowed, false) AS windowed, coalesce(wide, false) AS wide, text, cited, cited2, list_filter(cited, lambda x: NOT list_contains(coalesce(s1, []), x)) AS bad1, list_filter(cited2, lambda x: NOT list_contains(coalesce(s2, []), x)) AS bad2,
 c.passed AND coalesce(n_all, 0) > 0 AS reached FROM cascade c JOIN repl USING (instance_id) LEFT JOIN per_i USING (instance_id)),
v AS (SELECT *, CASE WHEN starts_with(upper(text), 'ABSTAIN') THEN 'not_in_graph' WHEN len(bad1) > 0 THEN 'fabricated_citation' WHEN len(cited) = 0 THEN 'uncited_answer' ELSE '' END AS cr, len(bad2) = 0 AND len(cited2) > 0 AS ok2 FROM b),
a AS (SELECT *, reached AND cr = 'not_in_graph' AND n_shown > 0 AND (windowed OR wide) AS appealed FROM v), z AS (SELECT *, reached AND (cr = '' OR (appealed AND ok2)) AS said FROM a)"""

ORACLE = {
    "shown_facts": f"WITH RECURSIVE {_CASCADE}, {_SHOWN} SELECT instance_id, vid, scoped, shown FROM sh",
    "uncited_facts": f"WITH RECURSIVE {_CASCADE}, {_SHOWN}, {_REPLIES} SELECT sh.instance_id, fact_id FROM sh JOIN repl USING (instance_id) WHERE shown AND NOT list_contains(cited, fact_id)",
    "arm_rows": f"""WITH RECURSIVE {_ANSWER} SELECT 'full_context' AS arm, i.instance_id, trim(coalesce(answer, 'ABSTAIN')) AS answer, starts_with(upper(trim(coalesce(answer, 'ABSTAIN'))), 'ABSTAIN') AS abstained, '' AS reason, false AS appealed, false AS appeal_won, coalesce(length(question) > 40, false) AS overflow, 0 AS round_trips, length(question) AS prompt_tokens
 FROM instances i WHERE instance_id IN (SELECT instance_id FROM turns WHERE session_id IS NOT NULL) UNION ALL SELECT 'gated', z.instance_id, CASE WHEN NOT said THEN 'ABSTAIN' WHEN cr = '' THEN text ELSE 'As the facts say' END, NOT said, CASE WHEN said THEN '' WHEN NOT passed THEN reason WHEN NOT reached THEN 'empty_graph' ELSE cr END, appealed, appealed AND ok2, false, round_trips,
 CASE WHEN reached THEN coalesce(length(q.question), 0) ELSE 0 END FROM z JOIN instances q ON q.instance_id = z.instance_id""",
    "answer_rows": f"""WITH RECURSIVE {_ANSWER} SELECT instance_id, CASE WHEN NOT said THEN 'ABSTAIN' WHEN cr = '' THEN text ELSE 'As the facts say' END AS answer, NOT said AS abstained, CASE WHEN said THEN '' WHEN NOT passed THEN reason WHEN NOT reached THEN 'empty_graph' ELSE cr END AS reason,
 CASE WHEN said THEN '' WHEN NOT passed THEN reason || CASE WHEN missing <> '' THEN ': ' || missing ELSE '' END WHEN reached AND cr = 'fabricated_citation' THEN cr || ': ' || array_to_string(bad1, ', ') ELSE '' END AS gate_detail,
 CASE WHEN NOT reached THEN 0 WHEN appealed AND ok2 THEN CASE WHEN windowed THEN n_all ELSE n_shown END ELSE n_shown END AS fact_count, round_trips, appealed, appealed AND ok2 AS appeal_won, CASE WHEN NOT said THEN '' WHEN cr = '' THEN array_to_string(cited, ',') ELSE array_to_string(cited2, ',') END AS cited FROM z""",
    "answer_evidence": f"""WITH {sql.STORED}, {_REPLIES}, x AS (SELECT instance_id, unnest(cited) AS fact_id, (generate_subscripts(cited, 1) - 1)::INT AS pos FROM repl), pr AS (SELECT instance_id, fact_id, lag(fact_id) OVER (PARTITION BY instance_id, subject_key, predicate, slot ORDER BY asserted_at, coalesce(turn_idx, 0), vid) AS replaced FROM (SELECT *, {sql.slot()} AS slot FROM stored WHERE subject_key IS NOT NULL)),
 p AS (SELECT instance_id, fact_id, min(replaced) AS replaced FROM pr GROUP BY 1, 2)
 SELECT x.instance_id AS id, pos, x.fact_id, predicate, coalesce(value_text, '') AS value, session_id, turn_idx, CASE WHEN coalesce(role, '') = '' THEN 'unknown' ELSE role END AS role, coalesce(valid_from, 0) AS valid_from, coalesce(valid_to, 0) AS valid_to, coalesce(replaced, '') AS supersedes
 FROM x JOIN stored s ON s.instance_id = x.instance_id AND s.fact_id = x.fact_id LEFT JOIN p ON p.instance_id = x.instance_id AND p.fact_id = x.fact_id""",
}
