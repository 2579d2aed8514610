"""Queries of scores and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import vocab
from factloom.operators import evaluation as ev
from factloom.operators import graph
from factloom.operators.merge import last_wins
from factloom.plans import sql
from factloom.plans.graph import CLEAN
from factloom.plans.retrieval import _FLAT, _TEXT
from factloom.session import written
from factloom.sources.tables import table


def eval_rows(spark: SparkSession, d: str) -> DataFrame:
    return ev.scored(table(spark, d, "results"), table(spark, d, "instances"))


def _once(spark: SparkSession, d: str) -> DataFrame:
    return written(eval_rows(spark, d), "scored")  # several summaries read it


def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    return ev.summary(_once(spark, d))


def abstention_reasons(spark: SparkSession, d: str) -> DataFrame:
    return ev.reasons(_once(spark, d))


def cost_query(spark: SparkSession, d: str) -> DataFrame:
    return ev.query_cost(_once(spark, d))


def go_no_go(spark: SparkSession, d: str) -> DataFrame:
    return ev.go_no_go(ev.summary(_once(spark, d)))


def ledger(spark: SparkSession, d: str) -> DataFrame:
    """One row per instance ingested: what was written, from the tables themselves."""
    f = table(spark, d, "facts").groupBy("instance_id").agg(F.count("*").alias("facts"), F.sum(F.coalesce(F.length("snippet"), F.lit(0))).alias("prompt_tokens"), F.sum(F.coalesce(F.length("value_text"), F.lit(0))).alias("completion_tokens"))
    s = table(spark, d, "sessions").groupBy("instance_id").agg(F.count("*").alias("sessions"), F.count_if(F.col("ts_text").isNull()).alias("parse_failures"))
    return f.join(s, "instance_id").select("instance_id", "facts", "sessions", "prompt_tokens", "completion_tokens", "parse_failures", F.floor(F.col("facts") / 500 + 1).alias("round_trips"), (F.col("facts") * 3).alias("latency_ms"))


def cost_ingest(spark: SparkSession, d: str) -> DataFrame:
    return ev.ingest_cost(ledger(spark, d))


def strata_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "instances").groupBy("question_type", "is_abstention").agg(F.count("*").alias("n"))


def stratified_slice(spark: SparkSession, d: str) -> DataFrame:
    return ev.stratified(table(spark, d, "instances"))


def sample_instances(spark: SparkSession, d: str) -> DataFrame:
    return ev.spread_sample(table(spark, d, "instances"), 20)


def dedupe_last_wins(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "results").select("arm", "instance_id", "answer", "delivery_id", "batch_no")
    return last_wins(r, ["arm", "instance_id"], F.struct("batch_no", "delivery_id")).select("arm", "instance_id", "delivery_id")


def extraction_quality(spark: SparkSession, d: str) -> DataFrame:
    e, turns = table(spark, d, "extracted_facts"), table(spark, d, "turns")
    n = graph.turn_counts(turns)
    return ev.quality(e, graph.cleaned(e, n), turns, n, table(spark, d, "sessions"))


def top_predicates(spark: SparkSession, d: str) -> DataFrame:
    """The twelve most frequent predicates after cleaning (a top-k report)."""
    c = graph.cleaned(table(spark, d, "extracted_facts"), graph.turn_counts(table(spark, d, "turns")))
    return c.groupBy("predicate").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "predicate").limit(12)


def top_subjects(spark: SparkSession, d: str) -> DataFrame:
    """The eight most frequent subjects after cleaning, ties by first extraction (a top-k report)."""
    from factloom.functions.text import entity_key

    c = graph.cleaned(table(spark, d, "extracted_facts"), graph.turn_counts(table(spark, d, "turns"))).withColumn("subject", entity_key("subject_type", "subject"))
    return c.groupBy("subject").agg(F.count("*").alias("n"), F.min("extract_id").alias("_first")).orderBy(F.desc("n"), "_first").limit(8).drop("_first")


def top_off_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """The fifteen most frequent predicates outside the vocabulary, ties by first extraction (a top-k report)."""
    e = table(spark, d, "extracted_facts").where(F.col("predicate").isNotNull() & ~F.col("predicate").isin(vocab.PREDICATES))
    return e.groupBy("predicate").agg(F.count("*").alias("n"), F.min("extract_id").alias("_first")).orderBy(F.desc("n"), "_first").limit(15).drop("_first")


def gated_summary(spark: SparkSession, d: str) -> DataFrame:
    """The summary of the arm that answers through the cascade, run over the tables: appeals and appeals won are its own."""
    from factloom.plans.answer import answer_rows

    a = answer_rows(spark, d).select(F.lit("run").alias("run_id"), F.lit("gated").alias("arm"), "instance_id", "answer", "abstained", "reason", "fact_count", "round_trips", F.lit(0.0).alias("latency_ms"), F.lit(0).alias("received_at"), F.lit(0).alias("delivery_id"), "appealed", "appeal_won", F.lit(False).alias("overflow"))
    return ev.summary(written(ev.scored(a, table(spark, d, "instances")), "scored")).drop("median_latency_ms")


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "results").select("arm", "latency_ms")
    return ev.ranked(r, ["arm"], "latency_ms", {"p50": ev.nearest_index(0.5), "p95": ev.nearest_index(0.95), "p99": ev.nearest_index(0.99)})


def arms_union(spark: SparkSession, d: str) -> DataFrame:
    """How many rows each arm has, and how many of its reasons are not registered."""
    r = table(spark, d, "results").select("arm", F.coalesce("reason", F.lit("")).alias("reason"))
    known = spark.createDataFrame([(x,) for x in [*vocab.REASONS, ""]], "reason string")
    other = r.join(F.broadcast(known), "reason", "left_anti").groupBy("arm").agg(F.countDistinct("reason").alias("unregistered"))  # nine fixed reasons
    return r.groupBy("arm").agg(F.count("*").alias("n")).join(other, "arm", "left").select("arm", "n", F.coalesce("unregistered", F.lit(0)).alias("unregistered"))


def arm_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows of two arms over the tables, put together: all sessions in one prompt, and the cascade. Their reader says what is asked for."""
    from factloom.operators import answer, arms
    from factloom.plans import answer as plans
    from factloom.plans.facts import entities, questions, stored

    i = table(spark, d, "instances").select("instance_id", F.coalesce("answer", F.lit("ABSTAIN")).alias("text"), F.length("question").cast("bigint").alias("prompt_tokens"), F.lit(1).cast("bigint").alias("completion_tokens"), F.lit(1.0).alias("latency_ms"))
    replies = i.withColumn("arm", F.explode(F.array(F.lit("full_context"), F.lit("gated"))))
    full = arms.full_context(table(spark, d, "turns"), replies, ceiling=40)
    asked = answer.requests(questions(spark, d), stored(spark, d), entities(spark, d))
    gated = arms.gated(plans._rows(spark, d), asked, replies)
    return full.unionByName(gated).select("arm", "instance_id", "answer", "abstained", "reason", "appealed", "appeal_won", "overflow", "round_trips", "prompt_tokens")


QUERIES = {f.__name__: f for f in (eval_rows, eval_summary, abstention_reasons, cost_query, cost_ingest, go_no_go, strata_counts, stratified_slice, sample_instances, dedupe_last_wins, extraction_quality, top_predicates, top_subjects, top_off_vocabulary, gated_summary, latency_percentiles, arms_union, arm_rows)}

_R = lambda a, b: f"CASE WHEN {b} > 0 THEN round_even(({a})::DOUBLE / ({b}), 4) END"
SUMMARY = f"""{sql.SCORED}, s AS (SELECT arm, category, count(*) AS n, count(*) FILTER (gold_abstention) AS g, count(*) FILTER (correct) AS ok, count(*) FILTER (correct AND NOT gold_abstention) AS oka, count(*) FILTER (NOT gold_abstention) AS an, count(*) FILTER (NOT abstained) AS said,
 count(*) FILTER (correct AND NOT abstained) AS oks, count(*) FILTER (abstained AND gold_abstention) AS ta, count(*) FILTER (abstained) AS ab, sum(prompt_tokens + completion_tokens)::BIGINT AS tok, sum(round_trips)::BIGINT AS tr, list_sort(list(latency_ms) FILTER (latency_ms IS NOT NULL)) AS l, count(*) FILTER (appealed) AS ap, count(*) FILTER (appeal_won) AS aw, count(*) FILTER (overflow) AS ov FROM wide GROUP BY 1, 2),
sm AS (SELECT arm, category, n, g AS n_gold_abstention, {_R('ok', 'n')} AS accuracy, {_R('oka', 'an')} AS answerable_accuracy, {_R('said', 'n')} AS coverage, {_R('oks', 'said')} AS selective_accuracy, {_R('ta', 'ab')} AS abstain_precision, {_R('ta', 'g')} AS abstain_recall,
 round_even(tok::DOUBLE / n, 0)::BIGINT AS tokens_per_q, round_even(tr::DOUBLE / n, 2) AS round_trips_per_q, l[len(l) // 2 + 1] AS median_latency_ms, ap AS appeals, aw AS appeals_won, ov AS overflow FROM s)"""
_KNOWN = ", ".join(f"('{r}')" for r in vocab.REASONS)
_UNG = sql.strings(vocab.UNGATED_ARMS)
_COST = {
    "questions": "n", "prompt_tokens_per_question": "round_even(p::DOUBLE / n, 0)", "completion_tokens_per_question": "round_even(c::DOUBLE / n, 0)", "tokens_per_question": "round_even((p + c)::DOUBLE / n, 0)", "median_latency": "round_even((l[(n - 1) // 2 + 1] + l[n // 2 + 1]) / 2, 0)",
    "p95_latency": "round_even(l[least(n - 1, floor(n * 0.95)::BIGINT) + 1], 0)", "round_trips_per_question": "round_even(t::DOUBLE / n, 2)",
}
_LEDGER = """lf AS (SELECT instance_id, count(*) AS facts, sum(coalesce(length(snippet), 0)) AS p, sum(coalesce(length(value_text), 0)) AS c FROM facts GROUP BY 1), ls AS (SELECT instance_id, count(*) AS sessions, count(*) FILTER (ts_text IS NULL) AS pf FROM sessions GROUP BY 1),
 lg AS (SELECT count(*)::DOUBLE AS i, greatest(sum(facts), 1)::DOUBLE AS f, greatest(sum(sessions), 1)::DOUBLE AS s, sum(p + c)::DOUBLE AS t, sum(facts // 500 + 1)::DOUBLE AS r, sum(facts * 3)::DOUBLE AS l, sum(pf)::DOUBLE AS pf FROM lf JOIN ls USING (instance_id))"""
_ING = {"instances_ingested": "i", "sessions_ingested": "s", "facts_written": "f", "facts_per_session": "round_even(f / s, 2)", "extraction_tokens_per_fact": "round_even(t / f, 0)", "round_trips_per_fact": "round_even(r / f, 3)", "latency_per_fact": "round_even(l / f, 1)", "parse_failures": "pf"}
_SHARE = lambda c: f"CASE WHEN kept > 0 THEN round_even({c}::DOUBLE / kept, 4) ELSE 0.0 END"
_VALID = "CASE WHEN ses > 0 THEN round_even(par::DOUBLE / ses, 4) ELSE 0.0 END"
_QUAL = {"sessions": "ses", "parsed": "par", "valid_share": _VALID, "validity_passes": f"CASE WHEN {_VALID} >= 0.95 THEN 1 ELSE 0 END", "go": f"CASE WHEN {_VALID} >= 0.95 AND {_SHARE('g')} >= 0.9 AND {_SHARE('o')} <= 0.35 THEN 1 ELSE 0 END", "raw_facts": "raw", "off_vocabulary": "off", "bad_turn": "bad", "kept_facts": "kept", "grounded": "g", "no_span": "ns", "invented_span": "inv", "other": "o", "grounded_share": _SHARE("g"), "other_share": _SHARE("o"), "grounding_passes": f"CASE WHEN {_SHARE('g')} >= 0.9 THEN 1 ELSE 0 END", "other_passes": f"CASE WHEN {_SHARE('o')} <= 0.35 THEN 1 ELSE 0 END"}
_SPAN = f"trim({_FLAT('evidence_span')})"

ORACLE = {
    "eval_rows": f"WITH {sql.SCORED} SELECT * FROM scored",
    "eval_summary": f"WITH {SUMMARY} SELECT * FROM sm",
    "abstention_reasons": f"""WITH {sql.SCORED}, per AS (SELECT arm, category, count(*) AS n, count(*) FILTER (abstained) AS n_abstained FROM wide GROUP BY 1, 2), hit AS (SELECT arm, category, reason, count(*) AS c, count(*) FILTER (NOT gold_abstention) AS f FROM wide WHERE abstained GROUP BY 1, 2, 3),
 k(reason) AS (VALUES {_KNOWN}), grid AS (SELECT arm, category, reason FROM per, k WHERE arm NOT IN ({_UNG}) UNION SELECT arm, category, reason FROM hit WHERE arm NOT IN ({_UNG}))
 SELECT grid.arm, grid.category, n, n_abstained, grid.reason, coalesce(c, 0) AS count, coalesce(f, 0) AS count_false FROM grid JOIN per USING (arm, category) LEFT JOIN hit USING (arm, category, reason)
 UNION ALL SELECT per.arm, per.category, n, n_abstained, '(no gates)', coalesce(c, 0), coalesce(f, 0) FROM per LEFT JOIN hit ON hit.arm = per.arm AND hit.category = per.category AND hit.reason = '' WHERE per.arm IN ({_UNG})""",
    "cost_query": f"WITH {sql.SCORED}, a AS (SELECT arm, count(*) AS n, sum(prompt_tokens) AS p, sum(completion_tokens) AS c, sum(round_trips) AS t, list_sort(list(latency_ms)) AS l FROM scored GROUP BY 1) " + " UNION ALL ".join(f"SELECT arm, '{m}' AS metric, ({e})::DOUBLE AS value FROM a" for m, e in _COST.items()) + " UNION ALL SELECT arm, 'questions_costing_' || round_trips || '_round_trips', count(*)::DOUBLE FROM scored GROUP BY arm, round_trips",
    "cost_ingest": f"WITH {_LEDGER} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, ({e})::DOUBLE AS value FROM lg" for m, e in _ING.items()),
    "go_no_go": f"""WITH {SUMMARY}, p AS (SELECT arm, coalesce(max(abstain_recall) FILTER (category = 'ALL'), 0) AS r, coalesce(max(abstain_precision) FILTER (category = 'ALL'), 0) AS p, coalesce(max(accuracy) FILTER (category = 'knowledge-update'), 0) AS u FROM sm GROUP BY 1)
 SELECT x.arm, (x.r > b.r)::INT + (x.p > b.p)::INT + (x.u > b.u)::INT AS won, CASE WHEN (x.r > b.r)::INT + (x.p > b.p)::INT + (x.u > b.u)::INT >= 2 THEN 'GO' ELSE 'NO-GO' END AS verdict FROM p x, p b WHERE b.arm = 'full_context' AND x.arm NOT IN ({_UNG})""",
    "strata_counts": "SELECT question_type, is_abstention, count(*) AS n FROM instances GROUP BY 1, 2",
    "stratified_slice": "SELECT instance_id, question_type, is_abstention FROM instances WHERE instance_id IS NOT NULL QUALIFY is_abstention OR row_number() OVER (PARTITION BY question_type, is_abstention ORDER BY sha256('11|' || instance_id), instance_id) <= 20",
    "sample_instances": "WITH x AS (SELECT instance_id, row_number() OVER (ORDER BY instance_id) - 1 AS pos, count(*) OVER () AS n FROM instances WHERE instance_id IS NOT NULL) SELECT instance_id, pos FROM x WHERE pos % greatest(1, n // 20) = 0 AND pos // greatest(1, n // 20) < 20",
    "dedupe_last_wins": "SELECT arm, instance_id, delivery_id FROM results QUALIFY row_number() OVER (PARTITION BY arm, instance_id ORDER BY batch_no DESC, delivery_id DESC) = 1",
    "extraction_quality": f"""WITH {CLEAN}, {_TEXT}, a AS (SELECT count(*) AS raw, count(*) FILTER (coalesce(predicate NOT IN ({sql.strings(vocab.PREDICATES)}), true)) AS off, count(*) FILTER (coalesce(try_cast(regexp_replace(turn_ref, '[^0-9]', '', 'g') AS INT), 0) >= coalesce(n_turns, 0)) AS bad FROM extracted_facts LEFT JOIN nt USING (session_id)),
 b AS (SELECT predicate, trim(evidence_span) = '' AS blank, {_SPAN} <> '' AND contains({_FLAT("coalesce(text, '')")}, {_SPAN}) AS gr FROM clean LEFT JOIN tr USING (session_id)),
 ss AS (SELECT count(DISTINCT key) AS ses, count(DISTINCT key) FILTER (key IN (SELECT session_id FROM extracted_facts)) AS par FROM sessions), q AS (SELECT a.*, k.*, ss.* FROM a, ss, (SELECT count(*) AS kept, count(*) FILTER (gr) AS g, count(*) FILTER (NOT gr AND blank) AS ns, count(*) FILTER (NOT gr AND NOT blank) AS inv, count(*) FILTER (predicate = 'other') AS o FROM b) k) """ + " UNION ALL ".join(f"SELECT '{m}' AS metric, ({e})::DOUBLE AS value FROM q" for m, e in _QUAL.items()),
    "top_predicates": f"WITH {CLEAN} SELECT predicate, count(*) AS n FROM clean GROUP BY 1 ORDER BY n DESC, predicate LIMIT 12",
    "top_subjects": f"WITH {CLEAN} SELECT subject, n FROM (SELECT {sql.entity_key('subject_type', 'subject')} AS subject, count(*) AS n, min(extract_id) AS f FROM clean GROUP BY 1) ORDER BY n DESC, f LIMIT 8",
    "top_off_vocabulary": f"SELECT predicate, n FROM (SELECT predicate, count(*) AS n, min(extract_id) AS f FROM extracted_facts WHERE predicate NOT IN ({sql.strings(vocab.PREDICATES)}) GROUP BY 1) ORDER BY n DESC, f LIMIT 15",
    "latency_percentiles": "WITH a AS (SELECT arm, count(*) AS n, list_sort(list(latency_ms)) AS l FROM results WHERE latency_ms IS NOT NULL GROUP BY 1) SELECT arm, " + ", ".join(f"l[least(n - 1, floor(n * {f})::BIGINT) + 1] AS p{p}" for p, f in ((50, 0.5), (95, 0.95), (99, 0.99))) + " FROM a",
    "arms_union": f"SELECT arm, count(*) AS n, count(DISTINCT reason) FILTER (coalesce(reason, '') NOT IN ({sql.strings([*vocab.REASONS, ''])})) AS unregistered FROM results GROUP BY 1",
}
