"""Queries over stored facts: reads, chains, windows, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import vocab
from factloom.functions.ids import entity_id, idempotency_key
from factloom.functions.text import entity_key, normalized, question_predicates
from factloom.functions.windows import at_time, overlaps, window_label, with_window
from factloom.operators import chain, merge
from factloom.plans import sql
from factloom.sources.tables import table

FACT = ["instance_id", "fact_id", "subject_vid", "subject_key", "predicate", "value_text", "value_type", "valid_from", "valid_to", "asserted_at", "session_id", "turn_idx", "role", "snippet", "confidence", "status", "log_id"]


def stored(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """The fact log as a store: one row per fact, revisions guarded by asserted_at; with vid only the columns named, all if none is.

    What a query doesn't name is neither read from the log nor carried through the merge.
    """
    names = list(dict.fromkeys(["vid", *(cols or FACT)]))
    rows = table(spark, d, "facts").select(*names, F.col("asserted_at").alias("_guard"), F.col("log_id").alias("_at"))
    return merge.guarded_merge(rows, ["vid"], F.col("_guard"), F.col("_at")).select(*names)


def entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities")


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "instances").select("instance_id", "question", "asked_at")


def det_ids(spark: SparkSession, d: str) -> DataFrame:
    e = entities(spark, d)
    return e.select("vid", entity_id("instance_id", "key").alias("entity_id"), idempotency_key("instance_id", "key", "name").alias("content_key"))


def normalize_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extracted_facts").select("extract_id", normalized(F.coalesce("subject", F.lit(""))).alias("norm"), entity_key(F.coalesce("subject_type", F.lit("thing")), F.coalesce("subject", F.lit(""))).alias("entity_key"))


def facts_of_subject(spark: SparkSession, d: str) -> DataFrame:
    e = entities(spark, d).select(F.col("vid").alias("subject_vid"), F.col("name").alias("subject_name"))
    return stored(spark, d, "fact_id", "instance_id", "subject_vid", "subject_key", "predicate", "value_text", "asserted_at").join(e, "subject_vid").select("vid", "fact_id", "instance_id", "subject_key", "subject_name", "predicate", "value_text", "asserted_at")


def edge_counts(spark: SparkSession, d: str) -> DataFrame:
    f, e = stored(spark, d, "instance_id", "subject_vid", "predicate", "value_text", "valid_from", "asserted_at", "turn_idx"), entities(spark, d)
    subject = f.join(e.select(F.col("vid").alias("subject_vid")), "subject_vid", "left_semi").groupBy("instance_id").agg(F.count("*").alias("n"))
    parts = [f.groupBy("instance_id").agg(F.count("*").alias("n")).withColumn("what", F.lit("facts")), e.groupBy("instance_id").agg(F.count("*").alias("n")).withColumn("what", F.lit("entities")), subject.withColumn("what", F.lit("subject_edges")), chain.pairs(f).groupBy("instance_id").agg(F.count("*").alias("n")).withColumn("what", F.lit("supersedes_edges"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("instance_id", "what", "n")


def supersession_facts(spark: SparkSession, d: str) -> DataFrame:
    return chain.superseded(stored(spark, d, "instance_id", "subject_vid", "predicate", "value_text", "valid_from", "asserted_at", "turn_idx")).select("vid", "slot", "superseded_by", "status", "valid_to")


def supersession_pairs(spark: SparkSession, d: str) -> DataFrame:
    return chain.pairs(stored(spark, d, "instance_id", "subject_vid", "predicate", "value_text", "valid_from", "asserted_at", "turn_idx"))


def current_facts(spark: SparkSession, d: str) -> DataFrame:
    return chain.current(chain.superseded(stored(spark, d, "subject_key", "instance_id", "subject_vid", "predicate", "value_text", "valid_from", "asserted_at", "turn_idx"))).select("vid", "instance_id", "subject_key", "predicate", "value_text")


def predecessors(spark: SparkSession, d: str) -> DataFrame:
    return chain.predecessors(stored(spark, d, "instance_id", "subject_key", "predicate", "value_text", "valid_from", "asserted_at", "turn_idx", "fact_id")).select("vid", "fact_id", "replaced")


def change_history(spark: SparkSession, d: str) -> DataFrame:
    return chain.change_history(stored(spark, d, "instance_id", "subject_key", "predicate", "value_text", "valid_from", "asserted_at", "turn_idx", "fact_id"))


def since_current(spark: SparkSession, d: str) -> DataFrame:
    return chain.since_current(stored(spark, d, "instance_id", "subject_key", "predicate", "value_text", "valid_from", "asserted_at", "turn_idx", "fact_id"))


def window_bounds(spark: SparkSession, d: str) -> DataFrame:
    w = with_window(questions(spark, d))
    return w.select("instance_id", "w_start", "w_end", "w_phrase", F.when(F.col("w_start").isNotNull(), window_label()).alias("label"))


def facts_in_window(spark: SparkSession, d: str) -> DataFrame:
    q = with_window(questions(spark, d)).where("w_start is not null").select("instance_id", "w_start", "w_end")
    f = chain.superseded(stored(spark, d, "instance_id", "subject_vid", "predicate", "value_text", "valid_from", "asserted_at", "turn_idx")).select("vid", "instance_id", "valid_from", "valid_to")
    return f.join(q, "instance_id").where(overlaps(F.col("valid_from"), F.col("valid_to"), F.col("w_start"), F.col("w_end"))).select("instance_id", "vid")


def value_at_time(spark: SparkSession, d: str) -> DataFrame:
    q = questions(spark, d).where("asked_at is not null").select("instance_id", "asked_at")
    f = chain.superseded(stored(spark, d, "subject_key", "instance_id", "subject_vid", "predicate", "value_text", "valid_from", "asserted_at", "turn_idx")).select("vid", "instance_id", "subject_key", "predicate", "value_text", "valid_from", "valid_to")
    return f.join(q, "instance_id").where(at_time(F.col("valid_from"), F.col("valid_to"), F.col("asked_at"))).select("instance_id", "vid", "subject_key", "predicate", "value_text")


def guarded_merge(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d, "value_text", "status", "valid_to", "asserted_at", "log_id")


def close_facts(spark: SparkSession, d: str) -> DataFrame:
    """Closings as a merge guarded by valid_to: an end only ever grows."""
    f = chain.superseded(stored(spark, d, "instance_id", "subject_vid", "predicate", "value_text", "valid_from", "asserted_at", "turn_idx")).select("vid", "valid_to", "status", F.lit(1).alias("at"))
    log = table(spark, d, "facts").select("vid", F.coalesce("valid_to", F.lit(0)).alias("valid_to"), "status", (F.col("log_id") + 1).alias("at"))
    return merge.guarded_merge(f.unionByName(log), ["vid"], F.col("valid_to"), F.col("at")).select("vid", "valid_to", "status")


def guarded_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities touched again by each fact: last_seen guarded, first_seen kept from the first arrival."""
    e = entities(spark, d).select("vid", "name", "first_seen", "last_seen", F.lit(0).cast("bigint").alias("arrival"))
    again = stored(spark, d, "subject_vid", "subject_key", "turn_idx", "log_id").select(F.col("subject_vid").alias("vid"), F.col("subject_key").alias("name"), F.col("turn_idx").alias("first_seen"), F.col("turn_idx").alias("last_seen"), "log_id").select("vid", "name", "first_seen", "last_seen", F.col("log_id").alias("arrival"))
    return merge.guarded_merge(e.unionByName(again), ["vid"], F.col("last_seen"), F.col("arrival"), ("first_seen",)).select("vid", "name", "first_seen", "last_seen")


def edge_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Facts whose subject, session or object is not stored."""
    f = stored(spark, d, "instance_id", "subject_vid", "session_id", "predicate", "value_text", "value_type")
    e = entities(spark, d)
    no_subject = merge.dangling(f.select("vid", "subject_vid"), e, "subject_vid").select("vid", F.lit("subject").alias("missing"))
    no_session = merge.dangling(f.select("vid", "session_id"), table(spark, d, "sessions"), "session_id", "key").select("vid", F.lit("session").alias("missing"))
    object_types = F.create_map(*[F.lit(x) for kv in vocab.OBJECT_TYPES.items() for x in kv])
    o = f.where("value_type = 'entity' and value_text is not null and instance_id is not null").withColumn("_t", F.coalesce(F.try_element_at(object_types, F.col("predicate")), F.lit("thing")))
    o = o.select("vid", "instance_id", entity_key("_t", "value_text").alias("key"))
    no_object = o.join(e.select("instance_id", "key"), ["instance_id", "key"], "left_anti").select("vid", F.lit("object").alias("missing"))
    return no_subject.unionByName(no_session).unionByName(no_object)


def asked_predicates(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("instance_id", F.array_join(question_predicates(F.coalesce("question", F.lit(""))), ",").alias("wanted"))


def memory_get_all(spark: SparkSession, d: str) -> DataFrame:
    f = stored(spark, d, "instance_id", "fact_id", "predicate", "value_text", "valid_from", "status")
    return chain.current(f, missing_is_current=False).select("instance_id", "vid", "fact_id", "predicate", "value_text", "valid_from")


def memory_history(spark: SparkSession, d: str) -> DataFrame:
    """Each replaced fact with the one that replaced it."""
    f = stored(spark, d, "fact_id", "instance_id", "subject_vid", "predicate", "value_text", "valid_from", "asserted_at", "turn_idx")
    p = chain.pairs(f).select(F.col("src").alias("new_vid"), F.col("dst").alias("vid"))
    new = f.select(F.col("vid").alias("new_vid"), F.col("fact_id").alias("new_fact_id"), F.col("value_text").alias("new_value"))
    return p.join(f.select("vid", "fact_id", "value_text"), "vid").join(new, "new_vid").select("vid", "fact_id", "value_text", "new_fact_id", "new_value")


def memory_delete(spark: SparkSession, d: str) -> DataFrame:
    """The store after a tombstone on each superseded fact of the log: deleted is final."""
    f = stored(spark, d, "status", "valid_to")
    gone = f.where("status = 'superseded'").select("vid", F.lit("deleted").alias("status"), F.greatest(F.coalesce("valid_to", F.lit(0)), F.lit(1)).alias("valid_to"), F.lit(2).alias("guard"))
    rows = f.select("vid", "status", F.coalesce("valid_to", F.lit(0)).alias("valid_to"), F.lit(1).alias("guard")).unionByName(gone)
    out = merge.guarded_merge(rows, ["vid"], F.col("guard"), F.col("guard"))
    return out.groupBy("status").agg(F.count("*").alias("n"))


def entities_of_instance(spark: SparkSession, d: str) -> DataFrame:
    """The entities of every tenant that asks a question."""
    e = entities(spark, d).select("instance_id", "vid", "key", "name", "entity_type")
    return e.join(table(spark, d, "instances").select("instance_id"), "instance_id", "left_semi")


def subject_of_fact(spark: SparkSession, d: str) -> DataFrame:
    """The entity that each fact is about, looked up by its id."""
    e = entities(spark, d).select(F.col("vid").alias("subject_vid"), "key", "name", "entity_type")
    return stored(spark, d, "subject_vid").join(e, "subject_vid").select("vid", "subject_vid", "key", "name", "entity_type")


def facts_by_id(spark: SparkSession, d: str) -> DataFrame:
    """The fact behind every id that supersedes another, looked up by its id."""
    f = stored(spark, d, "fact_id", "instance_id", "subject_vid", "predicate", "value_text", "valid_from", "asserted_at", "turn_idx")
    ids = chain.pairs(f).select(F.col("src").alias("vid")).distinct()
    return f.join(ids, "vid", "left_semi").select("vid", "fact_id", "instance_id", "predicate", "value_text", "asserted_at")


def batch_keys(spark: SparkSession, d: str) -> DataFrame:
    """A key for each batch of answer messages, from what is in it."""
    from factloom.functions.ids import batch_keys as keys

    return keys(table(spark, d, "results"), "batch_no", ["delivery_id", "run_id", "arm", "instance_id", "answer"], "results")


QUERIES = {f.__name__: f for f in (det_ids, normalize_keys, facts_of_subject, edge_counts, supersession_facts, supersession_pairs, current_facts, predecessors, change_history, since_current, window_bounds, facts_in_window, value_at_time, guarded_merge, close_facts, guarded_entities, edge_integrity, asked_predicates, memory_get_all, memory_history, memory_delete, entities_of_instance, subject_of_fact, facts_by_id, batch_keys)}

_END = "CASE WHEN nxt IS NULL THEN 0 ELSE greatest(nvf, coalesce(valid_from, 0)) END"
_DAY = 86400
_Q = "lower(coalesce(question, ''))"


def _windows() -> str:
    from factloom.functions import windows as w

    x = lambda p, i: f"regexp_extract({_Q}, '{p}', {i})"
    date = lambda y, m, dd: f"epoch(try_cast(format('{{:04d}}-{{:02d}}-{{:02d}}', {y}, {m}, {dd}) AS DATE))::BIGINT"
    month = "CASE " + x(w.MONTH_YEAR, 1) + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in vocab.MONTHS.items()) + " END"
    n = f"coalesce(try_cast({x(w.AGO, 1)} AS INT), CASE {x(w.AGO, 1)} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in w.COUNTS.items()) + " END)"
    return f"""r0 AS (SELECT instance_id, question, asked_at, CASE WHEN regexp_matches({_Q}, '{w.ISO}') THEN 1 WHEN regexp_matches({_Q}, '{w.BEFORE}') THEN 2 WHEN regexp_matches({_Q}, '{w.SINCE}') THEN 3
 WHEN regexp_matches({_Q}, '{w.MONTH_YEAR}') THEN 4 WHEN regexp_matches({_Q}, '{w.IN_YEAR}') THEN 5 WHEN asked_at IS NULL THEN 0 WHEN regexp_matches({_Q}, '{w.LAST_UNIT}') THEN 6 WHEN regexp_matches({_Q}, '{w.AGO}') THEN 7 ELSE 0 END AS r FROM instances),
r1 AS (SELECT *, try_cast(CASE r WHEN 1 THEN {x(w.ISO, 1)} WHEN 2 THEN {x(w.BEFORE, 1)} WHEN 3 THEN {x(w.SINCE, 1)} WHEN 4 THEN {x(w.MONTH_YEAR, 2)} WHEN 5 THEN {x(w.IN_YEAR, 1)} END AS INT) AS y,
 CASE r WHEN 1 THEN try_cast({x(w.ISO, 2)} AS INT) WHEN 4 THEN {month} END AS mo, CASE r WHEN 1 THEN try_cast({x(w.ISO, 3)} AS INT) END AS dd,
 CASE r WHEN 6 THEN 1 WHEN 7 THEN {n} END AS n, CASE r WHEN 6 THEN {x(w.LAST_UNIT, 1)} WHEN 7 THEN {x(w.AGO, 2)} END AS u, to_timestamp(coalesce(asked_at, 0)) AT TIME ZONE 'UTC' AS a,
 CASE r WHEN 1 THEN {x(w.ISO, 0)} WHEN 2 THEN {x(w.BEFORE, 0)} WHEN 3 THEN {x(w.SINCE, 0)} WHEN 4 THEN {x(w.MONTH_YEAR, 0)} WHEN 5 THEN {x(w.IN_YEAR, 0)} WHEN 6 THEN {x(w.LAST_UNIT, 0)} WHEN 7 THEN {x(w.AGO, 0)} END AS phrase FROM r0),
r2 AS (SELECT *, CASE WHEN u = 'week' THEN {7 * _DAY} ELSE {_DAY} END AS span, year(a) * 12 + month(a) - 1 - n AS then_ FROM r1),
win AS (SELECT instance_id, question, phrase, CASE WHEN r = 1 THEN {date("y", "mo", "dd")} WHEN r = 2 THEN 0 WHEN r IN (3, 5) THEN {date("y", 1, 1)} WHEN r = 4 THEN {date("y", "mo", 1)}
 WHEN r > 5 AND u = 'year' THEN {date("year(a) - n", 1, 1)} WHEN r > 5 AND u = 'month' THEN {date("then_ // 12", "then_ % 12 + 1", 1)} WHEN r > 5 THEN asked_at - span * n END::BIGINT AS w_start,
 CASE WHEN r = 1 THEN {date("y", "mo", "dd")} + {_DAY} WHEN r = 2 THEN {date("y", 1, 1)} WHEN r = 3 THEN 0 WHEN r = 4 THEN {date("(y * 12 + mo) // 12", "(y * 12 + mo) % 12 + 1", 1)} WHEN r = 5 THEN {date("y + 1", 1, 1)}
 WHEN r > 5 AND u = 'year' THEN {date("year(a) - n + 1", 1, 1)} WHEN r > 5 AND u = 'month' THEN {date("(then_ + 1) // 12", "(then_ + 1) % 12 + 1", 1)} WHEN r > 5 THEN asked_at - span * (n - 1) END::BIGINT AS w_end FROM r2)"""


WINDOWS = _windows()
_LABEL = "strftime(to_timestamp(w_start) AT TIME ZONE 'UTC', '%Y-%m-%d') || '..' || CASE WHEN w_end = 0 THEN 'onwards' ELSE strftime(to_timestamp(w_end) AT TIME ZONE 'UTC', '%Y-%m-%d') END"
_OVER = "(f.vt = 0 OR f.vt > {a}) AND ({b} = 0 OR coalesce(f.valid_from, 0) < {b})"
_HIST = "partition by instance_id, subject_key, predicate order by coalesce(valid_from, 0), coalesce(asserted_at, 0), coalesce(turn_idx, 0), vid"
_CHANGED = f"""{sql.STORED}, ch AS (SELECT *, {sql.fold("coalesce(value_text, '')")} AS v FROM stored WHERE instance_id IS NOT NULL AND subject_key IS NOT NULL AND predicate IS NOT NULL),
hist AS (SELECT instance_id, subject_key, predicate, coalesce(valid_from, 0) AS changed_at, value_text, fact_id, vid FROM (SELECT *, lag(v) OVER ({_HIST}) AS p, row_number() OVER ({_HIST}) AS rn FROM ch) WHERE rn = 1 OR p <> v)"""

ORACLE = {
    "det_ids": f"SELECT vid, {sql.nid('E', 'instance_id || chr(124) || key')} AS entity_id, sha256(coalesce(instance_id, '') || '|' || coalesce(key, '') || '|' || coalesce(name, '')) AS content_key FROM entities",
    "normalize_keys": f"SELECT extract_id, {sql.normalized("coalesce(subject, '')")} AS norm, {sql.entity_key("coalesce(subject_type, 'thing')", "coalesce(subject, '')")} AS entity_key FROM extracted_facts",
    "facts_of_subject": f"WITH {sql.STORED} SELECT s.vid, fact_id, s.instance_id, subject_key, e.name AS subject_name, predicate, value_text, asserted_at FROM stored s JOIN entities e ON e.vid = s.subject_vid",
    "edge_counts": f"""WITH {sql.CHAIN} SELECT instance_id, 'facts' AS what, count(*) AS n FROM stored GROUP BY 1 UNION ALL SELECT instance_id, 'entities', count(*) FROM entities GROUP BY 1
 UNION ALL SELECT instance_id, 'subject_edges', count(*) FROM stored WHERE subject_vid IN (SELECT vid FROM entities) GROUP BY 1 UNION ALL SELECT instance_id, 'supersedes_edges', count(*) FROM chain WHERE nxt IS NOT NULL GROUP BY 1""",
    "supersession_facts": f"WITH {sql.CHAIN} SELECT vid, slot, nxt AS superseded_by, CASE WHEN nxt IS NULL THEN 'current' ELSE 'superseded' END AS status, {_END}::BIGINT AS valid_to FROM chain",
    "supersession_pairs": f"WITH {sql.CHAIN} SELECT nxt AS src, vid AS dst, {sql.nid('R', "nxt || '|SUPERSEDES|' || vid")} AS rid, instance_id FROM chain WHERE nxt IS NOT NULL",
    "current_facts": f"WITH {sql.CHAIN} SELECT vid, instance_id, subject_key, predicate, value_text FROM chain WHERE nxt IS NULL",
    "predecessors": f"""WITH {sql.STORED} SELECT vid, fact_id, replaced FROM (SELECT vid, fact_id, lag(fact_id) OVER (PARTITION BY instance_id, subject_key, predicate, slot ORDER BY asserted_at, coalesce(turn_idx, 0), vid) AS replaced
 FROM (SELECT *, {sql.slot()} AS slot FROM stored)) WHERE replaced IS NOT NULL""",
    "change_history": f"WITH {_CHANGED} SELECT * FROM hist",
    "since_current": f"WITH {_CHANGED} SELECT instance_id, subject_key, predicate, max(changed_at) AS since FROM hist GROUP BY ALL",
    "window_bounds": f"WITH {WINDOWS} SELECT instance_id, w_start, w_end, CASE WHEN w_start IS NOT NULL THEN phrase END AS w_phrase, CASE WHEN w_start IS NOT NULL THEN {_LABEL} END AS label FROM win",
    "facts_in_window": f"WITH {sql.CHAIN}, {WINDOWS}, f AS (SELECT *, {_END} AS vt FROM chain) SELECT f.instance_id, f.vid FROM f JOIN win w ON w.instance_id = f.instance_id WHERE w_start IS NOT NULL AND {_OVER.format(a='w_start', b='w_end')}",
    "value_at_time": f"WITH {sql.CHAIN}, f AS (SELECT *, {_END} AS vt FROM chain) SELECT f.instance_id, f.vid, subject_key, predicate, value_text FROM f JOIN instances i ON i.instance_id = f.instance_id WHERE asked_at IS NOT NULL AND {_OVER.format(a='asked_at', b='(asked_at + 1)')}",
    "guarded_merge": f"WITH {sql.STORED} SELECT vid, value_text, status, valid_to, asserted_at, log_id FROM stored",
    "close_facts": f"""WITH {sql.CHAIN}, u AS (SELECT vid, {_END}::BIGINT AS valid_to, CASE WHEN nxt IS NULL THEN 'current' ELSE 'superseded' END AS status, 1 AS arr FROM chain UNION ALL SELECT vid, coalesce(valid_to, 0), status, log_id + 1 FROM facts)
 SELECT vid, valid_to, status FROM u QUALIFY row_number() OVER (PARTITION BY vid ORDER BY valid_to DESC, arr) = 1""",
    "guarded_entities": f"""WITH {sql.STORED}, u AS (SELECT vid, name, first_seen, last_seen, 0 AS arrival FROM entities UNION ALL SELECT subject_vid, subject_key, turn_idx, turn_idx, log_id FROM stored),
 f AS (SELECT vid, first_seen FROM u QUALIFY row_number() OVER (PARTITION BY vid ORDER BY arrival) = 1), w AS (SELECT vid, name, last_seen FROM u QUALIFY row_number() OVER (PARTITION BY vid ORDER BY last_seen DESC NULLS LAST, arrival) = 1)
 SELECT w.vid, name, first_seen, last_seen FROM w JOIN f USING (vid)""",
    "edge_integrity": f"WITH {sql.STORED} SELECT vid, 'subject' AS missing FROM stored WHERE subject_vid NOT IN (SELECT vid FROM entities) UNION ALL SELECT vid, 'session' FROM stored s WHERE NOT EXISTS (SELECT 1 FROM sessions WHERE key = s.session_id) UNION ALL SELECT vid, 'object' FROM (SELECT vid, instance_id, {sql.entity_key(sql.object_type(), 'value_text')} AS k FROM stored WHERE value_type = 'entity' AND value_text IS NOT NULL AND instance_id IS NOT NULL) o WHERE NOT EXISTS (SELECT 1 FROM entities e WHERE e.instance_id = o.instance_id AND e.key = o.k)",
    "asked_predicates": f"SELECT instance_id, array_to_string({sql.wanted("coalesce(question, '')")}, ',') AS wanted FROM instances",
    "memory_get_all": f"WITH {sql.STORED} SELECT instance_id, vid, fact_id, predicate, value_text, valid_from FROM stored WHERE status = 'current'",
    "memory_history": f"WITH {sql.CHAIN} SELECT c.vid, c.fact_id, c.value_text, n.fact_id AS new_fact_id, n.value_text AS new_value FROM chain c JOIN stored n ON n.vid = c.nxt",
    "memory_delete": f"WITH {sql.STORED} SELECT CASE status WHEN 'superseded' THEN 'deleted' ELSE status END AS status, count(*) AS n FROM stored GROUP BY 1",
    "entities_of_instance": "SELECT instance_id, vid, key, name, entity_type FROM entities WHERE instance_id IN (SELECT instance_id FROM instances)",
    "subject_of_fact": f"WITH {sql.STORED} SELECT s.vid, subject_vid, e.key, e.name, e.entity_type FROM stored s JOIN entities e ON e.vid = s.subject_vid",
    "facts_by_id": f"WITH {sql.CHAIN} SELECT vid, fact_id, instance_id, predicate, value_text, asserted_at FROM stored WHERE vid IN (SELECT nxt FROM chain)",
    "batch_keys": """SELECT batch_no, 'results.' || sha256(count(*) || '|' || sum(('0x' || substr(sha256(concat_ws('|', coalesce(delivery_id::VARCHAR, ''), coalesce(run_id, ''), coalesce(arm, ''), coalesce(instance_id, ''), coalesce(answer, ''))), 1, 15))::BIGINT)::HUGEINT) AS key FROM results GROUP BY 1""",
}
