"""Queries that build and walk the graph, and gate questions on it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import vocab
from factloom.functions.text import mentions
from factloom.functions.windows import with_window
from factloom.operators import gates, graph
from factloom.plans import sql
from factloom.plans.facts import WINDOWS, entities, questions, stored
from factloom.session import written
from factloom.sources.tables import table


def _touched(spark: SparkSession, d: str) -> DataFrame:
    return graph.touched(table(spark, d, "extracted_facts"), table(spark, d, "sessions"), table(spark, d, "turns"))


def clean_facts(spark: SparkSession, d: str) -> DataFrame:
    c = graph.cleaned(table(spark, d, "extracted_facts"), graph.turn_counts(table(spark, d, "turns")))
    return c.select("extract_id", "subject", "subject_type", "predicate", "value_text", "turn_idx", "evidence_span")


def date_hints(spark: SparkSession, d: str) -> DataFrame:
    t = _touched(spark, d)
    return t.select("extract_id", graph.valid_from(t, "valid_from_hint", "said_at").alias("valid_from"))


def build_facts(spark: SparkSession, d: str) -> DataFrame:
    return graph.fact_rows(_touched(spark, d)).drop("object_key", "confidence")


def build_entities(spark: SparkSession, d: str) -> DataFrame:
    return graph.entity_rows(_touched(spark, d))


def build_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.fact_edges(graph.fact_rows(_touched(spark, d)))


def edge_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return build_edges(spark, d).groupBy("type").agg(F.count("*").alias("n"))


def session_next_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.session_edges(table(spark, d, "sessions"))


def session_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Sessions as an unguarded merge: the last arrival of a key wins."""
    from factloom.operators.merge import last_wins

    s = table(spark, d, "sessions").select("key", "vid", "idx", "instance_id", "received_at")
    return last_wins(s, ["key"], F.struct("received_at", "vid")).select("key", "vid", "idx", "instance_id")


def entity_first_last_seen(spark: SparkSession, d: str) -> DataFrame:
    return build_entities(spark, d).select("instance_id", "key", "first_seen", "last_seen")


def alias_containment(spark: SparkSession, d: str) -> DataFrame:
    return graph.alias_containment(entities(spark, d))


def alias_ratio(spark: SparkSession, d: str) -> DataFrame:
    return graph.alias_ratio(entities(spark, d))


def alias_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Near-identical names: by containment or by ratio."""
    return graph.alias_links(entities(spark, d))


def alias_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.alias_edges(graph.alias_links(entities(spark, d)))


def aliases_of_entity(spark: SparkSession, d: str) -> DataFrame:
    """Each entity with those that it is an alias of."""
    e = entities(spark, d).where("key is not null")
    a, c = e.select("instance_id", F.col("key").alias("alias_key"), "vid"), e.select("instance_id", F.col("key").alias("canonical_key"), F.col("vid").alias("alias_of"), "name")
    return graph.alias_links(entities(spark, d)).join(a, ["instance_id", "alias_key"]).join(c, ["instance_id", "canonical_key"]).select("instance_id", "vid", "alias_of", "name")


def payload_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many rows of each payload an ingestion of the tables writes."""
    from factloom.operators import chain

    t = written(_touched(spark, d), "touched")
    facts = written(graph.fact_rows(t), "facts")
    pairs = chain.pairs(facts.select("vid", "instance_id", "subject_vid", "predicate", "value_text", "valid_from", "asserted_at", "turn_idx"))
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("payload"), "n")
    parts = [one(table(spark, d, "sessions").select("key").where("key is not null").distinct(), "sessions"), one(graph.entity_rows(t), "entities"), one(facts, "facts"), graph.fact_edges(facts).groupBy(F.lower("type").alias("payload")).agg(F.count("*").alias("n")),
             one(session_next_edges(spark, d), "next"), one(alias_pairs(spark, d), "alias"), one(pairs, "close"), one(pairs, "supersedes")]
    return reduce(DataFrame.unionByName, parts)


def alias_closure(spark: SparkSession, d: str) -> DataFrame:
    return graph.alias_closure(graph.alias_links(entities(spark, d)))


def path_pairs_2(spark: SparkSession, d: str) -> DataFrame:
    return graph.adjacent(graph.incidence(stored(spark, d, "instance_id", "subject_key", "predicate", "value_text", "value_type"))).where("a < b")


def path_anchor_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of an entity that a question's instance knows by name and the user, and how far apart they are."""
    e = entities(spark, d).where("key not in ('person:user', 'person:assistant')").select("instance_id", F.lit("person:user").alias("a"), F.col("key").alias("b"))
    return graph.connected(e, graph.adjacent(graph.incidence(stored(spark, d, "instance_id", "subject_key", "predicate", "value_text", "value_type"))))


def question_paths(spark: SparkSession, d: str) -> DataFrame:
    """The paths between all pairs of anchors of each question, with their entities and facts."""
    f = stored(spark, d)
    g = gates.entity_gate(questions(spark, d), entities(spark, d), f, _aliases(spark, d)).where("passed")
    t = g.select("instance_id", F.array_except("resolved", F.array(F.lit(vocab.ASSISTANT_KEY))).alias("t"))
    pairs = t.select("instance_id", "t", F.explode("t").alias("a")).select("instance_id", "a", F.explode("t").alias("b")).where("a < b")
    p = graph.path_rows(pairs, graph.incidence(f))
    return p.select("instance_id", "a", "b", "hops", F.array_join("entities", " > ").alias("entities"), F.array_join("facts", ",").alias("facts"))


def paths_found(spark: SparkSession, d: str) -> DataFrame:
    """The paths between the user and every other entity of an instance, within its limit, with their entities and facts."""
    e = entities(spark, d).where("key not in ('person:user', 'person:assistant')").select("instance_id", F.lit("person:user").alias("a"), F.col("key").alias("b"))
    p = graph.path_rows(e, graph.incidence(stored(spark, d, "instance_id", "subject_key", "predicate", "value_text", "value_type")))
    return p.select("instance_id", "a", "b", "hops", F.array_join("entities", " > ").alias("entities"), F.array_join("facts", ",").alias("facts"))


def question_mentions(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("instance_id", F.array_join(mentions(F.coalesce("question", F.lit(""))), ",").alias("mentions"))


def _aliases(spark: SparkSession, d: str) -> DataFrame:
    return graph.alias_closure(graph.alias_links(entities(spark, d)))


def text_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Every mention of every question, looked for in the texts of its instance."""
    return gates.text_resolved(gates.named(questions(spark, d)), stored(spark, d, "instance_id", "asserted_at", "subject_key", "value_text", "snippet"))


def gate_entity(spark: SparkSession, d: str) -> DataFrame:
    g = gates.entity_gate(questions(spark, d), entities(spark, d), stored(spark, d, "instance_id", "asserted_at", "subject_key", "predicate", "value_text", "value_type", "snippet", "valid_from", "valid_to"), _aliases(spark, d))
    return g.select("instance_id", "passed", F.coalesce("missing", F.lit("")).alias("missing"), F.array_join("resolved", ",").alias("resolved"))


def gate_predicate(spark: SparkSession, d: str) -> DataFrame:
    """The predicate gate for every subject of a question's instance."""
    from factloom.functions.text import question_predicates

    q = questions(spark, d).select("instance_id", question_predicates(F.coalesce("question", F.lit(""))).alias("wanted"))
    h = gates.held(stored(spark, d, "instance_id", "subject_key", "predicate")).join(q, "instance_id")
    return h.select("instance_id", "key", gates.predicate_passes(F.col("wanted"), F.col("predicates"), F.col("key")).alias("passed"))


def gate_window(spark: SparkSession, d: str) -> DataFrame:
    """The window gate for every subject of an instance whose question names a window."""
    from factloom.functions.text import question_predicates

    q = with_window(questions(spark, d)).select("instance_id", question_predicates(F.coalesce("question", F.lit(""))).alias("wanted"), "w_start", "w_end")
    f = stored(spark, d, "instance_id", "subject_key", "predicate", "valid_from", "valid_to")
    keys = f.select("instance_id", F.col("subject_key").alias("key")).distinct().join(q, "instance_id")
    return gates.window_hits(keys, f).select("instance_id", "key", (F.col("hit") == 1).alias("passed"))


def gate_cascade(spark: SparkSession, d: str) -> DataFrame:
    return gates.cascade(questions(spark, d), entities(spark, d), stored(spark, d, "instance_id", "asserted_at", "subject_key", "predicate", "value_text", "value_type", "snippet", "valid_from", "valid_to"), _aliases(spark, d)).drop("trace")


def cascade_cost(spark: SparkSession, d: str) -> DataFrame:
    return gate_cascade(spark, d).groupBy("reason", "round_trips").agg(F.count("*").alias("n"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "results").select(F.col("delivery_id").alias("id"), F.lower(F.trim("instance_id")).alias("instance_id"), "answer", F.col("cited_fact_ids").alias("cited"))


def citation_gate(spark: SparkSession, d: str) -> DataFrame:
    return gates.citation_gate(_answers(spark, d), stored(spark, d, "instance_id", "fact_id"))


def appeals(spark: SparkSession, d: str) -> DataFrame:
    w = with_window(questions(spark, d)).select("instance_id", F.col("w_start").isNotNull().alias("windowed"))
    g = table(spark, d, "results").where("abstained").select(F.col("delivery_id").alias("id"), F.lower(F.trim("instance_id")).alias("instance_id"), F.coalesce("reason", F.lit("")).alias("reason"))
    return gates.appeal(g.join(w, "instance_id"), stored(spark, d, "instance_id", "snippet"))


QUERIES = {f.__name__: f for f in (clean_facts, date_hints, build_facts, build_entities, build_edges, edge_type_counts, session_next_edges, session_upsert, entity_first_last_seen, alias_containment, alias_ratio, alias_pairs, alias_edges, aliases_of_entity, payload_counts, alias_closure, path_pairs_2, path_anchor_pairs, paths_found, question_paths, question_mentions, text_resolve, gate_entity, gate_predicate, gate_window, gate_cascade, cascade_cost, citation_gate, appeals)}

# --- the same in DuckDB

_ABSENT = " OR ".join(f"starts_with(low, '{p}')" for p in vocab.EMPTY_PREFIXES)
_T = sql.strip("coalesce(valid_from_hint, '')")
_D = lambda s: f"epoch(try_cast({s} AS DATE))::BIGINT"
_BARE = lambda y: _D(f"lpad(({y})::VARCHAR, 4, '0') || '-' || lpad(regexp_extract(t, '^(\\d{{1,2}})/(\\d{{1,2}})$', 1), 2, '0') || '-' || lpad(regexp_extract(t, '^(\\d{{1,2}})/(\\d{{1,2}})$', 2), 2, '0')")
_YMD = lambda p, y, m, dd: _D(f"regexp_extract(t, '{p}', {y}) || '-' || " + (f"lpad(regexp_extract(t, '{p}', {m}), 2, '0')" if m else "'01'") + " || '-' || " + (f"lpad(regexp_extract(t, '{p}', {dd}), 2, '0')" if dd else "'01'"))
_P1, _P2, _P3, _P4, _P5 = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})$", r"^(\d{4})[-/](\d{1,2})$", r"^(\d{1,2})/(\d{1,2})/(\d{4})$", r"^(\d{4})$", r"^(\d{1,2})/(\d{1,2})$"
CLEAN = f"""nt AS (SELECT session_id, count(*)::INT AS n_turns FROM turns WHERE session_id IS NOT NULL GROUP BY 1),
c0 AS (SELECT * REPLACE ({sql.strip("coalesce(subject, '')")} AS subject, {sql.strip("coalesce(value_text, '')")} AS value_text, substr(coalesce(evidence_span, ''), 1, 240) AS evidence_span), coalesce(try_cast(regexp_replace(turn_ref, '[^0-9]', '', 'g') AS INT), 0) AS ti FROM extracted_facts),
c1 AS (SELECT *, regexp_replace(lower(value_text), '\\.+$', '') AS low FROM c0 WHERE subject <> '' AND value_text <> ''),
clean AS (SELECT * EXCLUDE (low, ti, n_turns, turn_ref) REPLACE (CASE WHEN predicate IN ({sql.strings(vocab.PREDICATES)}) THEN predicate ELSE 'other' END AS predicate, CASE WHEN subject_type IN ({sql.strings(vocab.ENTITY_TYPES)}) THEN subject_type ELSE 'thing' END AS subject_type),
 CASE WHEN ti < coalesce(n_turns, 0) THEN ti ELSE 0 END AS turn_idx FROM c1 LEFT JOIN nt USING (session_id) WHERE low NOT IN ({sql.strings(vocab.EMPTY_VALUES)}) AND NOT ({_ABSENT}))"""
TOUCHED = f"""{CLEAN}, se AS (SELECT key AS session_id, idx AS session_idx, floor(epoch(received_at))::BIGINT AS said_at FROM sessions), tu AS (SELECT session_id, idx AS turn_idx, role, content FROM turns),
t0 AS (SELECT c.*, session_idx, said_at, role, content, {sql.entity_key("c.subject_type", "c.subject")} AS k, {sql.object_type()} AS object_type FROM clean c JOIN se USING (session_id) LEFT JOIN tu USING (session_id, turn_idx)),
t1 AS (SELECT *, CASE WHEN role = 'assistant' AND k = 'person:user' THEN 'person:assistant' ELSE k END AS subject_key, CASE WHEN role = 'assistant' AND k = 'person:user' THEN 'assistant' ELSE subject END AS subject_name,
 CASE WHEN value_is_entity THEN {sql.entity_key("object_type", "value_text")} END AS object_key, {_T} AS t FROM t0),
touched AS (SELECT *, coalesce(CASE WHEN regexp_matches(t, '{_P1}') THEN {_YMD(_P1, 1, 2, 3)} WHEN regexp_matches(t, '{_P2}') THEN {_YMD(_P2, 1, 2, 0)} WHEN regexp_matches(t, '{_P3}') THEN {_YMD(_P3, 3, 1, 2)} WHEN regexp_matches(t, '{_P4}') THEN {_YMD(_P4, 1, 0, 0)}
 WHEN regexp_matches(t, '{_P5}') THEN CASE WHEN {_BARE('year(to_timestamp(said_at))')} > said_at + 86400 THEN {_BARE('year(to_timestamp(said_at)) - 1')} ELSE {_BARE('year(to_timestamp(said_at))')} END END, said_at) AS vf FROM t1)"""
FACTS = f"""{TOUCHED}, fk AS (SELECT *, sha256(coalesce(instance_id, '') || '|' || coalesce(session_id, '') || '|' || turn_idx || '|' || predicate || '|' || subject_key || '|' || value_text) AS kk FROM touched),
fr AS (SELECT *, {sql.nid('F', 'kk')} AS vid FROM fk QUALIFY row_number() OVER (PARTITION BY kk ORDER BY session_idx, extract_id) = 1)"""
_EDGES = f"""{FACTS}, e0 AS (SELECT vid AS src, instance_id, 'SUBJECT' AS type, {sql.nid('E', "instance_id || '|' || subject_key")} AS dst FROM fr UNION ALL SELECT vid, instance_id, 'OBJECT', {sql.nid('E', "instance_id || '|' || object_key")} FROM fr WHERE object_key IS NOT NULL
 UNION ALL SELECT vid, instance_id, 'ASSERTED_IN', {sql.nid('S', "instance_id || '|' || session_id")} FROM fr)"""
_ENT = f"""{TOUCHED}, u AS (SELECT instance_id, session_idx, extract_id, subject_key AS key, subject_name AS name, 'person' AS entity_type, 0 AS part FROM touched UNION ALL SELECT instance_id, session_idx, extract_id, object_key, value_text, object_type, 1 FROM touched WHERE object_key IS NOT NULL),
seen AS (SELECT instance_id, key, min(session_idx) AS first_seen, max(session_idx) AS last_seen FROM u GROUP BY 1, 2), fst AS (SELECT instance_id, key, name, entity_type FROM u QUALIFY row_number() OVER (PARTITION BY instance_id, key ORDER BY session_idx, extract_id, part) = 1)"""
_ENT_ONLY = _ENT.removeprefix(f"{TOUCHED}, ")
_ALIAS = f"""nm AS (SELECT DISTINCT instance_id, entity_type AS kind, key, coalesce({sql.normalized('name')}, '') AS norm FROM entities WHERE instance_id IS NOT NULL), nw AS (SELECT *, list_distinct(string_split(norm, ' ')) AS ws FROM nm WHERE norm <> ''),
alias AS (SELECT DISTINCT a.instance_id, a.key AS alias_key, b.key AS canonical_key FROM nw a JOIN nw b ON a.instance_id = b.instance_id AND a.kind = b.kind AND a.key <> b.key AND length(a.norm) < length(b.norm) AND len(a.ws) < len(b.ws) AND list_has_all(b.ws, a.ws))"""
# The longest matching block of two texts, the first of the longest; what is left and right of it is matched in turn.
_BLOCK = "list_max(flatten(list_transform(range(1, length(a) + 1), lambda i: list_transform(list_filter(range(1, length(a) - i + 2), lambda n: contains(b, substr(a, i, n))), lambda n: {'n': n, 'i': -i}))))"
_RATIO = f"""{_ALIAS}, rp AS (SELECT row_number() OVER () AS pid, x.instance_id, x.key AS alias_key, y.key AS canonical_key, x.norm AS a, y.norm AS b FROM nw x JOIN nw y ON x.instance_id = y.instance_id AND x.kind = y.kind AND x.key <> y.key AND length(x.norm) < length(y.norm) AND 2 * length(x.norm) > 0.92 * (length(x.norm) + length(y.norm))),
seg AS (SELECT pid, a, b, {_BLOCK} AS m FROM rp UNION ALL SELECT pid, a, b, {_BLOCK} FROM (SELECT pid, unnest([substr(a, 1, -m.i - 1), substr(a, -m.i + m.n, length(a))]) AS a, unnest([substr(b, 1, strpos(b, substr(a, -m.i, m.n)) - 1), substr(b, strpos(b, substr(a, -m.i, m.n)) + m.n, length(b))]) AS b FROM seg WHERE m IS NOT NULL) WHERE a <> '' AND b <> ''),
ratios AS (SELECT DISTINCT rp.instance_id, alias_key, canonical_key, (2 * t)::DOUBLE / (length(a) + length(b)) AS ratio FROM rp JOIN (SELECT pid, sum(m.n) AS t FROM seg GROUP BY 1) USING (pid) WHERE (2 * t)::DOUBLE / (length(a) + length(b)) > 0.92),
links AS (SELECT instance_id, alias_key, canonical_key FROM alias UNION SELECT instance_id, alias_key, canonical_key FROM ratios)"""
_CLOSURE = f"""{_RATIO}, a0 AS (SELECT instance_id, alias_key, max(canonical_key) AS canonical_key FROM links GROUP BY 1, 2),
chase AS (SELECT instance_id, alias_key, canonical_key AS here, [alias_key, canonical_key] AS seen FROM a0
 UNION ALL SELECT c.instance_id, c.alias_key, a0.canonical_key, list_append(seen, a0.canonical_key) FROM chase c JOIN a0 ON a0.instance_id = c.instance_id AND a0.alias_key = c.here WHERE list_position(seen, c.here) = len(seen)),
closed AS (SELECT instance_id, alias_key, arg_max(here, len(seen)) AS canonical_key FROM chase GROUP BY 1, 2)"""
_INC_ = f"""inc AS (SELECT DISTINCT instance_id, vid AS fact, subject_key AS entity FROM stored WHERE subject_key IS NOT NULL AND instance_id IS NOT NULL UNION SELECT instance_id, vid, {sql.entity_key(sql.object_type(), 'value_text')} FROM stored WHERE value_type = 'entity' AND value_text IS NOT NULL AND instance_id IS NOT NULL),
adj AS (SELECT DISTINCT x.instance_id, x.entity AS a, y.entity AS b FROM inc x JOIN inc y ON x.instance_id = y.instance_id AND x.fact = y.fact AND x.entity <> y.entity)"""
_INC = f"{sql.STORED}, {_INC_}"
_MENTION = rf"""m0 AS (SELECT instance_id, coalesce(question, '') AS q, list_transform(regexp_extract_all(coalesce(question, ''), '\b[A-Z][a-z]{{2,}}(?:\s+[A-Z][a-z]+)*'), lambda r: lower(r)) AS runs FROM instances),
m1 AS (SELECT instance_id, q, list_transform(runs, lambda r: CASE WHEN regexp_extract(r, '^(\S+)', 1) IN ({sql.strings(vocab.STARTERS)}) THEN regexp_replace(regexp_replace(r, '^\S+\s*', ''), '\s+', ' ', 'g') ELSE r END) AS bare FROM m0),
m2 AS (SELECT instance_id, q, list_filter(bare, lambda r: r <> '' AND r NOT IN ({sql.strings([*vocab.CALENDAR, *vocab.SECOND_PERSON])})) AS kept FROM m1),
m3 AS (SELECT instance_id, list_filter(kept, lambda x, i: list_position(kept, x) = i) || CASE WHEN list_has_any({sql.words('q')}, [{sql.strings(vocab.SELF_CUES)}]) THEN ['person:user'] ELSE [] END AS names FROM m2),
named AS (SELECT instance_id, unnest(names) AS mention, generate_subscripts(names, 1) - 1 AS pos FROM m3)"""
_TEXT = "txt AS (SELECT n.instance_id, n.mention, arg_min(coalesce(f.subject_key, 'person:user'), (f.asserted_at, f.vid)) AS key FROM (SELECT DISTINCT instance_id, mention FROM named) n JOIN stored f ON f.instance_id = n.instance_id AND (contains(lower(coalesce(f.value_text, '')), n.mention) OR contains(lower(coalesce(f.snippet, '')), n.mention)) GROUP BY 1, 2)"
_GATE1 = f"""{sql.STORED}, {_MENTION}, {_TEXT}, {_CLOSURE}, forms AS (SELECT instance_id, vid, key, key AS mention, 0 AS way FROM entities UNION ALL SELECT instance_id, vid, key, {sql.fold('name')}, 1 FROM entities UNION ALL SELECT instance_id, vid, key, regexp_replace(key, '^[^:]*:', ''), 1 FROM entities),
byname AS (SELECT instance_id, mention, key FROM forms WHERE mention IS NOT NULL AND mention <> '' QUALIFY row_number() OVER (PARTITION BY instance_id, mention ORDER BY way, vid, key) = 1),
res AS (SELECT n.instance_id, n.pos, n.mention, b.key AS bk, CASE WHEN b.key IS NULL AND n.mention <> 'person:user' THEN t.key END AS tk FROM named n LEFT JOIN byname b ON b.instance_id = n.instance_id AND b.mention = n.mention LEFT JOIN txt t ON t.instance_id = n.instance_id AND t.mention = n.mention),
res2 AS (SELECT r.*, coalesce(c.canonical_key, bk, tk) AS rk FROM res r LEFT JOIN closed c ON c.instance_id = r.instance_id AND c.alias_key = coalesce(r.bk, r.tk)),
per AS (SELECT instance_id, arg_min(mention, pos) FILTER (WHERE rk IS NULL AND mention <> 'person:user') AS missing, list(rk ORDER BY pos) FILTER (WHERE rk IS NOT NULL) AS ks, count(*) FILTER (WHERE bk IS NULL AND tk IS NOT NULL) AS n_text FROM res2 GROUP BY 1),
fe AS (SELECT instance_id, arg_min(key, vid) AS first_key, max(CASE WHEN key = 'person:user' THEN key END) AS self_key FROM entities GROUP BY 1),
g0 AS (SELECT i.instance_id, i.question, CASE WHEN fe.first_key IS NULL THEN '<empty graph>' ELSE per.missing END AS missing, list_filter(coalesce(ks, []), lambda x, j: list_position(ks, x) = j) AS ks, coalesce(self_key, first_key) AS fb, coalesce(n_text, 0) AS n_text FROM instances i LEFT JOIN per USING (instance_id) LEFT JOIN fe USING (instance_id)),
g1 AS (SELECT instance_id, question, missing IS NULL AS passed, missing, n_text, CASE WHEN missing IS NOT NULL THEN [] WHEN len(ks) > 0 THEN ks ELSE [fb] END AS resolved FROM g0)"""
_HIT = "f.valid_to IS NULL OR f.valid_to = 0 OR f.valid_to > w_start"
_MEETS = "(coalesce(f.valid_to, 0) = 0 OR f.valid_to > w.w_start) AND (w.w_end = 0 OR coalesce(f.valid_from, 0) < w.w_end)"
_WHITS = f"""hits AS (SELECT f.instance_id, f.subject_key AS key, CASE WHEN bool_or(list_contains(w.wanted, f.predicate)) THEN bool_or(list_contains(w.wanted, f.predicate) AND ({_MEETS})) ELSE bool_or({_MEETS}) END AS hit
 FROM stored f JOIN ww w ON w.instance_id = f.instance_id WHERE w.w_start IS NOT NULL AND f.subject_key IS NOT NULL GROUP BY 1, 2)"""
_WW = f"{WINDOWS}, ww AS (SELECT *, {sql.wanted("coalesce(question, '')")} AS wanted FROM win)"
_HELD = "held AS (SELECT instance_id, subject_key AS key, list(DISTINCT predicate) AS predicates FROM stored WHERE subject_key IS NOT NULL GROUP BY 1, 2)"
_OK2 = "(len(wanted) = 0 OR list_has_any(coalesce(predicates, []), wanted) OR list_contains(coalesce(predicates, []), 'other') OR k.key = 'person:user')"
_LBL = "strftime(to_timestamp(w_start) AT TIME ZONE 'UTC', '%Y-%m-%d') || '..' || CASE WHEN w_end = 0 THEN 'onwards' ELSE strftime(to_timestamp(w_end) AT TIME ZONE 'UTC', '%Y-%m-%d') END"
_CASCADE = f"""{_GATE1}, {_WW}, {_WHITS}, {_HELD}, keys AS (SELECT instance_id, unnest(resolved) AS key, generate_subscripts(resolved, 1) AS pos FROM g1 WHERE passed),
k23 AS (SELECT k.instance_id, k.pos, k.key, {_OK2} AS ok2, (w_start IS NULL OR coalesce(hit, false)) AS ok3, wanted, phrase, CASE WHEN w_start IS NOT NULL THEN {_LBL} END AS lbl FROM keys k JOIN ww ON ww.instance_id = k.instance_id LEFT JOIN held h ON h.instance_id = k.instance_id AND h.key = k.key LEFT JOIN hits x ON x.instance_id = k.instance_id AND x.key = k.key),
v23 AS (SELECT instance_id, bool_or(ok2 AND ok3) AS ok23, arg_max(CASE WHEN NOT ok2 THEN 'no_such_relation' WHEN NOT ok3 THEN 'no_fact_in_window' ELSE '' END, pos) AS why,
 arg_max(CASE WHEN NOT ok2 THEN key || ' has no ' || array_to_string(wanted, ', ') WHEN NOT ok3 THEN key || ' has no fact valid ' || phrase || ' (' || lbl || ')' ELSE '' END, pos) AS detail FROM k23 GROUP BY 1),
an AS (SELECT instance_id, list_filter(resolved, lambda x: x <> 'person:assistant') AS t, len(resolved) AS n FROM g1 WHERE passed), ea AS (SELECT instance_id, unnest(t) AS a FROM an WHERE n >= 2 AND len(t) >= 2), two AS (SELECT x.instance_id, x.a, y.a AS b FROM ea x JOIN ea y ON x.instance_id = y.instance_id AND x.a < y.a),
{_INC_}, joined AS (SELECT DISTINCT two.instance_id FROM two WHERE EXISTS (SELECT 1 FROM adj WHERE adj.instance_id = two.instance_id AND adj.a = two.a AND adj.b = two.b) OR EXISTS (SELECT 1 FROM adj p JOIN adj r ON r.instance_id = p.instance_id AND r.a = p.b WHERE p.instance_id = two.instance_id AND p.a = two.a AND r.b = two.b)),
tried AS (SELECT instance_id, count(*) AS pairs FROM two GROUP BY 1), fin AS (SELECT g1.*, ok23, why, detail, pairs, tried.instance_id IS NOT NULL AS did, joined.instance_id IS NOT NULL AS ok4 FROM g1 LEFT JOIN v23 USING (instance_id) LEFT JOIN tried USING (instance_id) LEFT JOIN joined USING (instance_id)),
cascade AS (SELECT instance_id, passed AND ok23 AND (NOT did OR ok4) AS passed, CASE WHEN NOT passed THEN 'unknown_entity' WHEN NOT ok23 THEN why WHEN did AND NOT ok4 THEN 'no_path' ELSE '' END AS reason,
 CASE WHEN NOT passed THEN missing WHEN NOT ok23 THEN detail WHEN did AND NOT ok4 THEN array_to_string(resolved, ', ') || ': ' || pairs || ' pairs, no path within 4 hops' ELSE '' END AS missing, array_to_string(resolved, ',') AS resolved,
 CASE WHEN NOT passed THEN CASE WHEN n_text > 0 OR missing <> '<empty graph>' THEN 3 ELSE 2 END WHEN NOT ok23 THEN 3 WHEN did THEN 4 ELSE 3 END AS round_trips FROM fin)"""
_CITED = "list_filter(list_transform(coalesce(cited_fact_ids, []), lambda x: trim(lower(coalesce(x, '')))), lambda x: x <> '')"
CITE = f"""{sql.STORED}, an AS (SELECT delivery_id AS id, lower(trim(instance_id)) AS instance_id, coalesce(answer, '') AS answer, {_CITED} AS c0 FROM results), cit AS (SELECT * EXCLUDE c0, list_filter(c0, lambda x, i: list_position(c0, x) = i) AS cited FROM an)"""

# The paths of up to four edges between the anchors anc, ranked fairly within an instance.
_PATHS = """edge AS (SELECT x.instance_id, x.entity AS a, x.fact AS f, y.entity AS b FROM inc x JOIN inc y ON x.instance_id = y.instance_id AND x.fact = y.fact AND x.entity <> y.entity),
 pa AS (SELECT anc.*, 2 AS hops, [e.a, e.b] AS ents, [f] AS fs FROM anc JOIN edge e USING (instance_id, a, b) UNION ALL SELECT anc.*, 4, [e.a, e.b, g.b], [e.f, g.f] FROM anc JOIN edge e ON e.instance_id = anc.instance_id AND e.a = anc.a AND e.b <> anc.b JOIN edge g ON g.instance_id = e.instance_id AND g.a = e.b AND g.b = anc.b AND g.f <> e.f),
 pn AS (SELECT *, row_number() OVER (PARTITION BY instance_id, ents ORDER BY fs) AS n FROM pa), pr AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY n, ents) AS r FROM pn WHERE n <= 64)"""

ORACLE = {
    "clean_facts": f"WITH {CLEAN} SELECT extract_id, subject, subject_type, predicate, value_text, turn_idx, evidence_span FROM clean",
    "date_hints": f"WITH {TOUCHED} SELECT extract_id, vf AS valid_from FROM touched",
    "build_facts": f"""WITH {FACTS} SELECT vid, substr(kk, 1, 16) AS fact_id, instance_id, {sql.nid('E', "instance_id || '|' || subject_key")} AS subject_vid, subject_key, predicate, value_text, CASE WHEN value_is_entity THEN 'entity' ELSE 'literal' END AS value_type, vf AS valid_from, 0::BIGINT AS valid_to, said_at AS asserted_at,
 session_id, turn_idx, coalesce(role, '') AS role, substr(CASE WHEN evidence_span <> '' THEN evidence_span ELSE coalesce(content, '') END, 1, 240) AS snippet, 'current' AS status FROM fr""",
    "build_entities": f"""WITH {_ENT} SELECT {sql.nid('E', "instance_id || '|' || key")} AS vid, key, instance_id || '|' || key AS skey, name, entity_type, first_seen, last_seen, instance_id FROM seen JOIN fst USING (instance_id, key)""",
    "build_edges": f"WITH {_EDGES} SELECT src, dst, {sql.nid('R', "src || '|' || type || '|' || dst")} AS rid, type, instance_id FROM e0",
    "edge_type_counts": f"WITH {_EDGES} SELECT type, count(*) AS n FROM e0 GROUP BY 1",
    "session_next_edges": f"""SELECT src, dst, {sql.nid('R', "src || '|NEXT|' || dst")} AS rid, instance_id FROM (SELECT vid AS src, lead(vid) OVER (PARTITION BY instance_id ORDER BY coalesce(idx, 0), vid) AS dst, instance_id FROM sessions WHERE instance_id IS NOT NULL) WHERE dst IS NOT NULL""",
    "session_upsert": "SELECT key, vid, idx, instance_id FROM sessions QUALIFY row_number() OVER (PARTITION BY key ORDER BY received_at DESC, vid DESC) = 1",
    "entity_first_last_seen": f"WITH {_ENT} SELECT instance_id, key, first_seen, last_seen FROM seen",
    "alias_containment": f"WITH {_ALIAS} SELECT * FROM alias",
    "alias_ratio": f"WITH RECURSIVE {_RATIO} SELECT * FROM ratios",
    "alias_pairs": f"WITH RECURSIVE {_RATIO} SELECT * FROM links",
    "alias_edges": f"""WITH RECURSIVE {_RATIO} SELECT src, dst, {sql.nid('R', "src || '|ALIAS_OF|' || dst")} AS rid, instance_id FROM (SELECT instance_id, {sql.nid('E', "instance_id || '|' || alias_key")} AS src, {sql.nid('E', "instance_id || '|' || canonical_key")} AS dst FROM links)""",
    "aliases_of_entity": f"""WITH RECURSIVE {_RATIO} SELECT l.instance_id, x.vid, y.vid AS alias_of, y.name FROM links l JOIN entities x ON x.instance_id = l.instance_id AND x.key = l.alias_key JOIN entities y ON y.instance_id = l.instance_id AND y.key = l.canonical_key""",
    "alias_closure": f"WITH RECURSIVE {_CLOSURE} SELECT * FROM closed",
    "payload_counts": f"""WITH RECURSIVE {_EDGES}, {_RATIO}, {_ENT_ONLY}, cf AS (SELECT vid, lead(vid) OVER (PARTITION BY instance_id, sk, predicate, slot ORDER BY said_at, turn_idx, vid) AS nxt FROM (SELECT vid, instance_id, subject_key AS sk, predicate, said_at, turn_idx, {sql.slot()} AS slot FROM fr))
 SELECT 'sessions' AS payload, count(DISTINCT key) AS n FROM sessions UNION ALL SELECT 'entities', count(*) FROM seen UNION ALL SELECT 'facts', count(*) FROM fr UNION ALL SELECT lower(type), count(*) FROM e0 GROUP BY 1 UNION ALL SELECT 'next', count(*) FROM (SELECT lead(vid) OVER (PARTITION BY instance_id ORDER BY coalesce(idx, 0), vid) AS dst FROM sessions WHERE instance_id IS NOT NULL) WHERE dst IS NOT NULL
 UNION ALL SELECT 'alias', count(*) FROM links UNION ALL SELECT 'close', count(*) FROM cf WHERE nxt IS NOT NULL UNION ALL SELECT 'supersedes', count(*) FROM cf WHERE nxt IS NOT NULL""",
    "path_pairs_2": f"WITH {_INC} SELECT * FROM adj WHERE a < b",
    "path_anchor_pairs": f"""WITH {_INC}, anc AS (SELECT instance_id, 'person:user' AS a, key AS b FROM entities WHERE key NOT IN ('person:user', 'person:assistant')),
 both_ AS (SELECT anc.*, 2 AS hops FROM anc JOIN adj USING (instance_id, a, b) UNION ALL SELECT anc.*, 4 FROM anc JOIN adj p ON p.instance_id = anc.instance_id AND p.a = anc.a JOIN adj r ON r.instance_id = p.instance_id AND r.a = p.b AND r.b = anc.b) SELECT instance_id, a, b, min(hops) AS hops FROM both_ GROUP BY 1, 2, 3""",
    "paths_found": f"""WITH {_INC}, anc AS (SELECT DISTINCT instance_id, 'person:user' AS a, key AS b FROM entities WHERE key NOT IN ('person:user', 'person:assistant')), {_PATHS}
 SELECT instance_id, a, b, hops, array_to_string(ents, ' > ') AS entities, array_to_string(fs, ',') AS facts FROM pr WHERE r <= 64""",
    "question_paths": f"WITH RECURSIVE {_CASCADE}, anc AS (SELECT DISTINCT instance_id, a, b FROM two), {_PATHS} SELECT instance_id, a, b, hops, array_to_string(ents, ' > ') AS entities, array_to_string(fs, ',') AS facts FROM pr WHERE r <= 64",
    "question_mentions": f"WITH {_MENTION} SELECT instance_id, array_to_string(names, ',') AS mentions FROM m3",
    "text_resolve": f"WITH {sql.STORED}, {_MENTION}, {_TEXT} SELECT * FROM txt",
    "gate_entity": f"WITH RECURSIVE {_GATE1} SELECT instance_id, passed, coalesce(missing, '') AS missing, array_to_string(resolved, ',') AS resolved FROM g1",
    "gate_predicate": f"WITH {sql.STORED}, {_HELD}, q AS (SELECT instance_id, {sql.wanted("coalesce(question, '')")} AS wanted FROM instances) SELECT k.instance_id, k.key, {_OK2} AS passed FROM held k JOIN q ON q.instance_id = k.instance_id",
    "gate_window": f"WITH {sql.STORED}, {_WW}, {_WHITS} SELECT instance_id, key, hit AS passed FROM hits",
    "gate_cascade": f"WITH RECURSIVE {_CASCADE} SELECT * FROM cascade",
    "cascade_cost": f"WITH RECURSIVE {_CASCADE} SELECT reason, round_trips, count(*) AS n FROM cascade GROUP BY 1, 2",
    "citation_gate": f"""WITH {CITE}, bad AS (SELECT id, list(c ORDER BY pos) AS b FROM (SELECT id, instance_id, unnest(cited) AS c, generate_subscripts(cited, 1) AS pos FROM cit) x WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.instance_id = x.instance_id AND s.fact_id = x.c) GROUP BY 1),
 g AS (SELECT cit.id, instance_id, CASE WHEN starts_with(upper(answer), 'ABSTAIN') THEN 'not_in_graph' WHEN b IS NOT NULL THEN 'fabricated_citation' WHEN len(cited) = 0 THEN 'uncited_answer' ELSE '' END AS reason, b FROM cit LEFT JOIN bad ON bad.id = cit.id)
 SELECT id, instance_id, reason = '' AS passed, reason, CASE WHEN reason = 'fabricated_citation' THEN array_to_string(b, ', ') ELSE '' END AS missing FROM g""",
    "appeals": f"""WITH {sql.STORED}, {WINDOWS}, nf AS (SELECT instance_id, count(*) AS n, max(CASE WHEN length(snippet) > 240 THEN 1 ELSE 0 END) AS wide FROM stored GROUP BY 1),
 d AS (SELECT r.delivery_id AS id, w.instance_id, CASE WHEN reason IN ('uncited_answer', 'fabricated_citation') THEN reason || ' is a contract failure, not a decline' WHEN coalesce(reason, '') <> 'not_in_graph' THEN coalesce(reason, '') || ' fires before retrieval' WHEN coalesce(n, 0) = 0 THEN 'no facts in hand'
 WHEN w_start IS NULL AND coalesce(wide, 0) = 0 THEN 'nothing new to show: no window to drop and no snippet longer than the first render' ELSE '' END AS declined FROM results r JOIN win w ON w.instance_id = lower(trim(r.instance_id)) LEFT JOIN nf ON nf.instance_id = w.instance_id WHERE abstained)
 SELECT id, instance_id, declined = '' AS appeal, declined FROM d""",
}
