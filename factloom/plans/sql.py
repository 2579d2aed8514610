"""SQL pieces that several DuckDB oracles share."""

from __future__ import annotations

from factloom.functions import vocab


def strings(xs) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^[\s\p{{Z}}\x{{200B}}\x{{FEFF}}]+|[\s\p{{Z}}\x{{200B}}\x{{FEFF}}]+$', '', 'g')"


def fold(c: str) -> str:
    return f"lower({strip(c)})"


def normalized(c: str) -> str:
    t = rf"regexp_replace({fold(c)}, '^(?:mr|mrs|ms|miss|dr|prof|sir)\.?\s+', '')"
    return rf"trim(regexp_replace(regexp_replace({t}, '[^\p{{L}}\p{{M}}\p{{N}}_\s-]', ' ', 'g'), '\s+', ' ', 'g'))"


def entity_key(kind: str, name: str) -> str:
    n = normalized(name)
    return f"CASE WHEN {n} IN ({strings(vocab.SELF_FORMS)}) THEN '{vocab.SELF_KEY}' WHEN {n} IN ({strings(vocab.ASSISTANT_FORMS)}) THEN '{vocab.ASSISTANT_KEY}' ELSE {kind} || ':' || {n} END"


def nid(kind: str, key: str) -> str:
    return f"('0x' || substr(sha256('{kind}:' || {key}), 1, 15))::BIGINT"


def words(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[a-z0-9'']+')"


def slot() -> str:
    v = fold("coalesce(value_text, '')")
    counted = strip(f"regexp_replace({v}, '{vocab.LEADING_COUNT}', '')")
    return f"CASE WHEN predicate IN ({strings(vocab.FUNCTIONAL)}) THEN '' WHEN predicate = 'quantity' THEN coalesce(nullif({counted}, ''), {v}) ELSE {v} END"


def object_type() -> str:
    return "CASE predicate " + " ".join(f"WHEN '{p}' THEN '{t}'" for p, t in vocab.OBJECT_TYPES.items()) + " ELSE 'thing' END"


def wanted(question: str) -> str:
    """A sorted list of the predicates that a question asks for."""
    items = ", ".join(f"CASE WHEN regexp_matches(lower({question}), '{vocab.cue_pattern(p).replace(chr(39), chr(39) * 2)}') THEN '{p}' END" for p in sorted(vocab.PREDICATES) if p != "other")
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


#: The stored facts: of each vid the largest asserted_at, ties to the first log_id.
STORED = "stored AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY vid ORDER BY asserted_at DESC NULLS LAST, log_id) = 1)"
CHAIN = f"""{STORED}, chain AS (SELECT *, lead(vid) OVER w AS nxt, lead(coalesce(valid_from, 0)) OVER w AS nvf FROM (SELECT *, {slot()} AS slot FROM stored)
 WINDOW w AS (PARTITION BY instance_id, subject_vid, predicate, slot ORDER BY asserted_at, coalesce(turn_idx, 0), vid))"""
SCORED = r"""last AS (SELECT * REPLACE (lower(trim(regexp_replace(instance_id, '\s+', ' ', 'g'))) AS instance_id) FROM results),
rows_ AS (SELECT run_id, arm, instance_id, answer, abstained, reason, fact_count, round_trips, latency_ms FROM last QUALIFY row_number() OVER (PARTITION BY run_id, arm, instance_id ORDER BY received_at DESC, delivery_id DESC) = 1),
scored AS (SELECT r.run_id, r.arm, r.instance_id, i.question_type AS category, i.is_abstention AS gold_abstention, r.abstained, coalesce(r.reason, '') AS reason,
 coalesce(CASE WHEN i.is_abstention THEN r.abstained WHEN r.abstained THEN false ELSE coalesce(i.answer, '') <> '' AND contains(lower(coalesce(r.answer, '')), lower(coalesce(i.answer, ''))) END, false) AS correct,
 (r.fact_count * 20)::BIGINT AS prompt_tokens, (length(coalesce(r.answer, '')) // 4)::BIGINT AS completion_tokens, r.round_trips, r.latency_ms, false AS appealed, false AS appeal_won, coalesce(r.arm = 'full_context' AND r.fact_count * 20 > 600, false) AS overflow
 FROM rows_ r JOIN instances i ON i.instance_id = r.instance_id),
wide AS (SELECT * FROM scored UNION ALL SELECT * REPLACE ('ALL' AS category) FROM scored)"""
