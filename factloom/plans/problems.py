"""Queries of the general problems: instants, history, deliveries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from factloom.operators import history, instants
from factloom.sources.tables import table
from factloom.streaming import delivery


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return instants.instants(table(spark, d, "sessions"), table(spark, d, "extracted_facts"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return history.fact_versions(table(spark, d, "facts"), table(spark, d, "canon_predicates"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return delivery.dropped_deliveries(spark, delivery.replayed(spark, f"{d}/results.parquet"), files_per_batch=1)


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p4_found": p4_found}



def _parsed(source: str, month_first: str, partial: bool) -> str:
    """Columns of instants.parsed in SQL: source has id, t, tz and what else is needed."""
    i = instants
    dots = "false" if partial else month_first
    rules = [(*i.YMD, ""), (*i.BASIC, ""), (*i.CJK, ""), (*i._month_first("/"), month_first), (*i._day_first("/"), f"NOT ({month_first})"), (*i._month_first(r"\."), dots), (*i._day_first(r"\."), f"NOT ({dots})"), (*i.DAY_MONTH, ""), (*i.MONTH_DAY, "")]
    rules += [(*x, "") for x in i.PARTS] if partial else []
    cut = "CASE " + " ".join(f"WHEN regexp_matches(t, '{pat}')" + (f" AND ({only})" if only else "") + f" THEN regexp_replace(t, '{pat}', '" + re.sub(r"\$(\d)", r"\\\1", layout) + "')" for pat, layout, only in rules) + " END"
    months = "CASE lower(p[2]) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in i.MONTHS.items()) + " END"
    zones = "CASE p[8] " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in i.ABBREVIATIONS.items()) + " END"
    signed = r"^(?:UTC|GMT)?([+-])(\d{1,2}):?(\d{2})?$"
    return f"""(SELECT *, n // CASE WHEN dg BETWEEN 9 AND 10 THEN 1 WHEN dg BETWEEN 12 AND 13 THEN 1000 WHEN dg BETWEEN 15 AND 16 THEN 1000000 WHEN dg BETWEEN 18 AND 19 THEN 1000000000 END AS num, p[8] <> '' AND off IS NULL AS bad,
 CASE WHEN hr BETWEEN 0 AND 23 AND mi BETWEEN 0 AND 59 AND se BETWEEN 0 AND 59 THEN hr * 3600 + mi * 60 + se END AS secs, {_day("y", "mo", "d")} AS days FROM (
 SELECT *, CASE WHEN ap = '' THEN h WHEN h BETWEEN 1 AND 12 THEN h % 12 + CASE WHEN ap = 'pm' THEN 12 ELSE 0 END END AS hr FROM (
 SELECT *, try_cast(p[1] AS INT) AS y, coalesce(try_cast(p[2] AS INT), {months}) AS mo, try_cast(p[3] AS INT) AS d, p[4] <> '' AS clock, try_cast(p[4] AS INT) AS h, try_cast(p[5] AS INT) AS mi, coalesce(try_cast(p[6] AS INT), 0) AS se, lower(replace(p[7], '.', '')) AS ap,
 CASE WHEN regexp_matches(p[8], '{signed}') THEN CASE regexp_extract(p[8], '{signed}', 1) WHEN '-' THEN -1 ELSE 1 END * (regexp_extract(p[8], '{signed}', 2)::INT * 3600 + coalesce(try_cast(regexp_extract(p[8], '{signed}', 3) AS INT), 0) * 60) ELSE {zones} * 60 END AS off,
 try_cast(nullif(nm, '') AS BIGINT) AS n, length(replace(nm, '-', '')) AS dg FROM (SELECT *, string_split({cut}, '|') AS p, regexp_extract(t, '^(-?\\d+)(?:\\.\\d+)?$', 1) AS nm FROM {source}))))"""


def _day(y: str, mo: str, d: str) -> str:
    return f"CASE WHEN {y} BETWEEN 1 AND 9999 THEN (try_cast(format('{{:04d}}-{{:02d}}-{{:02d}}', {y}, {mo}, {d}) AS DATE) - DATE '1970-01-01')::BIGINT END"


_WALL = "CASE WHEN NOT coalesce(bad, false) THEN CASE WHEN clock THEN days * 86400 + secs ELSE days * 86400 END END"
_OFF = lambda e, z: f"(epoch(to_timestamp({e}) AT TIME ZONE {z})::BIGINT - ({e}))"
_LOCAL = f"""CASE WHEN {_OFF("l - o1", "z")} = o1 AND {_OFF("l - o2", "z")} = o2 THEN l - greatest(o1, o2) WHEN {_OFF("l - o2", "z")} = o2 AND {_OFF("l - o1", "z")} <> o1 THEN l - o2 ELSE l - o1 END"""
_AROUND = f"""{_OFF("l - 86400", "z")} AS o1, {_OFF("l + 86400", "z")} AS o2"""
_SPACE = r"[\s\p{Z}\x{200B}\x{FEFF}]+"
_P1 = f"""WITH zn AS (SELECT DISTINCT name AS zone FROM pg_timezone_names()), st AS (SELECT vid AS id, key, client_tz AS tz, regexp_replace(ts_text, '^{_SPACE}|{_SPACE}$', '', 'g') AS t, coalesce(lower(replace(client_locale, '_', '-')) = 'en-us', false) AS mf FROM sessions),
 sp AS (SELECT id, key, tz, coalesce(zone, 'UTC') AS z, coalesce(num, wall - off) AS fixed, CASE WHEN num IS NULL AND off IS NULL THEN wall END AS l FROM (SELECT *, {_WALL} AS wall FROM {_parsed("st", "mf", False)}) LEFT JOIN zn ON zone = tz),
 se AS (SELECT id, key, tz, coalesce(fixed, {_LOCAL}) AS e FROM (SELECT *, {_AROUND} FROM sp)),
 said AS (SELECT key, arg_min(tz, id) AS tz, arg_min({{'e': e}}, id) AS e FROM se WHERE key IS NOT NULL GROUP BY 1),
 ht AS (SELECT extract_id AS id, session_id, regexp_replace(valid_from_hint, '^{_SPACE}|{_SPACE}$', '', 'g') AS t FROM extracted_facts WHERE regexp_matches(valid_from_hint, '\\d')),
 hp AS (SELECT *, y IS NULL AND mo IS NOT NULL AND d IS NOT NULL AS bare, {_WALL} AS wall FROM {_parsed("ht", "true", True)} WHERE num IS NOT NULL OR mo IS NOT NULL),
 hs AS (SELECT hp.*, said.tz, said.e.e AS e, coalesce(zone, 'UTC') AS z, year(DATE '1970-01-01' + floor(said.e.e / 86400)::INT) AS yy FROM hp LEFT JOIN said ON said.key = hp.session_id LEFT JOIN zn ON zone = said.tz),
 hb AS (SELECT id, CASE WHEN {_day("yy", "mo", "d")} * 86400 - e > 86400 THEN {_day("yy - 1", "mo", "d")} * 86400 ELSE {_day("yy", "mo", "d")} * 86400 END AS e FROM hs WHERE num IS NULL AND bare),
 hl AS (SELECT id, {_LOCAL} AS e FROM (SELECT id, l, z, {_AROUND} FROM (SELECT id, z, CASE WHEN num IS NULL AND off IS NULL THEN wall END AS l FROM hs WHERE num IS NULL AND NOT bare AND clock AND off IS NULL))),
 ho AS (SELECT id, coalesce(num, wall - off, wall) AS e FROM hp WHERE num IS NOT NULL OR (NOT bare AND NOT (clock AND off IS NULL))),
 every AS (SELECT 'session' AS origin, id, e FROM se UNION ALL SELECT 'hint', id, e FROM hb UNION ALL SELECT 'hint', id, e FROM hl UNION ALL SELECT 'hint', id, e FROM ho) SELECT origin, id AS record_id, e::BIGINT AS epoch_s FROM every WHERE e IS NOT NULL"""

ORACLE = {
    "p1_found": _P1,
    "p3_found": rf"""WITH u AS (SELECT subject_vid, predicate, coalesce(valid_from, asserted_at) AS s, coalesce(valid_to, 0) AS e, coalesce(lower(regexp_replace(value_text, '[\s\p{{Z}}]+', '', 'g')), chr(1)) AS v, asserted_at, received_at, log_id
 FROM facts WHERE predicate IN (SELECT predicate FROM canon_predicates WHERE single_valued)),
 one AS (SELECT * FROM u WHERE s IS NOT NULL QUALIFY row_number() OVER (PARTITION BY subject_vid, predicate, s ORDER BY asserted_at DESC NULLS LAST, received_at DESC, log_id DESC) = 1),
 p AS (SELECT subject_vid, predicate, s, v, least(CASE WHEN e <> 0 THEN e END, lead(s) OVER (PARTITION BY subject_vid, predicate ORDER BY s)) AS until FROM one),
 held AS (SELECT *, CASE WHEN lag(v) OVER w = v AND lag(until) OVER w = s THEN 0 ELSE 1 END AS fresh FROM p WHERE until IS NULL OR until > s WINDOW w AS (PARTITION BY subject_vid, predicate ORDER BY s)),
 runs AS (SELECT *, sum(fresh) OVER (PARTITION BY subject_vid, predicate ORDER BY s) AS run FROM held)
 SELECT subject_vid, predicate, min(s) AS valid_from, CASE WHEN bool_or(until IS NULL) THEN 0 ELSE max(until) END AS valid_to FROM runs GROUP BY subject_vid, predicate, run""",
    "p4_found": r"""SELECT delivery_id FROM results QUALIFY row_number() OVER (PARTITION BY run_id, arm, lower(regexp_replace(instance_id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) ORDER BY received_at, delivery_id) > 1""",
}
