"""Instants in mixed notations and zones, brought to one UTC epoch second.

The text is cut by a list of patterns into year|month|day|hour|minute|second|am-pm|zone. A stated offset or zone gives the
instant by arithmetic. A wall-clock time without one is joined, as of its local time, to the offset intervals of the client's
zone, exploded to rows by zone and year: two intervals that match mean an hour that occurs twice (the earlier instant is taken), none
a time the clock skipped (moved on by the length of the gap, which is the offset before it), one gives the offset.
The calendar repeats every 400 years, and the zones' last rules with it: later years are looked up in the years they repeat.

Nulls, blanks, words, impossible dates and unknown zone names in the text give null. A null or unknown client zone counts as UTC.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import staged, strip
from factloom.session import written

# Month names in English and German, by number.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
    "januar": 1, "februar": 2, "märz": 3, "mai": 5, "juni": 6, "juli": 7, "oktober": 10, "dezember": 12, "mrz": 3, "okt": 10, "dez": 12,
}

# Zone abbreviations, in minutes east of UTC.
ABBREVIATIONS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "BST": 60, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?"
_AP = r"\s*([AaPp]\.?[Mm]\.?)?"
_ZONE = r"\s*(Z|UTC[+-]\d{1,2}(?::?\d{2})?|GMT[+-]\d{1,2}(?::?\d{2})?|[+-]\d{2}:?\d{2}|[+-]\d{2}|[A-Z]{2,5})?(?:\s*\([A-Za-z ]+\))?"
_CLOCK = rf"{_TIME}{_AP}(?:\s*Uhr|\s*h)?{_ZONE}"
_MONTH = r"(\p{L}{3,9})\.?"

YMD = (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:\s*\(\p{{L}}+\.?\))?(?:[Tt\s]\s*{_CLOCK})?$", "$1|$2|$3|$4|$5|$6|$7|$8")
BASIC = (rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[Tt\s](\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,]\d+)?{_ZONE})?$", "$1|$2|$3|$4|$5|$6||$7")
CJK = (r"^(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日(?:\s*(?:\p{L}+\s+)?(\d{1,2})[時时:]\s*(\d{1,2})分?(?:(\d{1,2})秒)?)?$", "$1|$2|$3|$4|$5|$6||")
AB_YEAR = r"^(\d{1,2})%s(\d{1,2})%s(\d{4})(?:,?\s+(?:at\s+|um\s+)?" + _CLOCK + r")?$"
DAY_MONTH = (rf"^(?:\p{{L}}+\.?,?\s+)?(\d{{1,2}})(?:\.|st|nd|rd|th)?[-\s]\s*{_MONTH}[-,\s]\s*(\d{{4}})(?:,?\s+(?:at\s+|um\s+)?{_CLOCK})?$", "$3|$2|$1|$4|$5|$6|$7|$8")
MONTH_DAY = (rf"^(?:\p{{L}}+\.?,\s+)?{_MONTH}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(?:,?\s+(?:at\s+)?{_CLOCK})?$", "$3|$1|$2|$4|$5|$6|$7|$8")
# Only in hints: parts of dates.
PARTS = [
    (r"^(\d{4})[-/.](\d{1,2})$", "$1|$2|1|||||"),
    (r"^(\d{4})$", "$1|1|1|||||"),
    (rf"^{_MONTH},?\s+(\d{{4}})$", "$2|$1|1|||||"),
    (r"^(\d{1,2})/(\d{1,2})$", "|$1|$2|||||"),
    (r"^(\d{1,2})\.(\d{1,2})\.?$", "|$2|$1|||||"),
    (rf"^{_MONTH}\s+(\d{{1,2}})(?:st|nd|rd|th)?$", "|$1|$2|||||"),
    (rf"^(\d{{1,2}})(?:\.|st|nd|rd|th)?\s+{_MONTH}$", "|$2|$1|||||"),
]


def _month_first(sep: str) -> tuple[str, str]:
    return AB_YEAR % (sep, sep), "$3|$1|$2|$4|$5|$6|$7|$8"


def _day_first(sep: str) -> tuple[str, str]:
    return AB_YEAR % (sep, sep), "$3|$2|$1|$4|$5|$6|$7|$8"


def _cut(c: Column, rules: list[tuple[str, str, Column | None]]) -> Column:
    out = None
    for pattern, layout, only in rules:
        hit = c.rlike(pattern) if only is None else c.rlike(pattern) & only
        out = F.when(hit, F.regexp_replace(c, pattern, layout)) if out is None else out.when(hit, F.regexp_replace(c, pattern, layout))
    return F.split(out, r"\|")


def parsed(df: DataFrame, text: str, month_first: Column, partial: bool) -> DataFrame:
    """Adds epoch (a stated number), y, mo, d, clock (has one), secs (of the day), off (stated, in seconds), bad_zone.

    month_first says for each row how a/b/yyyy is read; partial also reads dates without day or year.
    """
    df = staged(df, _t=strip(text))
    dots = F.lit(False) if partial else month_first
    rules = [(*YMD, None), (*BASIC, None), (*CJK, None), (*_month_first("/"), month_first), (*_day_first("/"), ~month_first), (*_month_first(r"\."), dots), (*_day_first(r"\."), ~dots), (*DAY_MONTH, None), (*MONTH_DAY, None)]
    if partial:
        rules += [(*p, None) for p in PARTS]
    months = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    zones = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    df = staged(df, _p=_cut(F.col("_t"), rules), _n=F.regexp_extract("_t", r"^(-?\d+)(?:\.\d+)?$", 1))

    def part(i: int) -> Column:
        return F.get("_p", F.lit(i))

    def num(i: int) -> Column:
        return part(i).try_cast("int")

    signed = r"^(?:UTC|GMT)?([+-])(\d{1,2}):?(\d{2})?$"
    df = staged(df, y=num(0), mo=F.coalesce(num(1), F.try_element_at(months, F.lower(part(1)))), d=num(2), clock=part(3) != "", _h=num(3), _m=num(4), _s=F.coalesce(num(5), F.lit(0)), _ap=F.lower(F.regexp_replace(part(6), r"\.", "")), _zone=part(7),
                _sign=F.regexp_extract(part(7), signed, 1), _zh=F.regexp_extract(part(7), signed, 2).try_cast("int"), _zm=F.regexp_extract(part(7), signed, 3).try_cast("int"), _digits=F.length(F.regexp_replace("_n", "-", "")), _number=F.col("_n").try_cast("bigint"))
    number, ap, h = F.col("_number"), F.col("_ap"), F.col("_h")
    hour = F.when(ap == "", h).when(h.between(1, 12), h % 12 + F.when(ap == "pm", 12).otherwise(0))
    unit = F.when(F.col("_digits").between(9, 10), 1).when(F.col("_digits").between(12, 13), 1000).when(F.col("_digits").between(15, 16), 1000000).when(F.col("_digits").between(18, 19), 1000000000)
    secs = F.when(hour.between(0, 23) & F.col("_m").between(0, 59) & F.col("_s").between(0, 59), hour * 3600 + F.col("_m") * 60 + F.col("_s"))
    offset = F.when(F.col("_sign") != "", F.when(F.col("_sign") == "-", -1).otherwise(1) * (F.col("_zh") * 3600 + F.coalesce("_zm", F.lit(0)) * 60)).otherwise(F.try_element_at(zones, F.col("_zone")) * 60)
    df = staged(df, epoch=F.floor(number / unit).cast("bigint"), secs=secs, off=offset)
    return df.withColumn("bad_zone", (F.col("_zone") != "") & F.col("off").isNull()).drop("_t", "_p", "_n", "_h", "_m", "_s", "_ap", "_zone", "_sign", "_zh", "_zm", "_digits", "_number")


def day_number(y: Column, mo: Column, d: Column) -> Column:
    """Days since 1970-01-01, null for an impossible date; independent of the session's zone and ANSI mode."""
    return F.unix_date(F.when(y.between(1, 9999), F.format_string("%04d-%02d-%02d", y, mo, d).try_cast("date"))).cast("bigint")


#: Before FIRST_YEAR every zone keeps its local mean time; from REPEATS on every zone follows its last rule, year by year.
FIRST_YEAR, REPEATS = 1800, 2100
CYCLE_YEARS, CYCLE_S = 400, 146_097 * 86_400


def _offsets(zone: str, year: int) -> list[tuple[int, int, int]]:
    """lo, hi, offset of the wall-clock intervals [lo, hi) of one zone around one year."""
    try:
        rules = ZoneInfo(zone)
    except Exception:  # unknown names, empty strings, paths
        return [(-(2**62), 2**62, 0)]

    def at(sec: int) -> int:
        return int(datetime.fromtimestamp(sec, UTC).astimezone(rules).utcoffset().total_seconds())

    begin = int(datetime(year, 1, 1, tzinfo=UTC).timestamp()) - 40 * 86400
    end = int(datetime(year, 12, 31, tzinfo=UTC).timestamp()) + 40 * 86400
    cuts, step, t, off = [], 6 * 3600, begin, at(begin)
    while t < end:
        nxt = t + step
        if (new := at(nxt)) != off:
            lo, hi = t, nxt
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if at(mid) == off else (lo, mid)
            cuts.append((hi, off, new))
            off = new
        t = nxt
    out, lo = [], -(2**62)
    for when, before, after in cuts:
        out.append((lo, when + before, before))
        lo = when + after
    return [*out, (lo, 2**62, off)]


def zone_intervals(pairs: DataFrame) -> DataFrame:
    """zone, year, lo, hi, off: a row for each wall-clock interval. pairs: distinct (zone, year)."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(z, y, *i) for z, y in zip(b.zone, b.year, strict=True) for i in _offsets(z, int(y))], columns=["zone", "year", "lo", "hi", "off"])

    return pairs.mapInPandas(build, "zone string, year int, lo bigint, hi bigint, off int")


def zone_periods(intervals: DataFrame) -> DataFrame:
    """zone, year, start, until, matches, off: the wall-clock time of each zone and year cut where an interval begins or ends.

    Within a period the same intervals match: of two the larger offset gives the earlier instant, where none does the offset before holds.
    """
    edge = Window.partitionBy("zone", "year").orderBy("start")
    cuts = intervals.select("zone", "year", F.explode(F.array("lo", "hi")).alias("start")).distinct()
    cuts = cuts.withColumn("until", F.lead("start").over(edge)).where("until is not null")
    j = cuts.join(intervals, ["zone", "year"])
    fits, past = (F.col("lo") <= F.col("start")) & (F.col("start") < F.col("hi")), F.col("hi") <= F.col("start")
    g = j.groupBy("zone", "year", "start", "until").agg(F.count_if(fits).cast("int").alias("matches"), F.max(F.when(fits, F.col("off"))).alias("_in"), F.max_by("off", F.when(past, F.col("hi"))).alias("_before"))
    return g.select("zone", "year", "start", "until", "matches", F.coalesce("_in", "_before").alias("off"))


def localised(df: DataFrame, local: str, zone: str) -> DataFrame:
    """Adds epoch_s and matches (the number of intervals that hold the local time) to rows of wall-clock seconds.

    An as-of join: of the periods of its zone and year, the one that a local time falls in. The table of periods has a few rows for
    each IANA zone (about 600, other names counting as UTC) and each of 700 years, whatever the number of rows is; it is broadcast
    if it has no more than PERIODS.
    """
    spark = df.sparkSession
    known = F.broadcast(spark.createDataFrame([(z,) for z in sorted(_names())], "name string"))  # the time zone database's
    t = F.col(local)
    year = F.year(F.date_from_unix_date(F.floor(t / 86400).cast("int")))
    cycles = F.when(year >= REPEATS, F.floor((year - REPEATS) / CYCLE_YEARS)).otherwise(0)
    df = df.join(known, F.col(zone) == F.col("name"), "left")
    df = staged(df, _z=F.coalesce("name", F.lit("UTC")), _y=F.greatest(year - cycles * CYCLE_YEARS, F.lit(FIRST_YEAR)).cast("int"), _t=t - cycles * CYCLE_S).drop("name")
    pairs = df.where(t.isNotNull()).select(F.col("_z").alias("zone"), F.col("_y").alias("year")).distinct()
    periods = written(zone_periods(zone_intervals(pairs)), "zones").select(F.col("zone").alias("_z"), F.col("year").alias("_y"), "start", "until", "matches", F.col("off").alias("_off"))
    near = F.broadcast(periods) if periods.count() <= PERIODS else periods
    in_it = (F.col("l._z") == F.col("p._z")) & (F.col("l._y") == F.col("p._y")) & (F.col("p.start") <= F.col("l._t")) & (F.col("l._t") < F.col("p.until"))
    out = df.alias("l").join(near.alias("p"), in_it, "left")
    return out.select(*[F.col(f"l.{c}") for c in df.columns if c not in ("_z", "_y", "_t")], (F.col(f"l.{local}") - F.col("p._off")).cast("bigint").alias("epoch_s"), F.when(F.col(f"l.{local}").isNotNull(), F.col("p.matches")).alias("matches"))


#: Periods that are broadcast: those of 600 zones in 700 years are fewer.
PERIODS = 2_000_000


def _names() -> set[str]:
    import zoneinfo

    return zoneinfo.available_timezones()


def _plan(df: DataFrame, zone: str) -> DataFrame:
    """From the parsed parts: fixed (an epoch that needs no zone) or local with zone."""
    days = day_number(F.col("y"), F.col("mo"), F.col("d"))
    wall = F.when(F.col("clock"), days * 86400 + F.col("secs")).otherwise(days * 86400)
    df = staged(df, _wall=F.when(~F.coalesce("bad_zone", F.lit(False)), wall))
    return staged(
        df,
        fixed=F.coalesce(F.col("epoch"), F.col("_wall") - F.col("off")),
        local=F.when(F.col("epoch").isNull() & F.col("off").isNull(), F.col("_wall")),
        zone=F.coalesce(F.col(zone), F.lit("UTC")),
    )


def session_instants(sessions: DataFrame) -> DataFrame:
    """vid, key, client_tz, epoch_s, matches of each session; epoch_s null where ts_text is unusable."""
    s = sessions.select("vid", "key", "client_tz", "client_locale", "ts_text")
    month_first = F.coalesce(F.lower(F.regexp_replace("client_locale", "_", "-")) == "en-us", F.lit(False))
    # Parsed once: the intervals are made for the zones and years that occur, which reads the parsed rows a second time.
    s = written(_plan(parsed(s, "ts_text", month_first, partial=False), "client_tz").select("vid", "key", "client_tz", "fixed", "local", "zone"), "instants")
    return localised(s, "local", "zone").select("vid", "key", "client_tz", F.coalesce("fixed", "epoch_s").alias("epoch_s"), "matches")


def hint_instants(facts: DataFrame, instants: DataFrame) -> DataFrame:
    """extract_id, epoch_s, matches of each hint. instants: of session_instants.

    Only hints with a clock time but no zone, and those without a year, are joined to their session; the others never shuffle.
    """
    f = facts.select("extract_id", "session_id", "valid_from_hint").where(F.col("valid_from_hint").rlike(r"\d"))
    f = parsed(f, "valid_from_hint", F.lit(True), partial=True).withColumns({"yearless": F.col("y").isNull() & F.col("mo").isNotNull() & F.col("d").isNotNull()}).drop("valid_from_hint")
    f = written(f.where(F.col("epoch").isNotNull() | F.col("mo").isNotNull()), "instants")  # read by each of the three ways below
    needs = F.col("epoch").isNull() & (F.col("yearless") | (F.col("clock") & F.col("off").isNull()))
    own = _plan(f.where(~needs).withColumn("_tz", F.lit("UTC")), "_tz").select("extract_id", F.coalesce("fixed", "local").alias("epoch_s"), F.lit(None).cast("int").alias("matches"))
    # One row a session even if a session row is repeated.
    said = instants.where(F.col("key").isNotNull()).groupBy(F.col("key").alias("session_id")).agg(F.min_by(F.struct("client_tz", "epoch_s"), F.struct("vid", "epoch_s")).alias("said"))
    tied = f.where(needs).join(said, "session_id", "left").withColumns({"_tz": F.col("said.client_tz"), "_said": F.col("said.epoch_s")})
    year = F.year(F.date_from_unix_date(F.floor(F.col("_said") / 86400).cast("int")))
    this = day_number(year, F.col("mo"), F.col("d")) * 86400
    back = day_number(year - 1, F.col("mo"), F.col("d")) * 86400
    bare = tied.where("yearless").select("extract_id", F.when(this - F.col("_said") > 86400, back).otherwise(this).alias("epoch_s"), F.lit(None).cast("int").alias("matches"))
    timed = localised(_plan(tied.where(~F.col("yearless")), "_tz").select("extract_id", "local", "zone"), "local", "zone").select("extract_id", "epoch_s", "matches")
    return own.unionByName(bare).unionByName(timed)


def instants(sessions: DataFrame, facts: DataFrame) -> DataFrame:
    """origin, record_id, epoch_s of every usable instant."""
    at = written(session_instants(sessions), "instants")
    both = at.select(F.lit("session").alias("origin"), F.col("vid").alias("record_id"), "epoch_s").unionByName(hint_instants(facts, at).select(F.lit("hint").alias("origin"), F.col("extract_id").alias("record_id"), "epoch_s"))
    return both.where(F.col("epoch_s").isNotNull())
