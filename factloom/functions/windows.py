"""Time windows of questions: half-open intervals in epoch seconds, an end of 0 meaning open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import staged
from factloom.functions.vocab import DAY, MONTHS

_YEAR = r"(?:19|20)\d{2}"
_MONTH = "|".join(sorted(MONTHS, key=len, reverse=True))
# The phrases that name a window, in the order in which they are tried, over lower-cased text.
ISO = rf"\b(?:on|as of)\s+({_YEAR})-(\d{{1,2}})-(\d{{1,2}})\b"
BEFORE = rf"\b(?:before|prior to|up to|until|earlier than)\s+(?:the\s+)?({_YEAR})\b"
SINCE = rf"\b(?:since|after|from)\s+(?:the\s+)?({_YEAR})\b"
MONTH_YEAR = rf"\b({_MONTH})\s+(?:of\s+)?({_YEAR})\b"
IN_YEAR = rf"\b(?:in|during|back in|around|as of|throughout|over|of)\s+(?:the\s+)?(?:year\s+)?({_YEAR})\b"
LAST_UNIT = r"\b(?:last|previous|past)\s+(year|month|week)\b"
AGO = r"\b(\d{1,2}|an?|one|two|three|four|five)\s+(year|month|week|day)s?\s+ago\b"
COUNTS = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5}


def _date(y: Column, m: Column, d: Column) -> Column:
    """Epoch of a date, null if it is impossible."""
    return F.unix_date(F.format_string("%04d-%02d-%02d", y, m, d).try_cast("date")).cast("bigint") * DAY


def _month(months: Column) -> Column:
    """Epoch of the first of a month counted from year 0."""
    return _date(F.floor(months / 12).cast("int"), (months % 12 + 1).cast("int"), F.lit(1))


def with_window(df: DataFrame, question: str = "question", asked_at: str = "asked_at") -> DataFrame:
    """df with w_start, w_end and w_phrase, null where the question names no window (or an impossible day)."""
    df = staged(df, _q=F.lower(F.coalesce(F.col(question), F.lit(""))))
    q = F.col("_q")
    get = lambda p, i: F.regexp_extract(q, p, i)
    num = lambda p, i: get(p, i).try_cast("int")
    rule = F.when(q.rlike(ISO), 1).when(q.rlike(BEFORE), 2).when(q.rlike(SINCE), 3).when(q.rlike(MONTH_YEAR), 4).when(q.rlike(IN_YEAR), 5).when(F.col(asked_at).isNull(), 0).when(q.rlike(LAST_UNIT), 6).when(q.rlike(AGO), 7).otherwise(0)
    df = staged(df, _rule=rule)
    r = F.col("_rule")
    year = F.when(r == 1, num(ISO, 1)).when(r == 2, num(BEFORE, 1)).when(r == 3, num(SINCE, 1)).when(r == 4, num(MONTH_YEAR, 2)).when(r == 5, num(IN_YEAR, 1))
    months = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    counts = F.create_map(*[F.lit(x) for kv in COUNTS.items() for x in kv])
    n = F.when(r == 6, 1).when(r == 7, F.coalesce(num(AGO, 1), F.try_element_at(counts, get(AGO, 1))))
    unit = F.when(r == 6, get(LAST_UNIT, 1)).when(r == 7, get(AGO, 2))
    phrase = F.element_at(F.array(*[F.regexp_extract(q, p, 0) for p in (ISO, BEFORE, SINCE, MONTH_YEAR, IN_YEAR, LAST_UNIT, AGO)]), F.when(r > 0, r))
    df = staged(df, _y=year, _mo=F.when(r == 1, num(ISO, 2)).when(r == 4, F.try_element_at(months, get(MONTH_YEAR, 1))), _d=F.when(r == 1, num(ISO, 3)), _n=n, _u=unit, _phrase=phrase, _a=F.timestamp_seconds(F.coalesce(F.col(asked_at), F.lit(0))))
    y, mo, u, asked = F.col("_y"), F.col("_mo"), F.col("_u"), F.col(asked_at)
    one = F.lit(1)
    span = F.when(u == "week", 7 * DAY).otherwise(DAY)
    then = F.year("_a") * 12 + F.month("_a") - 1 - F.col("_n")
    rolled = asked - span * (F.col("_n") - 1)
    relative = lambda plus: F.when(u == "year", _date(F.year("_a") - F.col("_n") + plus, one, one)).when(u == "month", _month(then + plus)).otherwise(rolled - span * (1 - plus))
    start = F.when(r == 1, _date(y, mo, F.col("_d"))).when(r == 2, F.lit(0)).when(r == 3, _date(y, one, one)).when(r == 4, _date(y, mo, one)).when(r == 5, _date(y, one, one)).when(r > 5, relative(0))
    end = F.when(r == 1, _date(y, mo, F.col("_d")) + DAY).when(r == 2, _date(y, one, one)).when(r == 3, F.lit(0)).when(r == 4, _month(y * 12 + mo)).when(r == 5, _date(y + 1, one, one)).when(r > 5, relative(1))
    df = staged(df, w_start=start.cast("bigint"), w_end=end.cast("bigint"))
    return df.withColumn("w_phrase", F.when(F.col("w_start").isNotNull(), F.col("_phrase"))).drop("_q", "_rule", "_y", "_mo", "_d", "_n", "_u", "_phrase", "_a")


def day_label(epoch: Column) -> Column:
    return F.date_format(F.date_from_unix_date(F.floor(epoch / DAY).cast("int")), "yyyy-MM-dd")


def window_label() -> Column:
    """start..end, or start..onwards."""
    return F.concat(day_label(F.col("w_start")), F.lit(".."), F.when(F.col("w_end") == 0, "onwards").otherwise(day_label(F.col("w_end"))))


def overlaps(valid_from: Column, valid_to: Column, start: Column, end: Column) -> Column:
    """Whether a validity period meets a window; null bounds of the period count as 0."""
    a, b = F.coalesce(valid_from, F.lit(0)), F.coalesce(valid_to, F.lit(0))
    return ((b == 0) | (b > start)) & ((end == 0) | (a < end))


def at_time(valid_from: Column, valid_to: Column, when: Column) -> Column:
    return overlaps(valid_from, valid_to, when, when + 1)
