"""Column helpers for strings. Blank space means what Unicode calls white space, not only U+0020."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import vocab

WS = r"[\s\p{Z}​﻿]"


def strip(c: Column | str) -> Column:
    """Trim of all white space at both ends."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def fold(c: Column | str) -> Column:
    """Strip and lower case."""
    return F.lower(strip(c))


def squash(c: Column | str) -> Column:
    """Lower case without any white space: equal for values that differ in case and spacing only."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.regexp_replace(c, rf"{WS}+", ""))


def staged(df: DataFrame, **cols: Column) -> DataFrame:
    """df with cols, each computed once: a one-row generator keeps the optimizer from copying them into later filters and projections."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in cols.items()]))))


def words(c: Column) -> Column:
    """Lower-case words of ASCII letters, digits and apostrophes; other signs separate."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9']+)"), F.lit(1))


def normalized(c: Column | str) -> Column:
    """The comparison key of a name: lower case, no honorific in front, punctuation as blanks."""
    # The honorifics, and the signs that become blanks.
    t = F.regexp_replace(fold(c), r"^(?:mr|mrs|ms|miss|dr|prof|sir)\.?\s+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^\p{L}\p{M}\p{N}_\s-]", " "), r"\s+", " "))


def entity_key(kind: Column | str, name: Column | str) -> Column:
    """type:name, the forms of the two speakers brought to one key each."""
    n = normalized(name)
    kind = F.col(kind) if isinstance(kind, str) else kind
    return F.when(n.isin(vocab.SELF_FORMS), vocab.SELF_KEY).when(n.isin(vocab.ASSISTANT_FORMS), vocab.ASSISTANT_KEY).otherwise(F.concat(kind, F.lit(":"), n))


def scoped_key(instance: Column | str, key: Column | str) -> Column:
    return F.concat_ws("|", instance, key)


def _list(words_: list[str]) -> Column:
    """A constant array, as one literal."""
    return F.split(F.lit("|".join(words_)), r"\|")


def mentions(question: Column) -> Column:
    """The names a question uses, lower case, in order, and the user's key if it speaks of itself."""
    # Fixed value: the shape of a name.
    runs = F.regexp_extract_all(question, F.lit(r"(\b[A-Z][a-z]{2,}(?:\s+[A-Z][a-z]+)*)"), F.lit(1))
    low = F.transform(runs, lambda r: F.lower(r))
    starters, dropped = _list(vocab.STARTERS), _list([*vocab.CALENDAR, *vocab.SECOND_PERSON])
    first = lambda r: F.regexp_extract(r, r"^(\S+)", 1)
    bare = F.transform(low, lambda r: F.when(F.array_contains(starters, first(r)), F.regexp_replace(F.regexp_replace(r, r"^\S+\s*", ""), r"\s+", " ")).otherwise(r))
    kept = F.array_distinct(F.filter(bare, lambda r: (r != "") & ~F.array_contains(dropped, r)))
    speaks = F.arrays_overlap(words(question), _list(vocab.SELF_CUES))
    return F.when(speaks, F.concat(kept, F.array(F.lit(vocab.SELF_KEY)))).otherwise(kept)


def question_predicates(question: Column) -> Column:
    """The predicates a question may ask for, in alphabetical order; other is never asked for."""
    low = F.lower(question)
    hits = [F.when(low.rlike(vocab.cue_pattern(p)), F.lit(p)) for p in sorted(vocab.PREDICATES) if p != "other"]
    return F.array_compact(F.array(*hits))


def grounded(span: Column, text: Column) -> Column:
    """Whether a span stands in a text, white space and case aside; an empty span doesn't."""
    flat = lambda c: F.lower(F.regexp_replace(c, r"\s+", " "))
    s = F.trim(flat(F.coalesce(span, F.lit(""))))
    return (s != "") & F.contains(flat(F.coalesce(text, F.lit(""))), s)


def digits_only(c: Column) -> Column:
    """The number that the digits of a text make; null and no digits give 0."""
    return F.coalesce(F.regexp_replace(c, "[^0-9]", "").try_cast("int"), F.lit(0))
