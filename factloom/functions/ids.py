"""Deterministic ids: 60 bits of a SHA-256 over a kind and a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nid(kind: str, key: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.encode(F.concat(F.lit(f"{kind}:"), key), "utf-8"), 256), 1, 15), 16, 10).cast("bigint")


def entity_id(instance: Column | str, key: Column | str) -> Column:
    return nid("E", F.concat_ws("|", _col(instance), _col(key)))


def session_id(instance: Column | str, key: Column | str) -> Column:
    return nid("S", F.concat_ws("|", _col(instance), _col(key)))


def fact_id(key: Column | str) -> Column:
    return nid("F", _col(key))


def edge_id(src: Column | str, kind: str, dst: Column | str) -> Column:
    return nid("R", F.concat_ws("|", _col(src).cast("string"), F.lit(kind), _col(dst).cast("string")))


def idempotency_key(*parts: Column | str) -> Column:
    """SHA-256 of the parts joined by a bar; a null part counts as empty."""
    return F.sha2(F.encode(F.concat_ws("|", *[F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts]), "utf-8"), 256)


def row_digest(*parts: Column | str) -> Column:
    """60 bits of the SHA-256 of a row, as a number."""
    return F.conv(F.substring(idempotency_key(*parts), 1, 15), 16, 10).cast("bigint")


def batch_keys(rows: DataFrame, batch: str, columns: list[str], name: str) -> DataFrame:
    """batch, key: a name and a digest of how many rows a batch has and of the sum of their digests, whatever their order.

    Equal batches have one key, and a key can't stand for two contents; it is reduced with partial aggregation.
    """
    total = F.sum(row_digest(*columns).cast("decimal(38,0)")).cast("string")
    return rows.groupBy(batch).agg(F.concat(F.lit(f"{name}."), F.sha2(F.encode(F.concat_ws("|", F.count("*").cast("string"), total), "utf-8"), 256)).alias("key"))


def session_key(messages: Column | str) -> Column:
    """A session's id from its messages (an array of structs), so that adding them again is the same session."""
    return F.concat(F.lit("mem-"), F.substring(F.sha2(F.encode(F.to_json(_col(messages)), "utf-8"), 256), 1, 16))


def literal(key: Column | str) -> Column:
    """A key as a quoted literal, backslashes and quotes escaped; one with a control character is refused."""
    k = _col(key)
    quoted = F.concat(F.lit("'"), F.regexp_replace(F.regexp_replace(k, r"\\", r"\\\\"), "'", r"\\'"), F.lit("'"))
    return F.when(k.rlike(r"[\x00-\x1f\x7f]"), F.raise_error(F.concat(F.lit("control character in anchor key: "), F.to_json(F.struct(k.alias("key")))))).otherwise(quoted)


def pair_count(n: Column | str) -> Column:
    """How many unordered pairs n anchors make."""
    return (_col(n) * (_col(n) - 1) / 2).cast("bigint")
