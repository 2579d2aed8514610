"""Models as functions on columns: completions and embeddings behind one interface, with a cache table keyed by content."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPLIES = "key string, reply string, error string"
VECTORS = "key string, embedding array<double>"
# Tries of a call, the seconds before the second of them (doubled each time), and statuses that waiting won't mend.
TRIES, DELAY_S = 8, 1.0
FINAL = [400, 401, 403, 405, 410, 413, 415, 422]
#: What a question is prefixed with before it is embedded; passages are not.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


def request_key(*parts: str):
    """Hash of a request: equal requests have one answer."""
    return F.sha2(F.encode(F.to_json(F.struct(*parts)), "utf-8"), 256)


def called(fn: Callable, what, tries: int = TRIES, delay_s: float = DELAY_S):
    """fn(what), tried again after a doubling delay; an error whose status names a client's mistake is not tried again."""
    for n in range(tries):
        try:
            return fn(what)
        except Exception as e:
            if n == tries - 1 or getattr(e, "status_code", None) in FINAL:
                raise
            time.sleep(delay_s * 2**n)


def _fresh(new: DataFrame, one: Callable, schema: str, tries: int, delay_s: float) -> DataFrame:
    """key and result, or error, of each (key, prompt); schema has a third column for it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, p in zip(b["key"], b["prompt"], strict=True):
                try:
                    rows.append((k, called(one, p, tries, delay_s), None))
                except Exception as e:  # a dead letter, not a dead job
                    rows.append((k, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return new.mapInPandas(run, schema)


def completed(requests: DataFrame, cache: DataFrame, complete: Callable[[str], str], tries: int = TRIES, delay_s: float = DELAY_S) -> DataFrame:
    """REPLIES of the requests (prompt) that the cache (key, reply) does not have: what the cache is to be extended by."""
    new = requests.select(request_key("prompt").alias("key"), "prompt").join(cache.select("key"), "key", "left_anti").groupBy("key").agg(F.min("prompt").alias("prompt"))
    return _fresh(new, complete, REPLIES, tries, delay_s)


def answered(requests: DataFrame, cache: DataFrame, complete: Callable[[str], str], tries: int = 1, delay_s: float = DELAY_S) -> DataFrame:
    """requests (id, prompt) with their reply: from the cache (key, reply) where it is there, else by complete, once a request.

    A call that raises at every try gives a null reply and its error, and doesn't end the job.
    """
    known = cache.select("key", "reply", F.lit(None).cast("string").alias("error"))
    fresh = completed(requests, cache, complete, tries, delay_s)
    return requests.withColumn("key", request_key("prompt")).join(known.unionByName(fresh), "key", "left").select("id", "prompt", "reply", "error")


class Cache:
    """Replies or vectors in a versioned table: what is asked for again is read, fresh results are written back before they are used."""

    def __init__(self, store, name: str, schema: str = REPLIES):
        self.store, self.name, self.schema = store, name, schema

    def table(self) -> DataFrame:
        df = self.store.read(self.name)
        return self.store.spark.createDataFrame([], self.schema) if df is None else df

    def answered(self, requests: DataFrame, complete: Callable[[str], str], tries: int = TRIES, delay_s: float = DELAY_S) -> DataFrame:
        """As answered(), with successful replies kept; failed calls are reported and asked again the next time."""
        old = self.table()
        fresh = completed(requests, old, complete, tries, delay_s)
        self.store.write(f"{self.name}_last", fresh)
        last = self.store.read(f"{self.name}_last")
        self.store.write(self.name, old.unionByName(last.where("reply is not null")))
        known = self.table().unionByName(last.where("reply is null"))
        return requests.withColumn("key", request_key("prompt")).join(known, "key", "left").select("id", "prompt", "reply", "error")

    def embedded(self, texts: DataFrame, embed: Callable[[str], list[float]], query: bool = False) -> DataFrame:
        """texts (id, text) with their normalised embedding; vectors are kept. Questions are prefixed, passages are not."""
        t = texts.select("id", F.concat(F.lit(QUERY_PREFIX if query else ""), F.coalesce("text", F.lit(""))).alias("prompt")).withColumn("key", request_key("prompt"))
        old = self.table()
        new = t.select("key", "prompt").join(old.select("key"), "key", "left_anti").groupBy("key").agg(F.min("prompt").alias("prompt"))
        fresh = _fresh(new, lambda p: normalised(embed(p)), "key string, embedding array<double>, error string", 1, 0).where("embedding is not null").select("key", "embedding")
        self.store.write(self.name, old.unionByName(fresh))
        return t.join(self.table(), "key", "left").select("id", "embedding")


def normalised(v: list[float]) -> list[float]:
    length = sum(x * x for x in v) ** 0.5
    return [x / length for x in v] if length else list(v)


def hashed_words(text: str, size: int = 256) -> list[float]:
    """The stand-in for an embedding model: counts of hashed words."""
    out = [0.0] * size
    for w in text.lower().split():
        out[zlib.crc32(w.strip(".,;:!?()").encode()) % size] += 1.0
    return out
