"""Token ids of whole texts by a public byte-level BPE vocabulary.

A text is cut into pre-tokens by the vocabulary's pattern. A pre-token's bytes form a linked list; for each merge rank there is
a bucket of the list positions whose pair has that rank, and a two-level bitmap of the ranks in use. Find-first-set on the
bitmap gives the next rank; its bucket is taken from left to right, and entries whose pair has changed since are skipped. Each
merge adds at most two entries, so that a pre-token of n bytes costs O(n log n) at most: a run of a million letters without a
space is no harder a byte than a word is.

Null and empty texts give an empty list. Strings that look like special tokens are plain text. Pre-tokens up to 40 characters
are kept in a cache of bounded size.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import spread

#: Where the vocabulary is, on the driver only; a parameter of every function here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the published pattern that cuts text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

WORD = 256
CACHE_SIZE, CACHE_CHARS = 200_000, 40


class Encoder:
    """A vocabulary and its cache, of one worker."""

    def __init__(self, raw: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        self.words = max(self.ranks.values()) // WORD + 1
        self.cut = regex.compile(PATTERN).findall
        self.cache: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        start, nxt, prv = list(range(n)), list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))
        pair: list[int] = [-1] * n
        buckets: dict[int, list[int]] = {}
        low, top = [0] * self.words, 0

        def put(i: int) -> None:
            nonlocal top
            j = nxt[i]
            r = ranks.get(piece[start[i] : end[j]], -1) if j < n else -1
            pair[i] = r
            if r >= 0:
                if (b := buckets.get(r)) is None:
                    buckets[r] = [i]
                    w = r // WORD
                    low[w] |= 1 << (r % WORD)
                    top |= 1 << w
                else:
                    b.append(i)

        for i in range(n - 1):
            put(i)
        dead = bytearray(n)
        while top:
            w = (top & -top).bit_length() - 1
            bits = low[w]
            r = w * WORD + (bits & -bits).bit_length() - 1
            low[w] = bits & (bits - 1)
            if not low[w]:
                top &= top - 1
            b = buckets.pop(r)
            b.sort()
            for i in b:
                if dead[i] or pair[i] != r:
                    continue
                j = nxt[i]
                end[i] = end[j]
                dead[j] = 1
                nxt[i] = nxt[j]
                if nxt[j] < n:
                    prv[nxt[j]] = i
                put(i)
                if prv[i] >= 0:
                    put(prv[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = nxt[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        cache = self.cache
        for p in self.cut(text or ""):
            ids = cache.get(p)
            if ids is None:
                ids = self.merge(p.encode())
                if len(p) <= CACHE_CHARS:
                    if len(cache) >= CACHE_SIZE:
                        cache.clear()
                    cache[p] = ids
            out += ids
        return out


def token_ids(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids of each document."""
    raw = documents.sparkSession.sparkContext.broadcast(open(vocabulary, "rb").read())  # under 1 MB, whatever the corpus is

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(raw.value)
        for b in batches:
            ids = pa.array([encoder.encode(t) for t in b.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids], ["doc_id", "ids"])

    return spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(run, "doc_id bigint, ids array<int>")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return token_ids(spark.read.parquet(f"{d}/documents.parquet"))


QUERIES = {"p7_ids": p7_ids}
