"""Token counts by a public vocabulary, and counts of what a job reads and writes."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

#: Where the vocabulary is, on the driver only; a parameter of token_counts.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pattern that cuts text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counts(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """key, tokens of each row; a null text has none."""
    raw = df.sparkSession.sparkContext.broadcast(open(vocabulary, "rb").read())  # a vocabulary's file

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.value.splitlines()) if a}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "tokens": [len(encode(t)) for t in b["text"]]})

    return df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInPandas(run, "key bigint, tokens bigint").withColumnRenamed("key", key)


def counted(df: DataFrame, name: str, *sums: str) -> tuple[DataFrame, Observation]:
    """df, and a counter of its rows and of the sums of columns that is set once an action has run over df: usage of a run is its difference."""
    o = Observation(name)
    return df.observe(o, F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(c) for c in sums]), o
