"""All queries of the llm subpackage and their SQL."""

from __future__ import annotations

from factloom.llm import bpe, canonical, leakage, names, pii, sentences

QUERIES = {**canonical.QUERIES, **names.QUERIES, **pii.QUERIES, **bpe.QUERIES, **leakage.QUERIES, **sentences.QUERIES}
ORACLE = {**canonical.ORACLE}
