"""All queries of the core and their SQL."""

from __future__ import annotations

from factloom.plans import answer, evaluation, facts, files, graph, problems, retrieval

QUERIES = {**problems.QUERIES, **facts.QUERIES, **graph.QUERIES, **retrieval.QUERIES, **evaluation.QUERIES, **answer.QUERIES, **files.QUERIES}
ORACLE: dict[str, str] = {**problems.ORACLE, **facts.ORACLE, **graph.ORACLE, **retrieval.ORACLE, **evaluation.ORACLE, **answer.ORACLE, **files.ORACLE}
