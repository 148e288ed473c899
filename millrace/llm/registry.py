"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from millrace.llm import arc, bpe, hmm, hostrules, mixing, ngram_join, pq, suffix, surrogates, toxicity

MODULES = (bpe, mixing, hmm, arc, hostrules, ngram_join, pq, suffix, surrogates, toxicity)


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
