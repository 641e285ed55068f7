"""Queries and SQL of the training-data operators, by name."""

from __future__ import annotations

import corpus_pipeline
from pagewright.llm import ann, decontam, langid, line_dedup, lm, mixing, neardup, substrings, tokens, warc

MODULES = (ann, line_dedup, mixing, tokens, substrings, lm, decontam, warc, langid, neardup)

QUERIES = {"pipeline": corpus_pipeline.run} | {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}) | {k: v for m in MODULES for k, v in m.ORACLES.items()}
