"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from gramlake.llm import conversations, decontamination, embeddings, language, linededup, neardup, packing, pii, quality, resampling, rules, tokens, webtext

_MODULES = (embeddings, webtext, tokens, pii, neardup, quality, linededup, decontamination, language, packing, rules, resampling, conversations)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, sql in getattr(m, "ORACLES", {}).items()}
