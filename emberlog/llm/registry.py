"""The queries of the training-data operators and their SQL twins."""

from __future__ import annotations

import importlib

MODULES = ["line_dedup", "near_dedup", "url_filter", "chat_format", "language_id", "packing", "suffix_dedup", "decontaminate", "quality_rules", "cotrain", "nearest", "merkle", "whitening"]


def _loaded():
    return [importlib.import_module(f"emberlog.llm.{m}") for m in MODULES]


def queries() -> dict:
    import corpus_pipeline

    return {k: f for m in _loaded() for k, f in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    return {k: s for m in _loaded() for k, s in m.ORACLES.items()}
