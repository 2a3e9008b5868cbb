"""Registered queries and their SQL twins."""

from __future__ import annotations

from emberlog.plans import event_queries, forensic_queries, join_queries, log_queries, model_queries, rule_queries, text_queries

_PARTS = (event_queries, forensic_queries, join_queries, log_queries, model_queries, rule_queries, text_queries)
QUERIES: dict = {k: f for p in _PARTS for k, f in p.QUERIES.items()}
ORACLES: dict = {k: s for p in _PARTS for k, s in p.ORACLES.items()}
