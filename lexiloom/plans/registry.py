"""All registered queries."""

from __future__ import annotations

from lexiloom.plans import corpus_queries, model_queries, reply_queries, store_queries, text_queries, vector_queries

MODULES = [text_queries, corpus_queries, model_queries, vector_queries, reply_queries, store_queries]

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: text for module in MODULES for name, text in module.ORACLE.items()}
