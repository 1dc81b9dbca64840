"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from corpusloom.queries import cleaning, counts, topics, words

_MODULES = (cleaning, words, counts, topics)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
