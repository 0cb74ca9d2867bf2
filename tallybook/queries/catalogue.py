"""The catalogue of reference queries, gathered from its parts."""

from __future__ import annotations

from tallybook.queries import candidates, finance, records, resolution, texts, upserts

_PARTS = (finance, records, candidates, upserts, texts, resolution)
QUERIES = {name: query for part in _PARTS for name, query in part.C.queries.items()}
SQL = {name: text for part in _PARTS for name, text in part.C.sql.items()}
