"""All registered queries of the reference's own operators, with the equivalent SQL."""

from engramark.plans import canonicalization, decisions, extended, lifecycle, search, simulation, texts

_PARTS = (canonicalization, lifecycle, simulation, texts, decisions, extended, search)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
