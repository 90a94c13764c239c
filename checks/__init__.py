"""Registered queries, and the same results stated in SQL for a second engine."""

from checks import corpora, folds, learning, masks, profiles, scores, tables, texts

_PARTS = (tables, texts, masks, profiles, corpora, folds, scores, learning)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
