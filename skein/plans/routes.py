"""The route of a query's text in SQL."""

from __future__ import annotations

from skein.operators import routing


def alternatives(words: tuple[str, ...]) -> str:
    return r"\b(" + "|".join(w.replace(".", r"\.") for w in words) + r")\b"


ROUTE_SQL = f"""CASE
  WHEN regexp_matches(lower(text), '{alternatives(routing.CORPUS)}') OR (len(text) > 120 AND regexp_matches(lower(text), '{alternatives(routing.SYNTHESIS)}')) THEN 'corpus_exploration'
  WHEN regexp_matches(lower(text), '{alternatives(routing.ENTITY)}') THEN 'entity_relation'
  WHEN regexp_matches(lower(text), '{alternatives(routing.TABLE)}') THEN 'table_lookup'
  WHEN regexp_matches(lower(text), '{alternatives(routing.SYNTHESIS)}') OR len(text) > 80 THEN 'synthesis' ELSE 'factual' END"""
