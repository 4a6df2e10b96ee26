"""All core queries with their SQL twins."""

from __future__ import annotations

from loomtext.incremental import merkle
from loomtext.plans import q_code, q_more, q_rel, q_scalars, q_text

_QUERIES: dict = {}
_SQL: dict = {}


def add(name, fn, sql=None):
    if name in _QUERIES:
        raise ValueError(f"query {name} is registered twice")
    _QUERIES[name] = fn
    if sql:
        _SQL[name] = sql


add("p5_found", merkle.p5_found, merkle.P5_SQL)
add("p5_matches", merkle.p5_matches, merkle.P5_MATCHES_SQL)
for _module in (q_text, q_scalars, q_code, q_rel, q_more):
    for _name, (_fn, _sql) in _module.QUERIES.items():
        add(_name, _fn, _sql)


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_SQL)


def entry(spark, sf_dir):
    """Flagship: matches of all source files by file type and kind, lexed, cleaned and filtered."""
    return q_code.unit_counts(spark, sf_dir)
