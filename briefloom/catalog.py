"""Registry of named queries and the SQL that they are held against."""

from __future__ import annotations

from briefloom.plans import articles, pages, papers, registry, relational, scalars, streams

assert articles and pages and papers and relational and scalars and streams  # importing a module registers its queries


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
