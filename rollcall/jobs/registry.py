"""All queries of the library but those of the llm subpackage."""

from __future__ import annotations

from rollcall.jobs import catalog, catalog_more, oracles  # noqa: F401


def queries() -> dict[str, catalog.Query]:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
