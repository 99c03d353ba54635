"""Every query of the library and its DuckDB SQL, by name."""

from __future__ import annotations

from tessella.plans import base, companies, events, feeds, fundamentals, knowledge, portfolio, questions, relational, reports, retrieval, search, writes  # noqa: F401  they register themselves

QUERIES, SQL = base.QUERIES, base.SQL
