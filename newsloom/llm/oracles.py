"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_SQL: dict[str, str] = {}


def oracles() -> dict[str, str]:
    return dict(_SQL)
