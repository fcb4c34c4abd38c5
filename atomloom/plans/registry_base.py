"""How queries are registered."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """Queries by name with their DuckDB SQL; ``registry(sql)`` is a decorator."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracle: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if sql:
                self.oracle[f.__name__] = sql
            return f

        return add
