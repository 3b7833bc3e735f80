"""How query modules register what they offer."""

from __future__ import annotations

from collections.abc import Callable


class Catalogue:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        """Register a function (spark, sf_dir) under ``name``, with its SQL if there is any."""

        def register(f: Callable) -> Callable:
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return register
