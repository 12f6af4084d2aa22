"""Collects queries and their SQL under a name."""

from __future__ import annotations


class Register:
    def __init__(self, ctes: str = ""):
        self.ctes, self.queries, self.sql = ctes.strip(), {}, {}

    def query(self, name: str, sql: str | None = None, ctes: bool = True):
        def add(f):
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = f"WITH {self.ctes} {sql}" if ctes and self.ctes else sql
            return f

        return add
