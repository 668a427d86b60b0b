"""How a module of queries keeps them by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable


def register(queries: dict, sql: dict[str, str]) -> Callable:
    """A decorator ``query(sql)`` that enters a function and, if there is one, its SQL under the function's name."""

    def query(text: str | None = None):
        def keep(fn):
            queries[fn.__name__] = fn
            if text:
                sql[fn.__name__] = text
            return fn

        return keep

    return query


def seeded_sql(key: str, seed: int) -> str:
    """SQL of ``ranking.seeded_order``."""
    return f"('0x' || substr(md5({key} || ':{seed}'), 1, 15))::BIGINT"
