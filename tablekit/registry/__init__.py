"""All registered queries."""

from __future__ import annotations

from tablekit.registry.base import Query


def all_queries() -> list[Query]:
    from tablekit.registry import changes, found, texts, views, writes

    return [*views.QUERIES, *texts.QUERIES, *writes.QUERIES, *changes.QUERIES, *found.QUERIES]
