"""Registered queries: each operator run on the given tables, next to its DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from importlib import import_module

from trialloom.session import configure

AREAS = ["sampling", "description", "activity", "assignment", "definitions", "models"]


def configured(query: Callable) -> Callable:
    @wraps(query)
    def run(spark, sf_dir):
        return query(configure(spark), sf_dir)

    return run


def _merged(attribute: str) -> dict:
    out: dict = {}
    for area in AREAS:
        out.update(getattr(import_module(f"trialloom.registry.{area}"), attribute))
    return out


def all_queries() -> dict[str, Callable]:
    return {name: configured(q) for name, q in _merged("QUERIES").items()}


def all_oracles() -> dict[str, str]:
    return {name: sql.strip() for name, sql in _merged("ORACLE").items()}
