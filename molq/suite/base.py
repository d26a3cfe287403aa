"""Registry of runnable queries, each with the operators it covers and its SQL check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(covers: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under its own name."""

    def wrap(fn):
        if fn.__name__ in REGISTRY:
            raise ValueError(f"duplicate query {fn.__name__}")
        REGISTRY[fn.__name__] = Query(fn.__name__, tuple(covers.split()), fn, sql)
        return fn

    return wrap
