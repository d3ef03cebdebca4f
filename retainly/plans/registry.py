"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None).

Builders take ``(spark, sf_dir)`` and return a lazy DataFrame; the oracle
text is the same computation written in plain SQL over the base tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class QuerySpec:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, QuerySpec] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = QuerySpec(name, fn, sql)
        return fn
    return deco


def load_all() -> dict[str, QuerySpec]:
    # importing the binding modules fills the registry
    from . import (q_campaign, q_evaluate, q_explain, q_features, q_ml, q_profile, q_stream, q_summary)  # noqa: F401
    return REGISTRY
