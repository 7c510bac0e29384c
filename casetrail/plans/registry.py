"""Registry of named queries and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .bindings import Views, oracle_text


@dataclass(frozen=True)
class Query:
    name: str
    operators: tuple[str, ...]
    build: Callable[[Views], DataFrame]
    oracle: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Views(spark, sf_dir))


QUERIES: dict[str, Query] = {}


def query(name: str, operators: str, oracle: str | None = None):
    """Registers a function of :class:`Views` under ``name`` for the listed operators."""

    def register(build: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(
            name, tuple(operators.split()), build, oracle_text(oracle) if oracle else None)
        return build

    return register
