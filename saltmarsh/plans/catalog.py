"""Registry of queries over the given tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from saltmarsh.session import spread


@dataclass
class Tables:
    """Lazy access to the given tables of one scale factor."""

    spark: SparkSession
    folder: str
    _seen: dict = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._seen:
            self._seen[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._seen[name]

    def wide(self, name: str) -> DataFrame:
        """A table whose rows are expensive to work on, over at least as many tasks as cores."""
        return spread(getattr(self, name))


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of Tables as a query, with its SQL equivalent."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"query {name} exists")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Tables(spark, sf_dir))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def load_all() -> None:
    from saltmarsh.plans import (  # noqa: F401
        q_chain, q_detect, q_findings, q_fleet, q_integrity, q_inventory, q_risk, q_sources, q_streaming, q_text,
    )
