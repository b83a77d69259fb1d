"""Registered queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from planloom.workload.views import cte, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """The tables of one scale factor, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None, views: tuple[str, ...] = (), recursive: bool = False):
    """Register ``fn(inputs) -> DataFrame`` and, if given, its SQL over ``views``."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql is not None:
            body = sql.strip()
            prefix = cte(*views)
            if prefix and body.upper().startswith("WITH "):
                text = f"{prefix},\n{body[5:]}"
            else:
                text = f"{prefix}\n{body}" if prefix else body
            head = "WITH RECURSIVE " if recursive else "WITH "
            ORACLES[name] = head + text if prefix else text
        return fn

    return add
