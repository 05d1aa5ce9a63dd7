"""Queries over the derived views, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from procmetrics.queries.views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of the views; sql may read the views too."""

    def register(build: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = lambda spark, sf_dir: build(Views(spark, sf_dir))
        if sql:
            ORACLE[name] = with_views(sql)
        return build

    return register


from procmetrics.queries import control, metrics, stored, streams, verdicts  # noqa: E402, F401
