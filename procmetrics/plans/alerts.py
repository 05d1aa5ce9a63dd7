"""Alert rules over evaluated steps. Each takes a table with step in seconds, and gives it with active and state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procmetrics.functions import eq, gt, lt
from procmetrics.operators.series import alert_for

MINUTE = 60


def alert_cardinality(df: DataFrame, keys: Sequence[str], step: int, limit: float = 10000, hold: int = 5 * MINUTE) -> DataFrame:
    return alert_for(df, gt("series", limit), hold, step, keys)


def alert_critical_missing(df: DataFrame, keys: Sequence[str], step: int, least: float = 0.95, hold: int = 10 * MINUTE) -> DataFrame:
    return alert_for(df, lt("coverage", least), hold, step, keys)


def alert_memory(df: DataFrame, keys: Sequence[str], step: int, limit: float = 0.8, hold: int = 5 * MINUTE) -> DataFrame:
    return alert_for(df, gt("memory_ratio", limit), hold, step, keys)


def alert_cost(df: DataFrame, keys: Sequence[str], step: int, excess: float = 0.1, hold: int = 15 * MINUTE) -> DataFrame:
    """The candidate costs more than the baseline by over the excess."""
    return alert_for(df, gt(F.try_divide(F.col("candidate") - F.col("baseline"), F.col("baseline")), excess), hold, step, keys)


def alert_down(df: DataFrame, keys: Sequence[str], step: int, hold: int = 5 * MINUTE) -> DataFrame:
    return alert_for(df, eq("up", 0), hold, step, keys)


def alert_failures(df: DataFrame, keys: Sequence[str], step: int, limit: float = 0.1, hold: int = 30 * MINUTE) -> DataFrame:
    return alert_for(df, gt("failure_rate", limit), hold, step, keys)


def alert_deployment(df: DataFrame, keys: Sequence[str], step: int, least: float = 0.9, hold: int = 10 * MINUTE) -> DataFrame:
    return alert_for(df, lt("ratio", least), hold, step, keys)


def render_alert(df: DataFrame, template: Sequence[str | Column], name: str = "message") -> DataFrame:
    """Text from fixed parts (strings) and columns."""
    return df.withColumn(name, F.concat(*[F.lit(t) if isinstance(t, str) else t.cast("string") for t in template]))

