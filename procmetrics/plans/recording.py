"""Recorded series: aggregates by bucket of time, stored and kept up to date.

A rule's rows lie in one partition for each part of time (a day, say). A part is open until points are so late that no more is expected of
it; then it is closed. Each run computes open parts only, from points that the scan can prune to, and replaces these partitions as wholes.
Closed ones are neither read nor written again. Data are written before the mark that closes them, so a run that fails is simply run again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procmetrics.model import SERIES, bucket
from procmetrics.operators.aggregates import cardinality_reduction, collector_overhead, cost_by_bytes, critical_coverage
from procmetrics.operators.series import cumulative_to_delta, rate
from procmetrics.operators.sketches import quantile_sketches, series_sketches
from procmetrics.sources.stored import exists

Build = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Rule:
    """build takes points and gives rows with a column bucket: the number of the bucket of so many seconds since the epoch.

    lookback says how many seconds of points before a bucket its rows need too.
    """

    name: str
    build: Build
    seconds: int
    lookback: int = 0


def _at(df: DataFrame, seconds: int) -> DataFrame:
    return df.withColumn("bucket", bucket("ts", seconds))


def reduction_rule(seconds: int, by: Sequence[str] = ("host_name",), name: str = "cardinality_reduction") -> Rule:
    """Series of both variants in each bucket, and the reduction. Points carry their variant."""
    return Rule(name, lambda df: cardinality_reduction(_at(df, seconds), [*by, "bucket"]), seconds)


def coverage_rule(seconds: int, by: Sequence[str] = ("host_name",), name: str = "critical_coverage") -> Rule:
    return Rule(name, lambda df: critical_coverage(_at(df, seconds), [*by, "bucket"]), seconds)


def cost_rule(seconds: int, size: str, price: float = 0.25, by: Sequence[str] = ("host_name", "variant"), name: str = "hourly_cost") -> Rule:
    """Hourly cost of the bytes sent in each bucket."""
    return Rule(name, lambda df: cost_by_bytes(_at(df, seconds), [*by, "bucket"], size, seconds, price), seconds)


def overhead_rule(seconds: int, limit: float, max_staleness: int, by: Sequence[str] = ("host_name",), name: str = "collector_overhead") -> Rule:
    """CPU a second and memory in each bucket, from counters: a delta that begins in the bucket before is looked back for."""
    return Rule(name, lambda df: collector_overhead(_at(cumulative_to_delta(df, max_staleness=max_staleness), seconds), [*by, "bucket"], limit, seconds), seconds, max_staleness)


def rate_rule(seconds: int, window: int, max_staleness: int, metric: str, keys: Sequence[str] = SERIES, name: str = "rate") -> Rule:
    """The rate over the trailing window at the last point of each series in each bucket."""

    def build(df: DataFrame) -> DataFrame:
        rates = _at(rate(cumulative_to_delta(df.where(F.col("metric") == metric), max_staleness=max_staleness), window, keys), seconds)
        last = F.max_by(F.struct("increase", "rate"), F.struct("ts", "point_id")).alias("last")
        return rates.groupBy(*keys, "bucket").agg(last).select(*keys, "bucket", "last.increase", "last.rate")

    return Rule(name, build, seconds, window + max_staleness)


def cardinality_sketch_rule(seconds: int, by: Sequence[str], name: str = "series_sketches") -> Rule:
    """Sketches of distinct series; any coarser bucket follows from them (operators.sketches.roll_up_series)."""
    return Rule(name, lambda df: series_sketches(_at(df, seconds), [*by, "bucket"]), seconds)


def quantile_sketch_rule(seconds: int, by: Sequence[str], value: str, name: str = "quantile_sketches") -> Rule:
    """Sketches of a value's distribution; any coarser bucket follows from them (operators.sketches.roll_up_quantiles)."""
    return Rule(name, lambda df: quantile_sketches(_at(df, seconds), [*by, "bucket"], value), seconds)


def _marks(spark: SparkSession, path: str, rule: Rule) -> tuple[int | None, int | None]:
    """The number of the first open part and the length of parts; None before the first run."""
    marks = f"{path}/{rule.name}/marks"
    if not exists(spark, marks):
        return None, None
    return tuple(spark.read.schema("open_from long, part long").parquet(marks).agg(F.max("open_from"), F.max("part")).first())


def record(points: DataFrame, rule: Rule, path: str, part: int = 86400, delay: int = 0) -> None:
    """Brings the rule's stored rows up to date with points, which have a time ts.

    part is the length of a partition in seconds, a multiple of the rule's. A part closes once a point lies delay seconds beyond its end;
    what comes for it later is not taken in. points are read twice, so what is dear to make should be stored first. points must hold those of all open parts, and the lookback before. Points without a time are not read. Running again over the same points changes no row, and no
    file of a closed part; without new points or with an empty table nothing is written.
    """
    if part % rule.seconds:
        raise ValueError(f"{part} is no multiple of {rule.seconds}")
    spark = points.sparkSession
    mark, length = _marks(spark, path, rule)
    if length not in (None, part):
        raise ValueError(f"the rule's parts are {length} seconds long, not {part}")
    start = lambda p: F.timestamp_seconds(F.lit(p * part - rule.lookback))
    needed = points.where(F.col("ts").isNotNull()) if mark is None else points.where(F.col("ts") >= start(mark))
    last = needed.agg(F.max(F.unix_seconds("ts"))).first()[0]
    if last is None or mark is not None and last < mark * part:
        return
    rows = rule.build(needed).withColumn("part", F.floor(F.col("bucket") * rule.seconds / part))
    rows = rows if mark is None else rows.where(F.col("part") >= mark)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{path}/{rule.name}/rows")
    closed = (last - delay) // part
    if mark is None or closed > mark:
        spark.createDataFrame([(closed if mark is None else max(closed, mark), part)], "open_from long, part long").coalesce(1).write.mode("append").parquet(f"{path}/{rule.name}/marks")


def recorded(spark: SparkSession, path: str, rule: Rule, since: int | None = None) -> DataFrame:
    """The stored rows, or those of buckets that begin at or after a time in seconds; these prune to their partitions."""
    rows = spark.read.parquet(f"{path}/{rule.name}/rows")
    if since is None:
        return rows.drop("part")
    return rows.where((F.col("part") >= since // _marks(spark, path, rule)[1]) & (F.col("bucket") * rule.seconds >= since)).drop("part")
