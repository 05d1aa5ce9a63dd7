"""Time series: deltas, rates, resampling, trends and conditions that hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procmetrics.model import COUNTERS, SERIES, bucket


def _at(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts))


def cumulative_to_delta(df: DataFrame, metrics: Sequence[str] = COUNTERS, max_staleness: int | None = None, reset: str = "drop", keys: Sequence[str] = SERIES, order: Sequence[str] = ("ts", "point_id")) -> DataFrame:
    """Counters become differences; other metrics pass.

    A series' first point gives none, nor does a point after a gap of over max_staleness seconds. After a reset (a fall) the point is
    dropped, or its raw value taken with reset='value'. Adds gap_seconds, the time that a delta spans.
    """
    if reset not in ("drop", "value"):
        raise ValueError(reset)
    counter = F.col("metric").isin(list(metrics))
    w = Window.partitionBy(*keys).orderBy(*[c for c in order if c in df.columns])
    out = df.withColumns({"_v": F.lag("value").over(w), "_t": F.lag("ts").over(w)})
    out = out.withColumn("gap_seconds", F.when(counter, (_at() - _at("_t")) / 1e6))
    delta = F.col("value") - F.col("_v")
    new = F.when(~counter, F.col("value")).when(delta >= 0, delta)
    if reset == "value":
        new = new.when(delta < 0, F.col("value"))
    keep = ~counter | F.col("_v").isNotNull()
    if max_staleness is not None:
        keep = keep & (~counter | (F.col("gap_seconds") <= max_staleness))
    return out.where(keep).withColumn("value", new).where(F.col("value").isNotNull()).drop("_v", "_t")


def rate(deltas: DataFrame, window: int, keys: Sequence[str] = SERIES) -> DataFrame:
    """Adds increase and rate: the sum of deltas in the trailing window of seconds (ts - window, ts], and that a second.

    Edges aren't extrapolated: what lies between a window's edge and the next point counts to that point.
    """
    w = Window.partitionBy(*keys).orderBy(_at()).rangeBetween(-window * 1_000_000 + 1, 0)
    return deltas.withColumn("increase", F.sum("value").over(w)).withColumn("rate", F.col("increase") / window)


def generate_cpu_avg(deltas: DataFrame, window: int, keys: Sequence[str] = SERIES, metric: str = "process.cpu.time") -> DataFrame:
    """Average utilisation over the trailing window: each delta by the seconds that it spans."""
    w = Window.partitionBy(*keys).orderBy(_at()).rangeBetween(-window * 1_000_000 + 1, 0)
    used = deltas.where((F.col("metric") == metric) & (F.col("gap_seconds") > 0))
    return used.withColumn("cpu_avg", F.avg(F.col("value") / F.col("gap_seconds")).over(w))


def alert_for(df: DataFrame, condition: Column, seconds: int, step: int, keys: Sequence[str], at: str = "step") -> DataFrame:
    """Adds active and state (inactive, pending, firing): firing once the condition has held at every step for the given seconds.

    at is in seconds. A missing step breaks the run, as does a false or absent condition; a run that spans exactly the duration fires.
    """
    w = Window.partitionBy(*keys).orderBy(at)
    out = df.withColumn("active", F.coalesce(condition, F.lit(False)))
    broken = ~F.coalesce(F.lag("active").over(w), F.lit(False)) | (F.col(at) - F.lag(at).over(w) > step)
    out = out.withColumn("_run", F.sum(F.when(F.col("active") & broken, 1).otherwise(0)).over(w))
    since = F.min(F.when(F.col("active"), F.col(at))).over(Window.partitionBy(*keys, "_run"))
    state = F.when(~F.col("active"), "inactive").when(F.col(at) - since >= seconds, "firing").otherwise("pending")
    return out.withColumn("state", state).drop("_run")


def stable_for(df: DataFrame, condition: Column, seconds: int, keys: Sequence[str], at: str = "step") -> DataFrame:
    """Adds stable: the condition held at all points of the trailing duration, and points reach back that far."""
    w = Window.partitionBy(*keys).orderBy(at)
    met = F.when(F.coalesce(condition, F.lit(False)), 1).otherwise(0)
    held = F.min(met).over(w.rangeBetween(-seconds, 0)) == 1
    return df.withColumn("stable", held & (F.col(at) - F.min(at).over(Window.partitionBy(*keys)) >= seconds))


def resample(df: DataFrame, seconds: int, agg=F.avg, keys: Sequence[str] = SERIES) -> DataFrame:
    """(keys, bucket start in seconds, value)."""
    return df.groupBy(*keys, (bucket("ts", seconds) * seconds).alias("bucket_start")).agg(agg("value").alias("value"))


def trend(df: DataFrame, seconds: int, keys: Sequence[str], agg=F.sum) -> DataFrame:
    """Bucketed values with the difference to the bucket before that has any."""
    return resample(df, seconds, agg, keys).withColumn("change", F.col("value") - F.lag("value").over(Window.partitionBy(*keys).orderBy("bucket_start")))
