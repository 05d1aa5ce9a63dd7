"""Mergeable sketches: distinct series, quantiles and frequent label sets in bounded memory.

A stored sketch of a fine bucket stands for its rows: coarser buckets and totals come from sketches alone. Each has a bound, which tests hold
against exact results.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procmetrics.model import SERIES
from procmetrics.operators.transforms import small

#: 2^LG_K registers: the standard error of a count of distinct series is 1.04 / sqrt(2^LG_K), 1.6 %.
LG_K = 12
#: Of a quantile sketch: ranks are off by under RANK_ERROR of all values, 99 times of a hundred.
KLL_K, RANK_ERROR = 200, 0.0165
#: Counts of frequent items are too low by ERROR x total / items at most.
ERROR = 2.7


def distinct_error(lg_k: int = LG_K, deviations: float = 3.0) -> float:
    """By which share a count of distinct series may be off, so many standard errors wide."""
    return deviations * 1.04 / math.sqrt(2**lg_k)


def series_sketches(df: DataFrame, by: Sequence[str], series: Sequence[str] = SERIES, lg_k: int = LG_K) -> DataFrame:
    """(by, sketch, points): one sketch of the distinct series of each group, some kilobytes however many there are. Partial ones meet, not rows."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(F.xxhash64(*series), lg_k).alias("sketch"), F.count("*").alias("points"))


def roll_up_series(sketches: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    """(by, series, points) from stored sketches. A series that is in many buckets counts once."""
    merged = sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"), F.sum("points").alias("points"))
    return merged.withColumn("series", F.hll_sketch_estimate("sketch")).drop("sketch")


def quantile_sketches(df: DataFrame, by: Sequence[str], value: str, k: int = KLL_K) -> DataFrame:
    """(by, sketch): one sketch of each group's values (whole numbers). Nulls take no part; a group of nulls alone has none."""
    some = df.where(F.col(value).isNotNull())
    return some.groupBy(*by).agg(F.kll_sketch_agg_bigint(F.col(value).cast("long"), F.lit(k)).alias("sketch"))


def roll_up_quantiles(sketches: DataFrame, by: Sequence[str | Column], qs: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(by, n, p50, ...) from stored sketches; each quantile is a value that occurs."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_bigint("sketch").alias("sketch"))
    found = {f"p{round(q * 100)}": F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(q))) for q in qs}
    return merged.withColumns({"n": F.kll_sketch_get_n_bigint("sketch"), **found}).drop("sketch")


def quantile_holds(df: DataFrame, by: Sequence[str], value: str, quantiles: DataFrame, qs: Sequence[float] = (0.5, 0.95, 0.99), error: float = RANK_ERROR) -> DataFrame:
    """(by, n, p50_holds, ...): whether each quantile's ranks among the group's values enclose q, give or take the error. Values are counted, not sorted."""
    names = [f"p{round(q * 100)}" for q in qs]
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    met = counted.join(small(quantiles.select(*by, *names)), list(by))
    ranks = met.groupBy(*by).agg(F.sum("_n").alias("n"), *[F.sum(F.when(F.col("_v") < F.col(p), F.col("_n")).otherwise(0)).alias(f"{p}_lo") for p in names], *[F.sum(F.when(F.col("_v") <= F.col(p), F.col("_n")).otherwise(0)).alias(f"{p}_hi") for p in names])
    holds = {f"{p}_holds": (F.col(f"{p}_lo") <= (q + error) * F.col("n")) & (F.col(f"{p}_hi") >= (q - error) * F.col("n")) for p, q in zip(names, qs, strict=True)}
    return ranks.withColumns(holds).select(*by, "n", *holds)


def frequent_sketch(df: DataFrame, labels: Sequence[str], items: int = 10_000) -> DataFrame:
    """(sketch, total) of the label sets of all rows, of bounded size: items counters, whatever the number of sets."""
    key = F.xxhash64(*labels).alias("_key")
    return df.select(key).agg(F.expr(f"approx_top_k_accumulate(_key, {int(items)})").alias("sketch"), F.count("*").alias("total"))


def heavy_labels(df: DataFrame, labels: Sequence[str], n: int = 20, items: int = 10_000) -> DataFrame:
    """(labels, n): the n most frequent label sets, ties by label, as by counting all; in memory that doesn't grow with the number of sets.

    One pass counts in a sketch, whose counts are at most error = 2.7 x total / items too low; a set that occurs over twice as often is
    sure to be among its candidates. A second pass counts the candidates exactly. If the n-th of them occurs more often than that, none is
    missing. If not, as where label sets are all about as rare, or fewer than n, everything is counted after all. Sets meet by a 64-bit
    hash first; two that share one are both counted. An empty table gives none; null labels are labels.
    """
    sketch = frequent_sketch(df, labels, items).select("total", F.explode_outer(F.expr(f"approx_top_k_estimate(sketch, {int(items)})")).alias("c"))
    rows = sketch.select("total", F.col("c.item").alias("key")).collect()  # items at most
    exact = df.groupBy(*labels).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *labels).limit(n)
    candidates = [(r["key"],) for r in rows if r["key"] is not None]
    if not candidates:
        return exact
    keys = F.broadcast(df.sparkSession.createDataFrame(candidates, "_key long"))
    counted = df.withColumn("_key", F.xxhash64(*labels)).join(keys, "_key", "left_semi").groupBy(*labels).agg(F.count("*").alias("n"))
    top = counted.orderBy(F.desc("n"), *labels).limit(n)
    found = top.collect()  # n at most
    if len(found) < n or found[-1]["n"] <= 2 * ERROR * rows[0]["total"] / items:
        return exact
    return df.sparkSession.createDataFrame(found, top.schema)
