"""Aggregations: cardinality, coverage, cost, histograms and statistics."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from procmetrics.functions import matches
from procmetrics.model import CRITICAL, PROCESS, SERIES, bucket


def _identity(series: Sequence[str | Column]) -> Column:
    return F.struct(*series)


def cardinality(df: DataFrame, by: Sequence[str | Column], approx: bool = False, series: Sequence[str] = SERIES) -> DataFrame:
    """Distinct series. Exact counting first takes distinct rows, so that no group is counted by one task alone."""
    if approx:
        return df.groupBy(*by).agg(F.approx_count_distinct(F.xxhash64(*series)).alias("series"))
    names = [c for c in by if isinstance(c, str)]
    if len(names) < len(by):
        return df.groupBy(*by).agg(F.count_distinct(_identity(series)).alias("series"))
    return df.select(*dict.fromkeys([*names, *series])).distinct().groupBy(*by).agg(F.count("*").alias("series"))


def _sides(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """baseline and candidate values in one row; a missing side counts 0."""
    of = lambda v: F.coalesce(F.sum(F.when(F.col("variant") == v, F.col(value))), F.lit(0))
    return df.groupBy(*by).agg(of("baseline").alias("baseline"), of("candidate").alias("candidate"))


def cardinality_reduction(df: DataFrame, by: Sequence[str], series: Sequence[str] = SERIES) -> DataFrame:
    """Series of both variants and the reduction as ratio; null without a baseline."""
    out = _sides(cardinality(df, [*by, "variant"], series=series), by, "series")
    return out.withColumn("reduction", F.try_divide((F.col("baseline") - F.col("candidate")).cast("double"), F.col("baseline")))


def flow_counts(inp: DataFrame, out: DataFrame, by: Sequence[str]) -> DataFrame:
    """Accepted, sent and refused points, input processes and output series."""
    a = inp.groupBy(*by).agg(F.count("*").alias("accepted"), F.count_distinct(*PROCESS).alias("processes"))
    b = out.groupBy(*by).agg(F.count("*").alias("sent"), F.count_distinct(*SERIES).alias("series"))
    joined = a.join(b, list(by), "left").fillna(0, ["sent", "series"])
    return joined.withColumn("refused", F.col("accepted") - F.col("sent"))


def critical_coverage(df: DataFrame, by: Sequence[str], pattern: str = CRITICAL, name: str = "exe") -> DataFrame:
    """Distinct critical names of both variants, and the candidate's share."""
    found = df.where(matches(name, pattern)).select(*by, "variant", name).distinct().groupBy(*by, "variant").agg(F.count("*").alias("names"))
    out = _sides(found, by, "names")
    return out.withColumn("coverage", F.try_divide(F.col("candidate").cast("double"), F.col("baseline")))


def process_coverage(df: DataFrame, by: Sequence[str], pattern: str = CRITICAL, name: str = "exe") -> DataFrame:
    """Whether the candidate has each critical name of the baseline."""
    has = lambda v: F.max(F.when(F.col("variant") == v, 1).otherwise(0))
    sides = df.where(matches(name, pattern)).groupBy(*by, name).agg(has("baseline").alias("b"), has("candidate").alias("c"))
    return sides.where("b = 1").select(*by, F.col(name).alias("process_name"), (F.col("c") == 1).alias("covered"))


def retained_text(coverage: DataFrame, by: Sequence[str]) -> DataFrame:
    return coverage.groupBy(*by).agg(F.concat_ws("/", F.count_if("covered").cast("string"), F.count("*").cast("string")).alias("retained"))


def dpm(df: DataFrame, by: Sequence[str], minutes: float) -> DataFrame:
    return df.groupBy(*by).agg((F.count("*") / F.lit(minutes)).alias("dpm"))


def cost_by_bytes(df: DataFrame, by: Sequence[str], size: str, seconds: float, price: float = 0.25) -> DataFrame:
    """Hourly cost at a price a GiB, of the bytes sent in the given seconds."""
    return df.groupBy(*by).agg((F.sum(size) / seconds * 3600 / 2**30 * price).alias("hourly_cost"))


def cost_by_points(df: DataFrame, by: Sequence[str], minutes: float, price_per_million: float) -> DataFrame:
    return dpm(df, by, minutes).select(*by, (F.col("dpm") * 60 / 1e6 * price_per_million).alias("hourly_cost"))


def cost_analysis(df: DataFrame, by: Sequence[str], value: str = "hourly_cost") -> DataFrame:
    """Costs of both variants an hour, day (24 h), month (720 h) and year (12 months), savings and their percentage."""
    out = _sides(df, by, value)
    for period, hours in (("daily", 24), ("monthly", 720), ("annual", 8640)):
        for v in ("baseline", "candidate"):
            out = out.withColumn(f"{v}_{period}", F.col(v) * hours)
    saved = F.col("baseline") - F.col("candidate")
    return out.withColumns({"monthly_savings": saved * 720, "annual_savings": saved * 8640, "percent_saved": F.try_divide(saved * 100, F.col("baseline"))})


def sum_by(df: DataFrame, labels: Sequence[str], condition: Column | None = None) -> DataFrame:
    return (df if condition is None else df.where(condition)).groupBy(*labels).agg(F.sum("value").alias("value"))


def count_by(df: DataFrame, labels: Sequence[str], condition: Column | None = None) -> DataFrame:
    return (df if condition is None else df.where(condition)).groupBy(*labels).agg(F.count("*").alias("n"))


def groupby_attrs(df: DataFrame, keys: Sequence[str], seconds: int, agg=F.sum) -> DataFrame:
    """One row for each keys, metric and bucket of time."""
    return df.groupBy(*keys, "metric", bucket("ts", seconds).alias("bucket")).agg(agg("value").alias("value"))


def exponential_bounds(start: float, factor: float, n: int) -> list[float]:
    return [start * factor**k for k in range(n)]


def histogram(df: DataFrame, column: str, bounds: Sequence[float], by: Sequence[str]) -> DataFrame:
    """(by, le, count) of cumulative buckets, the last of infinite bound. Each row is counted once; bounds are laid out after grouping."""
    steps = [*sorted(bounds), float("inf")]
    counts = df.where(F.col(column).isNotNull()).groupBy(*by).agg(*[F.count_if(F.col(column) <= b).alias(f"b{k}") for k, b in enumerate(steps)])
    rows = F.explode(F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{k}").alias("count")) for k, b in enumerate(steps)])).alias("r")
    return counts.select(*by, rows).select(*by, "r.le", "r.count")


def histogram_quantile(buckets: DataFrame, q: float, by: Sequence[str]) -> DataFrame:
    """Linear interpolation in the first bucket that reaches q of the count; the last finite bound if that is the infinite one; from 0 in the first."""
    w = Window.partitionBy(*by).orderBy("le")
    every = Window.partitionBy(*by)
    rows = buckets.withColumns({"_lo": F.coalesce(F.lag("le").over(w), F.lit(0.0)), "_below": F.coalesce(F.lag("count").over(w), F.lit(0)), "_want": F.max("count").over(every) * q})
    hit = rows.where(F.col("count") >= F.col("_want")).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    inside = F.col("_lo") + (F.col("le") - F.col("_lo")) * F.try_divide(F.col("_want") - F.col("_below"), (F.col("count") - F.col("_below")).cast("double"))
    return hit.select(*by, F.when(F.col("le") == float("inf"), F.col("_lo")).otherwise(F.coalesce(inside, F.col("le"))).alias("quantile"))


def latency_quantiles(df: DataFrame, column: str, by: Sequence[str], qs: Sequence[float] = (0.5, 0.95, 0.99), approx: bool = False) -> DataFrame:
    """Quantiles p50, p95 and so on. Exact ones are taken of distinct values and how often each occurs, so a busy group's rows are counted before they meet."""
    if approx:
        return df.groupBy(*by).agg(*[F.percentile_approx(column, q).alias(f"p{round(q * 100)}") for q in qs])
    counted = df.groupBy(*by, F.col(column).alias("_value")).agg(F.count("*").alias("_times"))
    return counted.groupBy(*by).agg(*[F.percentile("_value", q, F.col("_times")).alias(f"p{round(q * 100)}") for q in qs])


def label_cardinality(df: DataFrame, labels: str = "attrs") -> DataFrame:
    """Distinct values of each label key, most first."""
    pairs = df.select(F.explode(labels).alias("label", "v")).distinct()
    return pairs.groupBy("label").agg(F.count("*").alias("values"))


def cardinality_contribution(df: DataFrame, by: str, series: Sequence[str] = SERIES) -> DataFrame:
    """Series and share of all. The total is a sum over the few groups."""
    per = cardinality(df, [by], series=series)
    return per.crossJoin(F.broadcast(per.agg(F.sum("series").alias("_all")))).select(by, "series", (F.col("series") / F.col("_all")).alias("share"))


def attribution(df: DataFrame, dims: Sequence[str], mode: str = "rollup") -> DataFrame:
    """Points and values of the dimensions with subtotals; level is the grouping id. Mode 'sets': each dimension alone, and the total."""
    if mode == "sets":
        grouped = df.groupingSets([[F.col(d)] for d in dims] + [[]], *dims)
    else:
        grouped = df.rollup(*dims) if mode == "rollup" else df.cube(*dims)
    return grouped.agg(F.grouping_id().alias("level"), F.count("*").alias("points"), F.sum("value").alias("value"))


def attribution_series(df: DataFrame, dims: Sequence[str], mode: str = "rollup", series: Sequence[str] = SERIES, price: float | None = None) -> DataFrame:
    """(dims, level, series, points, value): distinct series of the dimensions with subtotals, beside points and values; share is of all series.

    A series that has several values of a dimension counts once in each, and once in every subtotal above. Rows are first reduced to one for
    each dims and series, before the shuffle; only these are laid out for the grouping sets. With a price each series costs that much.
    Modes are those of attribution. Null dimensions are values of their own, told from subtotals by level.
    """
    keys = list(dict.fromkeys([*dims, *series]))
    leaf = df.groupBy(*keys).agg(F.count("*").alias("points"), F.sum("value").alias("value")).withColumn("_series", F.struct(*series))
    if mode == "sets":
        grouped = leaf.groupingSets([[F.col(d)] for d in dims] + [[]], *dims)
    elif mode in ("rollup", "cube"):
        grouped = leaf.rollup(*dims) if mode == "rollup" else leaf.cube(*dims)
    else:
        raise ValueError(mode)
    out = grouped.agg(F.grouping_id().alias("level"), F.count_distinct("_series").alias("series"), F.sum("points").alias("points"), F.sum("value").alias("value"))
    total = F.max(F.when(F.col("level") == (1 << len(dims)) - 1, F.col("series"))).alias("_all")
    out = out.crossJoin(F.broadcast(out.agg(total))).withColumn("share", F.try_divide(F.col("series").cast("double"), F.col("_all"))).drop("_all")
    return out if price is None else out.withColumn("cost", F.col("series") * price)


def process_churn(df: DataFrame, seconds: int) -> DataFrame:
    """Processes first and last seen in each bucket, and the first as share of those active."""
    at = df.select(*PROCESS, bucket("ts", seconds).alias("bucket")).distinct()
    life = at.groupBy(*PROCESS).agg(F.min("bucket").alias("first"), F.max("bucket").alias("last"))
    marked = at.join(life, list(PROCESS))
    out = marked.groupBy("bucket").agg(F.count("*").alias("active"), F.count_if(F.col("first") == F.col("bucket")).alias("started"), F.count_if(F.col("last") == F.col("bucket")).alias("ended"))
    return out.withColumn("churn", F.col("started") / F.col("active"))


def welch_t(df: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """t and degrees of freedom of candidate against baseline; null where a side has under two values or neither varies."""
    side = lambda v, f: f(F.when(F.col("variant") == v, F.col(value).cast("double")))
    s = df.groupBy(*by).agg(*[side(v, f).alias(f"{n}_{v[0]}") for v in ("baseline", "candidate") for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    a, b = F.try_divide(F.col("v_b"), F.col("n_b").cast("double")), F.try_divide(F.col("v_c"), F.col("n_c").cast("double"))
    df_ = F.try_divide((a + b) * (a + b), F.try_divide(a * a, F.col("n_b") - F.lit(1.0)) + F.try_divide(b * b, F.col("n_c") - F.lit(1.0)))
    return s.select(*by, F.try_divide(F.col("m_c") - F.col("m_b"), F.sqrt(a + b)).alias("t"), df_.alias("dof"))


@F.pandas_udf(DoubleType())
def welch_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided p-value: the t density integrated by Simpson's rule, for a batch of rows at once; NaN where an argument is absent."""
    import math

    import numpy as np

    x, n = np.abs(t.to_numpy("float64")), dof.to_numpy("float64")
    share = np.linspace(0, 1, 2001)
    weight = np.where(np.arange(2001) % 2, 4.0, 2.0)
    weight[[0, -1]] = 1.0
    # x = sqrt(n) tan(a): the density becomes a power of the cosine, normed by the same power over all angles
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    norm = np.exp(lgamma(np.nan_to_num((n + 1) / 2, nan=1.0)) - lgamma(np.nan_to_num(n / 2, nan=1.0))) / math.sqrt(math.pi)
    p = np.empty(len(x))
    for lo in range(0, len(x), 256):
        some = slice(lo, lo + 256)
        top = np.arctan(x[some] / np.sqrt(n[some]))
        area = (np.cos(top[:, None] * share) ** (n[some, None] - 1) * weight).sum(axis=1) * top / 6000
        p[some] = np.maximum(0.0, 1 - 2 * norm[some] * area)
    return pd.Series(p)


def pipeline_counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Kept processes and aggregated groups."""
    group = F.when(F.col("exe").startswith("aggregated_"), F.col("exe"))
    own = F.when(~F.col("exe").startswith("aggregated_"), F.struct(*PROCESS))
    return df.groupBy(*by).agg(F.count_distinct(own).alias("kept_processes"), F.count_distinct(group).alias("aggregated_groups"))


def collector_overhead(df: DataFrame, by: Sequence[str], limit: float, window: float) -> DataFrame:
    """CPU a second, mean and largest memory, and the largest as share of the limit."""
    own = lambda m: F.when(F.col("metric") == m, F.col("value"))
    out = df.groupBy(*by).agg((F.sum(own("process.cpu.time")) / window).alias("cpu_rate"), F.avg(own("process.memory.physical")).alias("memory_mean"), F.max(own("process.memory.physical")).alias("memory_max"))
    return out.withColumn("memory_ratio", F.col("memory_max") / limit)


def experiments_by_status(df: DataFrame) -> DataFrame:
    return df.groupBy("status").agg(F.count("*").alias("n"))


def failure_rate(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count_if(F.col("status") == "failed").alias("failed"), F.count("*").alias("n")).withColumn("failure_rate", F.col("failed") / F.col("n"))


def deployment_ready(df: DataFrame, by: Sequence[str], ready: Column) -> DataFrame:
    """Ready nodes of all, as ratio and text, and the phase that follows from them."""
    out = df.groupBy(*by).agg(F.count_if(ready).alias("ready"), F.count("*").alias("nodes"))
    counted = F.format_string("%d/%d nodes ready", "ready", "nodes")
    text = F.when(F.col("ready") == 0, "Waiting for pods to be ready").when(F.col("ready") < F.col("nodes"), F.concat(F.lit("Partial deployment: "), counted)).otherwise(counted)
    return out.withColumns({"ratio": F.col("ready") / F.col("nodes"), "text": text, "phase": F.when(F.col("ready") == 0, "Pending").otherwise("Running")})


def request_stats(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("requests"), F.count_if(F.col("status") >= 500).alias("errors")).withColumn("error_rate", F.col("errors") / F.col("requests"))


def hit_ratio(df: DataFrame, by: Sequence[str], hit: Column) -> DataFrame:
    return df.groupBy(*by).agg((F.count_if(hit) / F.count("*")).alias("hit_ratio"))


def metrics_summary(df: DataFrame, by: Sequence[str], minutes: float, price_per_million: float) -> DataFrame:
    """One row a group: cardinalities, reduction, ingest rates, costs and the covered critical processes, sorted by name."""
    cards = cardinality_reduction(df, by)
    points = _sides(df.groupBy(*by, "variant").agg(F.count("*").alias("n")), by, "n").select(*by, (F.col("baseline") / minutes).alias("baseline_dpm"), (F.col("candidate") / minutes).alias("candidate_dpm"))
    cover = process_coverage(df, by).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("process_name", "covered"))).alias("coverage"))
    cost = lambda c: F.col(c) * 60 / 1e6 * price_per_million
    out = cards.join(points, list(by)).join(cover, list(by), "left")
    return out.withColumns({"baseline_cost": cost("baseline_dpm"), "candidate_cost": cost("candidate_dpm"), "cost_reduction": F.try_divide(F.col("baseline_dpm") - F.col("candidate_dpm"), F.col("baseline_dpm"))})
