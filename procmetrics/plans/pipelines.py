"""The named pipelines. Each takes datapoints and gives datapoints."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procmetrics.functions import any_of, eq, is_in
from procmetrics.model import PROCESS, bucket
from procmetrics.operators.aggregates import groupby_attrs
from procmetrics.operators.filters import adaptive_conditions, adaptive_filter, keep_important, split_aggregate
from procmetrics.operators.series import cumulative_to_delta, generate_cpu_avg
from procmetrics.operators.transforms import classify_category, classify_priority, detect_resource, host_facts, pipeline, rename_aggregated, set_attrs, with_metric_value

#: Seconds without a point after which a counter counts as new.
MAX_STALENESS = 600


def baseline_v1(
    df: DataFrame, hosts: DataFrame | None = None, experiment: str | Column = "exp-00000000", variant: str | Column = "baseline", node: str | Column | None = None, max_staleness: int | None = MAX_STALENESS
) -> DataFrame:
    """Deltas, host facts where absent; experiment and variant where absent, the node always (the host's name, if no other is given)."""
    steps = [partial(cumulative_to_delta, max_staleness=max_staleness)]
    if hosts is not None:
        steps.append(partial(detect_resource, hosts=hosts))
    attrs = {"experiment_id": (experiment, "insert"), "variant": (variant, "insert"), "node_name": (F.col("host_name") if node is None else node, "upsert")}
    return pipeline(df, [*steps, partial(set_attrs, attrs=attrs)])


def by_process(df: DataFrame, placed: bool = False) -> DataFrame:
    """Points of a process in one partition, so that all its windows need one shuffle; placed says that they are so already, as in a table by process."""
    return df if placed else df.repartition(*PROCESS)


def with_priority(df: DataFrame, seconds: int) -> DataFrame:
    """Priority by name, and by the process's memory in the bucket."""
    return classify_priority(with_metric_value(df, "process.memory.physical", PROCESS, seconds, "memory_value"))


def priority_filter_v1(df: DataFrame, seconds: int = 60, placed: bool = False, **baseline) -> DataFrame:
    return pipeline(by_process(df, placed), [partial(baseline_v1, **baseline), partial(with_priority, seconds=seconds), keep_important])


def aggregated_v1(df: DataFrame, seconds: int = 60, placed: bool = False, **baseline) -> DataFrame:
    """Important processes one by one; low ones summed by host, category, owner, metric and bucket, and renamed.

    Columns that the sums don't have are absent in their rows.
    """
    marked = pipeline(by_process(df, placed), [partial(baseline_v1, **baseline), partial(with_priority, seconds=seconds), classify_category])
    own, low = split_aggregate(marked)
    rolled = groupby_attrs(low, ["host_name", "category", "owner", "experiment_id", "variant", "node_name"], seconds).withColumn("exe", F.lit(None).cast("string"))
    rolled = rename_aggregated(rolled).withColumns({"ts": F.timestamp_seconds(F.col("bucket") * seconds), "aggregate": F.lit("true"), "priority": F.lit("low")}).drop("bucket")
    return own.unionByName(rolled, allowMissingColumns=True)


def utilisation(deltas: DataFrame, window: int) -> DataFrame:
    """(host_name, bucket, pid, used): the trailing average of CPU seconds a second at the process's last point in the bucket, to 6 places."""
    at = F.struct(*[c for c in ("ts", "point_id") if c in deltas.columns])
    averages = generate_cpu_avg(deltas, window)
    return averages.groupBy("host_name", "bucket", "pid").agg(F.round(F.max_by("cpu_avg", at), 6).alias("used"))


def busiest(deltas: DataFrame, k: int, window: int) -> DataFrame:
    """(host_name, bucket, pid) of the k processes of most utilisation; ties go to the smaller pid."""
    place = F.row_number().over(Window.partitionBy("host_name", "bucket").orderBy(F.desc("used"), "pid"))
    return utilisation(deltas, window).withColumn("place", place).where(F.col("place") <= k).select("host_name", "bucket", "pid")


def topk_v1(df: DataFrame, k: int = 20, seconds: int = 60, window: int = 60, mode: str = "rank", threshold: float | None = None, placed: bool = False, **baseline) -> DataFrame:
    """All points of the busiest processes on each host and in each bucket, by average utilisation over the trailing window.

    mode 'rank' keeps k processes; 'threshold', which needs no ranking, those whose utilisation is at least the threshold. A process without a
    delta in the bucket has no utilisation and goes.
    """
    if mode not in ("rank", "threshold") or mode == "threshold" and threshold is None:
        raise ValueError((mode, threshold))
    at = baseline_v1(by_process(df, placed), **baseline).withColumn("bucket", bucket("ts", seconds))
    kept = busiest(at, k, window) if mode == "rank" else utilisation(at, window).where(F.col("used") >= threshold)
    return at.join(kept, ["host_name", "bucket", "pid"], "left_semi").drop("bucket")


def adaptive_filter_v1(df: DataFrame, cpu_hi: float = 0.8, n_hi: int = 500, cpu_lo: float = 0.01, seconds: int = 60, scrape: int = 10, **baseline) -> DataFrame:
    return adaptive_filter(with_priority(baseline_v1(by_process(df), **baseline), seconds), cpu_hi, n_hi, cpu_lo, seconds, scrape)


# Expected reduction in percent, least and most.
EXPECTED = {"baseline_v1": (0, 0), "priority_filter_v1": (60, 70), "aggregated_v1": (50, 60), "topk_v1": (40, 50), "adaptive_filter_v1": (0, 100)}


def catalog_report(df: DataFrame, seconds: int = 60, k: int = 20, cpu_hi: float = 0.8, n_hi: int = 500, cpu_lo: float = 0.01, scrape: int = 10, window: int = 60, **baseline) -> DataFrame:
    """(pipeline, series, reduction, expected_min, expected_max) of all five pipelines over the same input. A series here is host, pid, name and metric.

    The steps that the pipelines share run once: each row says which pipelines keep it, and under which series, and meets each
    series once for each pipeline.
    """
    marked = host_facts(classify_category(with_priority(baseline_v1(by_process(df), **baseline), seconds)), seconds, scrape)
    best = busiest(marked, k, window).withColumn("_top", F.lit(True))
    rows = marked.join(best, ["host_name", "bucket", "pid"], "left")
    dropped = any_of([F.coalesce(c, F.lit(False)) for c in adaptive_conditions(cpu_hi, n_hi, cpu_lo)])
    flags = {"important": is_in("priority", ["critical", "high", "medium"]), "rolled_up": eq("aggregate", "true"), "top": F.coalesce("_top", F.lit(False)), "adapted": ~dropped}
    told = rows.select("host_name", "pid", "exe", "metric", "category", *[c.alias(n) for n, c in flags.items()]).distinct()  # as few rows as series before each is laid out for the pipelines
    own = F.struct("host_name", "pid", "exe", "metric")
    rolled = F.struct("host_name", F.lit(None).cast("long").alias("pid"), F.concat(F.lit("aggregated_"), "category").alias("exe"), "metric")
    kept = {
        "baseline_v1": own,
        "priority_filter_v1": F.when(F.col("important"), own),
        "aggregated_v1": F.when(F.col("rolled_up"), rolled).otherwise(own),
        "topk_v1": F.when(F.col("top"), own),
        "adaptive_filter_v1": F.when(F.col("adapted"), own),
    }
    of = lambda n: F.struct(F.lit(n).alias("pipeline"), kept[n].alias("s"), *[F.lit(x).alias(c) for c, x in zip(("expected_min", "expected_max"), EXPECTED[n], strict=True)])
    series = told.select(F.explode(F.array(*[of(n) for n in kept])).alias("r")).select("r.*").where(F.col("s").isNotNull()).distinct()
    out = series.groupBy("pipeline", "expected_min", "expected_max").agg(F.count("*").alias("series"))
    base = out.where(eq("pipeline", "baseline_v1")).select(F.col("series").alias("_base"))
    return out.crossJoin(F.broadcast(base)).select("pipeline", "series", F.try_divide((F.col("_base") - F.col("series")).cast("double"), F.col("_base")).alias("reduction"), "expected_min", "expected_max")
