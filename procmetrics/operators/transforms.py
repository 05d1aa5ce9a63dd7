"""Projections and enrichment."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procmetrics.functions import eq, gt, matches
from procmetrics.functions import now as now_
from procmetrics.model import CATEGORY_RULES, MEDIUM_MEMORY, PRIORITY_RULES, bucket

Step = Callable[[DataFrame], DataFrame]
#: Tables up to this many bytes may be sent to every executor.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Marks df for broadcast if the optimizer's size estimate is under the limit; else leaves the choice of the join to Spark."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= limit else df


def pipeline(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """Steps in order, as one lazy plan."""
    for step in steps:
        df = df.transform(step)
    return df


def _value(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def set_attrs(df: DataFrame, attrs: Mapping[str, tuple[object, str]]) -> DataFrame:
    """insert writes an attribute where it is absent, upsert always."""
    for name, (value, action) in attrs.items():
        if action not in ("insert", "upsert"):
            raise ValueError(action)
        keep = action == "insert" and name in df.columns
        df = df.withColumn(name, F.coalesce(F.col(name), _value(value)) if keep else _value(value))
    return df


def _without(labels: Column, key: str) -> Column:
    return F.map_filter(labels, lambda k, _: k != key)


def set_map_attrs(df: DataFrame, attrs: Mapping[str, tuple[object, str]], labels: str = "attrs") -> DataFrame:
    """The same on a map column; null maps count as empty."""
    for name, (value, action) in attrs.items():
        old = F.coalesce(F.col(labels), F.create_map().cast("map<string,string>"))
        there = F.map_contains_key(old, name) if action == "insert" else F.lit(False)
        new = F.map_concat(_without(old, name), F.create_map(F.lit(name), _value(value).cast("string")))
        df = df.withColumn(labels, F.when(there, old).otherwise(new))
    return df


def detect_resource(df: DataFrame, hosts: DataFrame, override: bool = False, key: str = "host_name") -> DataFrame:
    """Host facts beside each datapoint; without override only absent values are filled. One row a host is expected."""
    facts = [c for c in hosts.columns if c != key]
    named = hosts.select(key, *[F.col(c).alias(f"_{c}") for c in facts])
    out = df.join(small(named), key, "left")
    for c in facts:
        have = F.col(c) if c in df.columns else F.lit(None)
        out = out.withColumn(c, F.coalesce(F.col(f"_{c}"), have) if override else F.coalesce(have, F.col(f"_{c}")))
    return out.drop(*[f"_{c}" for c in facts])


def apply_statements(df: DataFrame, statements: Sequence[tuple[str, object, Column | Callable[[], Column]]]) -> DataFrame:
    """set(column, value) where condition, in order: every match runs, the last wins, later conditions see earlier writes.

    An absent condition is false. Runs of statements on one column whose conditions don't read it fold into one expression.
    """
    for column, value, condition in statements:
        old = F.col(column) if column in df.columns else F.lit(None)
        df = df.withColumn(column, F.when(F.coalesce(condition, F.lit(False)), _value(value)).otherwise(old))
    return df


def classify_priority(df: DataFrame, rules: Sequence[tuple[str, str]] = PRIORITY_RULES, memory: str | None = "memory_value", threshold: int = MEDIUM_MEMORY, name: str = "exe") -> DataFrame:
    """Adds priority: of the statements that match, the last; low if none does. Medium also needs memory above the threshold.

    Without a memory column (or memory=None) nothing is medium, as in the literal reading, where that attribute is always absent.
    """
    priority = F.lit(None).cast("string")
    large = gt(memory, threshold) if memory and memory in df.columns else F.lit(False)
    for level, pattern in rules:
        priority = F.when(matches(name, pattern) & large if level == "medium" else matches(name, pattern), level).otherwise(priority)
    return df.withColumn("priority", F.coalesce(priority, F.lit("low")))


def classify_category(df: DataFrame, rules: Sequence[tuple[str, str]] = CATEGORY_RULES, name: str = "exe") -> DataFrame:
    """Low-priority rows are marked for aggregation; every row gets the category of its name, marked ones without one 'other'."""
    low = eq("priority", "low")
    category = F.lit(None).cast("string")
    for label, pattern in rules:
        category = F.when(matches(name, pattern), label).otherwise(category)
    return df.withColumn("aggregate", F.when(low, "true")).withColumn("category", F.coalesce(category, F.when(low, "other")))


def process_group(df: DataFrame, patterns: Mapping[str, str], name: str = "exe") -> DataFrame:
    group = F.col(name)
    for label, pattern in patterns.items():
        group = F.when(matches(name, pattern), label).otherwise(group)
    return df.withColumn("process_group", group)


def replace_pattern(df: DataFrame, column: str, regex: str, replacement: str) -> DataFrame:
    return df.withColumn(column, F.regexp_replace(column, regex, replacement))


def rename_aggregated(df: DataFrame, name: str = "exe") -> DataFrame:
    return df.withColumn(name, F.when(F.col("category").isNotNull(), F.concat(F.lit("aggregated_"), "category")).otherwise(F.col(name)))


def tag_environment(df: DataFrame, rules: Mapping[str, str], source: str = "host_name") -> DataFrame:
    return apply_statements(df, [("environment", label, matches(source, pattern)) for label, pattern in rules.items()])


def process_age(df: DataFrame, now: str | None = None, created_ns: str = "create_time_ns") -> DataFrame:
    """Seconds from creation to the given time, so that results repeat, or to the time of the query."""
    at = now_() if now is None else F.lit(now).cast("timestamp")
    return df.withColumn("age_seconds", F.unix_micros(at) / 1e6 - F.col(created_ns) / 1e9)


def alias_metrics(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return df.withColumn("metric", F.coalesce(F.try_element_at(table, F.col("metric")), F.col("metric")))


def split_metric(df: DataFrame, metric: str, label: str, names: Mapping[str, str], labels: str = "attrs") -> DataFrame:
    """A metric whose identity depends on a label becomes one metric for each value named, such as reads and writes of disk I/O.

    It is split before deltas are taken, since each value counts on its own. Points of the metric with another value or none keep its name.
    """
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    split = F.try_element_at(table, F.try_element_at(F.col(labels), F.lit(label)))
    return df.withColumn("metric", F.when(F.col("metric") == metric, F.coalesce(split, F.col("metric"))).otherwise(F.col("metric")))


def host_facts(df: DataFrame, seconds: int, scrape: int = 10, cpu: str = "process.cpu.utilization") -> DataFrame:
    """The host's CPU and number of processes in the bucket, beside each datapoint.

    CPU is a gauge: it is summed over the processes of a scrape (so many seconds), then averaged over the scrapes of the bucket. The
    facts are aggregated first, by process and scrape, and joined, so a busy host's points need not meet in one task.
    """
    at = df.withColumn("bucket", bucket("ts", seconds))
    used = F.sum(F.when(F.col("metric") == cpu, F.col("value")))
    scrapes = at.groupBy("host_name", "bucket", bucket("ts", scrape).alias("scrape")).agg(used.alias("used")).groupBy("host_name", "bucket").agg(F.avg("used").alias("host_cpu"))
    crowd = at.select("host_name", "bucket", "pid").distinct().groupBy("host_name", "bucket").agg(F.count("pid").alias("host_processes"))
    return at.join(crowd.join(scrapes, ["host_name", "bucket"], "left"), ["host_name", "bucket"], "left")


def with_metric_value(df: DataFrame, metric: str, keys: Sequence[str], seconds: int, name: str) -> DataFrame:
    """The largest value of a metric for the same keys and bucket, on every point of theirs; absent if there is none."""
    from pyspark.sql import Window

    own = F.when(F.col("metric") == metric, F.col("value"))
    return df.withColumn(name, F.max(own).over(Window.partitionBy(*keys, bucket("ts", seconds))))


def cost_score(df: DataFrame, series: Column, w1: float = 0.7, w2: float = 0.3, by: str = "exe") -> DataFrame:
    """w1 x share of all series + w2 x share of all datapoints, by process name."""
    per = df.groupBy(by).agg(F.count_distinct(series).alias("series"), F.count("*").alias("points"))
    total = per.agg(F.sum("series").alias("all_series"), F.sum("points").alias("all_points"))
    return per.crossJoin(F.broadcast(total)).select(by, (w1 * F.col("series") / F.col("all_series") + w2 * F.col("points") / F.col("all_points")).alias("cost_score"))

