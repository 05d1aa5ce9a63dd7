"""Filters, sampling and routing."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procmetrics.functions import any_of, eq, gt, hash_bucket, ilike, is_in, lt, ne, pick
from procmetrics.model import PROCESS, bucket
from procmetrics.operators.transforms import host_facts, small


def filter_datapoints(df: DataFrame, conditions: Sequence[Column], mode: str) -> DataFrame:
    """Keeps or drops rows that meet any condition; an absent condition is not met."""
    if mode not in ("keep", "drop"):
        raise ValueError(mode)
    met = any_of([F.coalesce(c, F.lit(False)) for c in conditions])
    return df.where(met if mode == "keep" else ~met)


#: Conditions on promoted resource columns hold for all points of a resource alike.
filter_resource = filter_datapoints


def keep_important(df: DataFrame) -> DataFrame:
    return filter_datapoints(df, [is_in("priority", ["critical", "high", "medium"])], "keep")


def split_aggregate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows on their own (the mark absent or not true), and rows to be aggregated."""
    return filter_datapoints(df, [ne("aggregate", "true")], "keep"), filter_datapoints(df, [eq("aggregate", "true")], "keep")


def drop_low_consumers(df: DataFrame, thresholds: Mapping[str, float]) -> DataFrame:
    return filter_datapoints(df, [eq("metric", m) & lt("value", x) for m, x in thresholds.items()], "drop")


def keep_high_consumers(df: DataFrame, cpu: float, memory: float, seconds: int) -> DataFrame:
    """All points of a process in a bucket where its CPU or memory passes the bound."""
    at = df.withColumn("bucket", bucket("ts", seconds))
    high = (eq("metric", "process.cpu.utilization") & gt("value", cpu)) | (eq("metric", "process.memory.physical") & gt("value", memory))
    return at.join(at.where(high).select(*PROCESS, "bucket").distinct(), [*PROCESS, "bucket"], "left_semi").drop("bucket")


def adaptive_conditions(cpu_hi: float, n_hi: int, cpu_lo: float) -> list[Column]:
    """What the adaptive filter drops: low-priority rows of a busy host; low-priority rows of little CPU of a crowded host."""
    low = eq("priority", "low")
    quiet = low & eq("metric", "process.cpu.utilization") & lt("value", cpu_lo)
    return [low & gt("host_cpu", cpu_hi), quiet & gt("host_processes", n_hi)]


def adaptive_filter(df: DataFrame, cpu_hi: float, n_hi: int, cpu_lo: float, seconds: int, scrape: int = 10) -> DataFrame:
    """On a busy host low-priority rows go; on a crowded host low-priority rows of little CPU go. scrape: seconds between scrapes."""
    return filter_datapoints(host_facts(df, seconds, scrape), adaptive_conditions(cpu_hi, n_hi, cpu_lo), "drop")


def drop_old_low(df: DataFrame, seconds: float = 300) -> DataFrame:
    return filter_datapoints(df, [gt("age_seconds", seconds) & eq("priority", "low")], "drop")


def drop_cheap(df: DataFrame, scores: DataFrame, min_score: float = 0.1, by: str = "exe") -> DataFrame:
    return df.join(small(scores), by, "left").where(~lt("cost_score", min_score))


def protect_critical(conditions: Sequence[Column], critical: Sequence[str], name: str = "exe") -> list[Column]:
    """Conditions of a keep filter that the listed processes always pass."""
    return [*conditions, is_in(name, critical)]


def sample_hash(df: DataFrame, key: str | Column, percent: float, seed: int = 22) -> DataFrame:
    """The same keys every time, everywhere; a larger percentage keeps all that a smaller one kept."""
    return df.where(hash_bucket(key, seed) < percent * 100)


def sample_by_priority(df: DataFrame, percents: Mapping[str, float], key: str | Column, seed: int = 22) -> DataFrame:
    """A percentage for each priority; others are kept whole."""
    table = F.create_map(*[F.lit(x) for p, pct in percents.items() for x in (p, float(pct * 100))])
    return df.where(hash_bucket(key, seed) < F.coalesce(F.try_element_at(table, F.col("priority")), F.lit(10000.0)))


def route(df: DataFrame, attribute: str, table: Mapping[str, Sequence[str]], default: Sequence[str]) -> DataFrame:
    """A row for each route of the attribute's value."""
    routes = F.array(*[F.lit(r) for r in default])
    for value, names in table.items():
        routes = F.when(eq(attribute, value), F.array(*[F.lit(n) for n in names])).otherwise(routes)
    return df.withColumn("route", F.explode(routes))


def select_targets(df: DataFrame, hosts: DataFrame, selector: Mapping[str, str], nodes: Sequence[str] = (), labels: str = "labels") -> DataFrame:
    """Rows of hosts with all the labels, or named."""
    met = F.lit(True) if selector or not nodes else F.lit(False)
    for k, v in selector.items():
        met = met & eq(pick(labels, k), v)
    chosen = hosts.where(met | is_in("host_name", nodes) if nodes else met).select("host_name").distinct()
    return df.join(small(chosen), "host_name", "left_semi")


def rollout_cohort(hosts: DataFrame, percent: float, seed: int = 22) -> DataFrame:
    return sample_hash(hosts, "host_name", percent, seed)


_OPS: dict[str, Callable[[Column, object], Column]] = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "lt": lambda c, v: c < v,
    "gte": lambda c, v: c >= v,
    "lte": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(list(v)),
    "like": lambda c, v: c.like(v),
}


def where_ops(df: DataFrame, conditions: Sequence[tuple[str, str, object]]) -> DataFrame:
    """All of (column, operator, value), with SQL's nulls."""
    for column, op, value in conditions:
        df = df.where(_OPS[op](F.col(column), value))
    return df


def visible_to(df: DataFrame, user: str, roles: Sequence[str] = ()) -> DataFrame:
    return df if "admin" in roles else df.where(F.col("owner") == user)


def get_experiment(df: DataFrame, experiment_id: str) -> DataFrame:
    return df.where(F.col("id") == experiment_id)


def search_experiments(df: DataFrame, owner: str | None = None, status: str | None = None, text: str | None = None) -> DataFrame:
    """Filters that are given; text is sought in the name without regard to case."""
    if owner is not None:
        df = df.where(F.col("owner") == owner)
    if status is not None:
        df = df.where(F.col("status") == status)
    return df if text is None else df.where(ilike("name", text))
