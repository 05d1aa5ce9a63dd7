"""Sorts, limits, top-k and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procmetrics.operators.filters import search_experiments


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key. One aggregation with map-side combining, so no key's rows are sorted or gathered."""
    others = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_row"))
    return newest.select(*keys, *[F.col("_row")[c].alias(c) for c in others])


def rank_by(df: DataFrame, value: str, by: Sequence[str], tie: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(value))
    return df.withColumns({"rank": F.rank().over(w), "dense_rank": F.dense_rank().over(w), "row_number": F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), *tie))})


def list_experiments(df: DataFrame, owner: str | None = None, status: str | None = None, text: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page by creation, newest first, with total and has_more. limit is 1 to 100. The total is a separate count, not a window over all rows."""
    limit = min(max(limit, 1), 100)
    found = search_experiments(df, owner, status, text)
    total = found.agg(F.count("*").alias("total"))
    page = found.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)


def page_after(df: DataFrame, order: str, key: str, cursor: tuple | None, limit: int) -> DataFrame:
    """The rows after the cursor (order value, key), by order falling, then key."""
    if cursor:
        df = df.where((F.col(order) < cursor[0]) | ((F.col(order) == cursor[0]) & (F.col(key) > cursor[1])))
    return df.orderBy(F.desc(order), key).limit(limit)


def sort_by(df: DataFrame, spec: str) -> DataFrame:
    """'field:asc,other:desc'; ascending without a direction."""
    parts = [s.strip().partition(":") for s in spec.split(",")]
    return df.orderBy(*[F.desc(c) if d == "desc" else F.asc(c) for c, _, d in parts])


def top_labels(df: DataFrame, labels: Sequence[str], n: int = 20) -> DataFrame:
    return df.groupBy(*labels).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *labels).limit(n)


def _ranked(df: DataFrame, metric: str, by: Sequence[str], name: str, agg=F.sum) -> DataFrame:
    totals = df.where(F.col("metric") == metric).groupBy(*by, name).agg(agg("value").alias("total"))
    return totals.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("total"), name)))


def best_names(df: DataFrame, metric: str, k: int, by: Sequence[str], name: str = "pid") -> DataFrame:
    """(by, name) of the k largest totals of the metric in each group; ties go to the smaller name."""
    return _ranked(df, metric, by, name).where(F.col("place") <= k).select(*by, name)


def top_k(df: DataFrame, metric: str, k: int, by: Sequence[str], name: str = "pid") -> DataFrame:
    """All points of the k names of largest total of the metric in each group. Totals are made before ranking, and few names are joined back."""
    return df.join(best_names(df, metric, k, by, name), [*by, name], "left_semi")


def top_k_with_rest(df: DataFrame, metric: str, k: int, by: Sequence[str], name: str = "pid") -> DataFrame:
    """(by, name, total): the k largest, and the others as one row named 'other'."""
    label = F.when(F.col("place") <= k, F.col(name).cast("string")).otherwise("other")
    return _ranked(df, metric, by, name).groupBy(*by, label.alias("name")).agg(F.sum("total").alias("total"))


def run_variants(df: DataFrame, variants: Mapping[str, object]) -> DataFrame:
    """The same input through each variant's pipeline, tagged and united by column name."""
    out = None
    for name, step in variants.items():
        one = df.transform(step).withColumn("variant", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def process_set_diff(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, state): lost, kept or new, by which variants have the process. One aggregation instead of three set operations."""
    has = lambda v: F.max(F.when(F.col("variant") == v, 1).otherwise(0))
    sides = df.groupBy(*keys).agg(has("baseline").alias("b"), has("candidate").alias("c"))
    return sides.where("b + c > 0").select(*keys, F.when(F.expr("b = 1 and c = 1"), "kept").when(F.col("b") == 1, "lost").otherwise("new").alias("state"))


def distinct_series(df: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    return df.select(*keys).distinct()
