"""Checks over tables of experiments, pipelines and requests. Errors are arrays of texts; no errors give an empty array."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procmetrics.functions import full_match, is_in, matches
from procmetrics.operators.transforms import small


def _errors(tests: Mapping[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), text) for text, ok in tests.items()]), lambda e: e.isNotNull())


def validate_specs(df: DataFrame, longest_name: int = 63) -> DataFrame:
    """Adds errors: name of 3 to 63, duration pattern, exactly a baseline and a candidate, a node at least in each."""
    names = F.array_sort(F.transform("variants", lambda v: v["name"]))
    return df.withColumn(
        "errors",
        _errors(
            {
                "name length": F.length("name").between(3, longest_name),
                "duration": full_match("duration", "[0-9]+[hm]"),
                "two variants": F.size("variants") == 2,
                "baseline and candidate": names == F.array(F.lit("baseline"), F.lit("candidate")),
                "nodes": F.forall("variants", lambda v: F.size(v["nodes"]) >= 1),
            }
        ),
    )


def validate_pipelines(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """(pipeline, errors): memory limiter first, batch last, detection present, edges between known steps."""
    shape = steps.groupBy("pipeline").agg(F.min_by("processor", "pos").alias("first"), F.max_by("processor", "pos").alias("last"), F.max(F.col("processor") == "resourcedetection").alias("detects"))
    ends = edges.select("pipeline", F.explode(F.array("source", "target")).alias("processor")).distinct()
    loose = ends.join(steps.select("pipeline", "processor"), ["pipeline", "processor"], "left_anti").groupBy("pipeline").agg(F.count("*").alias("loose"))
    return shape.join(loose, "pipeline", "left").select(
        "pipeline", _errors({"memory_limiter first": F.col("first") == "memory_limiter", "batch last": F.col("last") == "batch", "resourcedetection": F.col("detects"), "edges": F.coalesce("loose", F.lit(0)) == 0}).alias("errors")
    )


def check_constraints(df: DataFrame, statuses: Sequence[str]) -> DataFrame:
    """Rows that break a constraint, with the errors."""
    checked = df.withColumn(
        "errors",
        _errors({"status": is_in("status", statuses), "started": F.col("started_at").isNull() | (F.col("started_at") >= F.col("created_at")), "completed": F.col("completed_at").isNull() | (F.col("completed_at") >= F.col("started_at"))}),
    )
    return checked.where(F.size("errors") > 0)


def not_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def check_ids(df: DataFrame, column: str = "id", pattern: str = "^exp-[a-z0-9]{8}$") -> DataFrame:
    return df.withColumn("valid", matches(column, pattern))


def rate_limit_breaches(df: DataFrame, limits: DataFrame, seconds: int = 60, anchor: str = "clock") -> DataFrame:
    """(user_id, endpoint, window_start, requests, max_requests) with more requests than allowed; windows start on the clock.

    With anchor='first' a user's window starts at the first request after the one before has run out. Each start depends on the one
    before, so requests are first counted by second; the seconds of a user and endpoint then pass in order, a batch at a time, and
    only the running window is kept.
    """
    second = df.select("user_id", "endpoint", F.unix_seconds("ts").alias("at"))
    if anchor == "first":

        def windows(batches):
            last, start = None, 0
            for pdf in batches:
                user, endpoint, at = (pdf[c].to_numpy() for c in ("user_id", "endpoint", "at"))
                starts = np.empty(len(at), np.int64)
                edge = [0, *(np.flatnonzero((user[1:] != user[:-1]) | (endpoint[1:] != endpoint[:-1])) + 1).tolist(), len(at)]
                for k, stop in zip(edge, edge[1:], strict=False):  # a user and endpoint; then from window to window
                    running = k < stop and (user[k], endpoint[k]) == last
                    while k < stop:
                        start, running = start if running else at[k], False
                        n = k + int(np.searchsorted(at[k:stop], start + seconds))
                        starts[k:n], k = start, n
                        last = (user[stop - 1], endpoint[stop - 1])
                yield pdf.assign(window_start=starts)[["user_id", "endpoint", "window_start", "n"]]

        counted = second.groupBy("user_id", "endpoint", "at").agg(F.count("*").alias("n"))
        sorted_ = counted.repartition("user_id", "endpoint").sortWithinPartitions("user_id", "endpoint", "at")
        placed = sorted_.mapInPandas(windows, "user_id long, endpoint string, window_start long, n long")
    else:
        placed = second.withColumns({"window_start": (F.floor(F.col("at") / seconds) * seconds).cast("long"), "n": F.lit(1)})
    counts = placed.groupBy("user_id", "endpoint", "window_start").agg(F.sum("n").alias("requests"))
    return counts.join(small(limits), "endpoint").where(F.col("requests") > F.col("max_requests")).select("user_id", "endpoint", "window_start", "requests", "max_requests")


def indistinct_variants(df: DataFrame, by: Sequence[str], series: Sequence[str]) -> DataFrame:
    """Groups whose variants have the same set of series: each series then has both."""
    sides = df.select(*by, *series, "variant").distinct().groupBy(*by, *series).agg(F.count("*").alias("n"))
    return sides.groupBy(*by).agg(F.min("n").alias("least"), F.count("*").alias("series")).where("least = 2").drop("least")
