"""Verdicts and histories of experiments. Ratios are 0 to 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procmetrics.functions import gt, lt
from procmetrics.operators.ranking import latest_by
from procmetrics.operators.series import resample


def evaluate_success(summary: DataFrame, criteria: dict[str, float]) -> DataFrame:
    """Adds a boolean for each criterion and their conjunction; an absent figure fails."""
    tests = {
        "cardinality_ok": F.coalesce(F.col("cardinality_reduction") >= criteria["min_cardinality_reduction"], F.lit(False)),
        "critical_ok": F.coalesce(1 - F.col("critical_coverage") <= criteria["max_critical_process_loss"], F.lit(False)),
        "latency_ok": F.coalesce(F.col("latency_increase") <= criteria["max_latency_increase"], F.lit(False)),
        "cost_ok": F.coalesce(F.col("cost_reduction") >= criteria["min_cost_reduction"], F.lit(False)),
    }
    return summary.withColumns(tests).withColumn("success", F.col("cardinality_ok") & F.col("critical_ok") & F.col("latency_ok") & F.col("cost_ok"))


def health(summary: DataFrame) -> DataFrame:
    """The first that holds: failing (a critical process is missing, or no reduction), healthy (over 40 % and all there), attention."""
    failing = lt("critical_coverage", 1.0) | ~gt("cardinality_reduction", 0.0)
    return summary.withColumn("health", F.when(failing, "failing").when(gt("cardinality_reduction", 0.4) & F.col("critical_coverage").isNotNull(), "healthy").otherwise("attention"))


def recommend(summary: DataFrame, least_saving: float = 0.4, stable: Column | None = None) -> DataFrame:
    """abort if critical processes are missing; promote if savings pass the target and it is stable; else iterate."""
    promote = gt("cost_reduction", least_saving) & ~lt("critical_coverage", 1.0) & (F.lit(True) if stable is None else F.coalesce(stable, F.lit(False)))
    return summary.withColumn("recommendation", F.when(lt("critical_coverage", 1.0), "abort").when(promote, "promote").otherwise("iterate"))


def findings(summary: DataFrame, key: str) -> DataFrame:
    """(key, type, severity, message) rows of what stands out."""
    percent = lambda c: F.format_string("%.1f", F.col(c) * 100)
    rows = F.array(
        F.when(gt("cardinality_reduction", 0.5), F.struct(F.lit("cardinality").alias("type"), F.lit("info").alias("severity"), F.concat(F.lit("Series reduced by "), percent("cardinality_reduction"), F.lit("%")).alias("message"))),
        F.when(lt("critical_coverage", 1.0), F.struct(F.lit("critical_processes").alias("type"), F.lit("critical").alias("severity"), F.concat(F.lit("Critical coverage is "), percent("critical_coverage"), F.lit("%")).alias("message"))),
        F.when(lt("cost_reduction", 0.4), F.struct(F.lit("cost").alias("type"), F.lit("warning").alias("severity"), F.concat(F.lit("Cost reduced by only "), percent("cost_reduction"), F.lit("%")).alias("message"))),
    )
    return summary.select(key, F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("f")).select(key, "f.type", "f.severity", "f.message")


# Acceptance targets, as ratios.
TARGETS = {"cardinality_reduction": 0.5, "critical_coverage": 1.0, "cost_reduction": 0.4}


def kpi_report(summary: DataFrame, key: str) -> DataFrame:
    """(key, kpi, value, target, met) rows."""
    target = F.create_map(*[F.lit(x) for pair in TARGETS.items() for x in pair])
    long = summary.select(key, *[F.col(k).cast("double").alias(k) for k in TARGETS]).unpivot([key], list(TARGETS), "kpi", "value")
    return long.withColumn("target", target[F.col("kpi")]).withColumn("met", F.coalesce(F.col("value") >= F.col("target"), F.lit(False)))


def fleet_view(deployments: DataFrame, kpis: DataFrame) -> DataFrame:
    """The newest deployment of each host that isn't removed, with the host's figures."""
    active = latest_by(deployments.where(F.col("removed_at").isNull()), ["host_name"], ["deployed_at", "id"])
    return active.join(kpis, "host_name", "left")


# Transitions that are allowed.
TRANSITIONS = [("pending", "generating"), ("generating", "deploying"), ("deploying", "running"), ("running", "analyzing"), ("analyzing", "completed"), *((p, e) for p in ("pending", "generating", "deploying", "running", "analyzing") for e in ("failed", "cancelled"))]


def _steps(events: DataFrame) -> DataFrame:
    w = Window.partitionBy("experiment_id").orderBy("created_at", "seq")
    return events.withColumns({"next_phase": F.lead("phase").over(w), "next_at": F.lead("created_at").over(w)})


def phase_durations(events: DataFrame) -> DataFrame:
    """(phase, n, seconds): how long phases lasted until the next event; last phases are open and don't count."""
    open_ = _steps(events).where(F.col("next_at").isNotNull())
    return open_.groupBy("phase").agg(F.count("*").alias("n"), F.sum(F.unix_seconds("next_at") - F.unix_seconds("created_at")).alias("seconds"))


def bad_transitions(events: DataFrame) -> DataFrame:
    """(phase, next_phase, n) of changes that aren't allowed; staying in a phase is no change."""
    moved = _steps(events).where(F.col("next_phase").isNotNull() & (F.col("next_phase") != F.col("phase")))
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, b in TRANSITIONS])
    return moved.where(~F.array_contains(allowed, F.concat_ws(">", "phase", "next_phase"))).groupBy("phase", "next_phase").agg(F.count("*").alias("n"))


def guard_violations(events: DataFrame) -> DataFrame:
    """Actions at odds with the phase before them: update or delete while running, promote when not completed."""
    w = Window.partitionBy("experiment_id").orderBy("created_at", "seq").rowsBetween(Window.unboundedPreceding, -1)
    state = events.withColumn("state", F.last("phase", True).over(w))
    bad = (F.col("action").isin("update", "delete") & (F.col("state") == "running")) | ((F.col("action") == "promote") & ~F.col("state").eqNullSafe("completed"))
    return state.where(F.coalesce(bad, F.lit(False)))


def experiment_durations(df: DataFrame) -> DataFrame:
    return df.withColumn("duration_seconds", F.unix_seconds("completed_at") - F.unix_seconds("started_at"))


def metric_series(df: DataFrame, start: Column, end: Column, seconds: int, keys=("metric",), agg=F.avg) -> DataFrame:
    """One row a series: arrays of (bucket start, value) in time order; bounded by the number of buckets between start and end."""
    points = resample(df.where((F.col("ts") >= start) & (F.col("ts") < end)), seconds, agg, list(keys))
    return points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bucket_start", "value"))).alias("points"))
