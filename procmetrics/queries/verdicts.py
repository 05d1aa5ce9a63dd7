"""Queries that judge variants: summaries, verdicts and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procmetrics import functions as X
from procmetrics.model import CRITICAL, bucket
from procmetrics.operators import aggregates as A
from procmetrics.operators.series import cumulative_to_delta, rate
from procmetrics.plans import alerts as AL
from procmetrics.plans import experiments as E
from procmetrics.queries import query
from procmetrics.queries.metrics import _FOR
from procmetrics.queries.views import BLOCK, DAY, STALE, Views

MINUTES = 43200.0


def _summary(v: Views) -> DataFrame:
    """By host, with a critical process of some hosts taken from the candidate, so that verdicts differ."""
    df = v.variants.where(~((F.col("variant") == "candidate") & (F.col("exe") == "kafka") & F.col("host_name").isin("host-1", "host-4")))
    out = A.metrics_summary(df, ["host_name"], MINUTES, 5000).withColumnRenamed("reduction", "cardinality_reduction")
    covered = F.size(F.filter("coverage", lambda c: c["covered"])) / F.size("coverage")
    return out.withColumns({"critical_coverage": covered, "latency_increase": F.lit(0.05)})


_SUMMARY = f"""(SELECT host_name, sb AS baseline, sc AS candidate, (sb - sc) / nullif(sb, 0) AS cardinality_reduction, nb / {MINUTES} AS baseline_dpm, nc / {MINUTES} AS candidate_dpm, (nb - nc) / nullif(nb, 0) AS cost_reduction, cc / nullif(cb, 0) AS critical_coverage, 0.05 AS latency_increase FROM
    (SELECT host_name, count(DISTINCT CASE WHEN variant = 'baseline' THEN (host_name, pid, metric) END) AS sb, count(DISTINCT CASE WHEN variant = 'candidate' THEN (host_name, pid, metric) END) AS sc, count(*) FILTER (variant = 'baseline') AS nb, count(*) FILTER (variant = 'candidate') AS nc,
    count(DISTINCT CASE WHEN variant = 'baseline' AND regexp_matches(exe, '{CRITICAL}') THEN exe END) AS cb, count(DISTINCT CASE WHEN variant = 'candidate' AND regexp_matches(exe, '{CRITICAL}') THEN exe END) AS cc
    FROM variants WHERE NOT (variant = 'candidate' AND exe = 'kafka' AND host_name IN ('host-1', 'host-4')) GROUP BY 1))"""


@query("a24_metrics_summary", f"SELECT host_name, baseline, candidate, round(cardinality_reduction, 6) AS cardinality_reduction, round(baseline_dpm, 6) AS baseline_dpm, round(cost_reduction, 6) AS cost_reduction, round(critical_coverage, 6) AS critical_coverage FROM {_SUMMARY}")
def _(v):
    return _summary(v).select("host_name", "baseline", "candidate", *[X.round6(F.col(c)).alias(c) for c in ("cardinality_reduction", "baseline_dpm", "cost_reduction", "critical_coverage")])


@query("e1_success", f"SELECT host_name, coalesce(cardinality_reduction >= 0.4, false) AS cardinality_ok, coalesce(critical_coverage >= 1, false) AS critical_ok, coalesce(cost_reduction >= 0.45, false) AS cost_ok, coalesce(cardinality_reduction >= 0.4, false) AND coalesce(critical_coverage >= 1, false) AND coalesce(cost_reduction >= 0.45, false) AS success FROM {_SUMMARY}")
def _(v):
    c = {"min_cardinality_reduction": 0.4, "max_critical_process_loss": 0.0, "max_latency_increase": 0.1, "min_cost_reduction": 0.45}
    return E.evaluate_success(_summary(v), c).select("host_name", "cardinality_ok", "critical_ok", "cost_ok", "success")


@query("e2_health", f"SELECT host_name, CASE WHEN coalesce(critical_coverage < 1, false) OR NOT coalesce(cardinality_reduction > 0, false) THEN 'failing' WHEN cardinality_reduction > 0.4 AND critical_coverage IS NOT NULL THEN 'healthy' ELSE 'attention' END AS health FROM {_SUMMARY}")
def _(v):
    return E.health(_summary(v)).select("host_name", "health")


@query("e3_recommend", f"SELECT host_name, CASE WHEN critical_coverage < 1 THEN 'abort' WHEN cost_reduction > 0.4 THEN 'promote' ELSE 'iterate' END AS recommendation FROM {_SUMMARY}")
def _(v):
    return E.recommend(_summary(v)).select("host_name", "recommendation")


@query(
    "e4_findings",
    f"""SELECT host_name, 'cardinality' AS type, 'info' AS severity FROM {_SUMMARY} WHERE cardinality_reduction > 0.5 UNION ALL SELECT host_name, 'critical_processes', 'critical' FROM {_SUMMARY} WHERE critical_coverage < 1
    UNION ALL SELECT host_name, 'cost', 'warning' FROM {_SUMMARY} WHERE cost_reduction < 0.4""",
)
def _(v):
    return E.findings(_summary(v), "host_name").select("host_name", "type", "severity")


@query("e5_kpi_report", f"SELECT host_name, kpi, round(value, 6) AS value, target, coalesce(value >= target, false) AS met FROM (SELECT host_name, unnest(['cardinality_reduction', 'critical_coverage', 'cost_reduction']) AS kpi, unnest([cardinality_reduction, critical_coverage, cost_reduction]) AS value, CAST(unnest([0.5, 1.0, 0.4]) AS DOUBLE) AS target FROM {_SUMMARY})")
def _(v):
    return E.kpi_report(_summary(v), "host_name").withColumn("value", X.round6(F.col("value")))


@query("e6_fleet_view", f"SELECT d.host_name, d.id, round(s.cardinality_reduction, 6) AS cardinality_reduction FROM (SELECT 'host-' || (key % 7) AS host_name, arg_max(id, (created_at, id)) AS id FROM experiments WHERE completed_at IS NULL GROUP BY 1) d LEFT JOIN {_SUMMARY} s USING (host_name)")
def _(v):
    d = v.experiments.select("id", F.concat(F.lit("host-"), F.col("key") % 7).alias("host_name"), F.col("created_at").alias("deployed_at"), F.col("completed_at").alias("removed_at"))
    return E.fleet_view(d, _summary(v).select("host_name", X.round6(F.col("cardinality_reduction")).alias("cardinality_reduction"))).select("host_name", "id", "cardinality_reduction")


@query("e10_metric_series", f"SELECT metric, array_to_string(list(b || '=' || v ORDER BY b), ',') AS points FROM (SELECT metric, CAST(floor(epoch(ts) / {DAY}) AS BIGINT) * {DAY} AS b, CAST(sum(value) AS BIGINT) AS v FROM raw WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-15' GROUP BY 1, 2) GROUP BY 1")
def _(v):
    at = lambda d: F.lit(d).cast("timestamp")
    out = E.metric_series(v.raw, at("2024-01-05"), at("2024-01-15"), DAY, agg=F.sum)
    return out.select("metric", F.array_join(F.transform("points", lambda p: F.concat_ws("=", p["bucket_start"].cast("string"), p["value"].cast("string"))), ",").alias("points"))


# alerts; steps are days
def _alert(rows: str, keys: str, hold: int) -> str:
    return _FOR.format(keys=keys, hold=hold, step=DAY, rows=rows)


_DAY = f"CAST(floor(epoch(ts) / {DAY}) AS BIGINT) * {DAY}"


def _step(df: DataFrame) -> DataFrame:
    return df.withColumn("step", bucket("ts", DAY) * DAY)


@query("al1_cardinality", _alert(f"SELECT *, series > 25 AS active FROM (SELECT host_name, {_DAY} AS step, count(DISTINCT (host_name, pid, metric)) AS series FROM raw GROUP BY 1, 2)", "host_name", DAY))
def _(v):
    return AL.alert_cardinality(A.cardinality(_step(v.raw), ["host_name", "step"]), ["host_name"], DAY, 25, DAY).select("host_name", "step", "state")


@query(
    "al2_critical_missing",
    _alert(f"SELECT host_name, step, coalesce(c / nullif(b, 0) < 0.95, false) AS active FROM (SELECT host_name, {_DAY} AS step, count(DISTINCT CASE WHEN variant = 'baseline' THEN exe END) AS b, count(DISTINCT CASE WHEN variant = 'candidate' AND pid % 5 > 0 THEN exe END) AS c FROM variants WHERE regexp_matches(exe, '{CRITICAL}') AND (variant = 'baseline' OR pid % 5 > 0) GROUP BY 1, 2)", "host_name", DAY),
)
def _(v):
    df = _step(v.variants.where("variant = 'baseline' OR pid % 5 > 0"))
    return AL.alert_critical_missing(A.critical_coverage(df, ["host_name", "step"]), ["host_name"], DAY, hold=DAY).select("host_name", "step", "state")


@query("al3_memory", _alert(f"SELECT host_name, step, coalesce(m / 2e8 > 0.8, false) AS active FROM (SELECT host_name, {_DAY} AS step, max(CASE WHEN metric = 'process.memory.physical' THEN value END) AS m FROM raw GROUP BY 1, 2)", "host_name", DAY))
def _(v):
    return AL.alert_memory(A.collector_overhead(_step(v.raw), ["host_name", "step"], 2e8, DAY), ["host_name"], DAY, hold=DAY).select("host_name", "step", "state")


@query("al4_cost", _alert(f"SELECT host_name, step, coalesce((c - b) / nullif(b, 0) > 0.1, false) AS active FROM (SELECT host_name, {_DAY} AS step, count(*) FILTER (owner = 'root') AS b, count(*) FILTER (owner = 'app') AS c FROM raw GROUP BY 1, 2)", "host_name", DAY))
def _(v):
    rows = _step(v.raw).groupBy("host_name", "step").agg(F.count_if(F.col("owner") == "root").alias("baseline"), F.count_if(F.col("owner") == "app").alias("candidate"))
    return AL.alert_cost(rows, ["host_name"], DAY, hold=DAY).select("host_name", "step", "state")


@query("al5_down", _alert(f"SELECT host_name, step, n = 0 AS active FROM (SELECT host_name, {_DAY} AS step, count(*) FILTER (metric = 'process.disk.io' AND owner = 'svc' AND value > 5000) AS n FROM raw GROUP BY 1, 2)", "host_name", DAY))
def _(v):
    up = F.when(F.count_if((F.col("metric") == "process.disk.io") & (F.col("owner") == "svc") & (F.col("value") > 5000)) > 0, 1).otherwise(0)
    return AL.alert_down(_step(v.raw).groupBy("host_name", "step").agg(up.alias("up")), ["host_name"], DAY, DAY).select("host_name", "step", "state")


@query("al6_failures", _alert(f"SELECT endpoint, step, f > 0.1 AS active FROM (SELECT user_id % 3 AS endpoint, {_DAY} AS step, count(*) FILTER (status = 500) / count(*) AS f FROM request_log GROUP BY 1, 2)", "endpoint", DAY))
def _(v):
    log = _step(v.request_log).withColumns({"endpoint": F.col("user_id") % 3, "status": F.when(F.col("status") == 500, "failed").otherwise("done")})
    return AL.alert_failures(A.failure_rate(log, ["endpoint", "step"]), ["endpoint"], DAY, hold=DAY).select("endpoint", "step", "state")


@query("al7_deployment", _alert(f"SELECT host_name, step, ready / n < 0.9 AS active FROM (SELECT host_name, {_DAY} AS step, count(*) FILTER (value >= 3000) AS ready, count(*) AS n FROM raw GROUP BY 1, 2)", "host_name", DAY))
def _(v):
    return AL.alert_deployment(A.deployment_ready(_step(v.raw), ["host_name", "step"], F.col("value") >= 3000), ["host_name"], DAY, hold=DAY).select("host_name", "step", "state")


@query("al8_render", f"SELECT host_name, 'Collector ' || host_name || ' is using ' || printf('%.2f%%', max(value) / 2e8 * 100) || ' of its memory limit' AS message FROM raw WHERE metric = 'process.memory.physical' GROUP BY 1")
def _(v):
    m = v.raw.where(X.eq("metric", "process.memory.physical")).groupBy("host_name").agg(F.max("value").alias("m"))
    return AL.render_alert(m, ["Collector ", F.col("host_name"), " is using ", X.percent_text(F.col("m") / 2e8), " of its memory limit"]).select("host_name", "message")


@query("al6_rate", f"SELECT point_id, round(sum(value) OVER (PARTITION BY host_name, pid, metric ORDER BY epoch_us(ts) RANGE BETWEEN {BLOCK * 1000000 - 1} PRECEDING AND CURRENT ROW)::DOUBLE / {BLOCK}, 6) AS rate FROM base WHERE metric = 'process.disk.io'")
def _(v):
    d = cumulative_to_delta(v.datapoints.where(X.eq("metric", "process.disk.io")), max_staleness=STALE)
    return rate(d, BLOCK).select("point_id", X.round6(F.col("rate")).alias("rate"))
