"""Queries on control-plane tables: listing, paging, histories and quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from procmetrics import functions as X
from procmetrics.operators import ranking as L
from procmetrics.plans import experiments as E
from procmetrics.plans import quality as Q
from procmetrics.queries import query
from procmetrics.queries.views import DAY, PHASE_OF

_TOTAL = "(SELECT count(*) FROM experiments WHERE status = 'running')"


@query("l1_list_experiments", f"SELECT id, owner, {_TOTAL} AS total, {_TOTAL} > 60 AS has_more FROM experiments WHERE status = 'running' ORDER BY created_at DESC, id LIMIT 20 OFFSET 40")
def _(v):
    return L.list_experiments(v.experiments, status="running", limit=20, offset=40).select("id", "owner", "total", "has_more")


@query("w6_total_beside_rows", "SELECT id, (SELECT count(*) FROM experiments) AS total FROM experiments ORDER BY created_at DESC, id LIMIT 100")
def _(v):
    return L.list_experiments(v.experiments, limit=500).select("id", "total")


@query("l2_page_after", "SELECT id FROM experiments WHERE created_at < TIMESTAMP '1996-06-01' OR (created_at = TIMESTAMP '1996-06-01' AND id > 'exp-5') ORDER BY created_at DESC, id LIMIT 25")
def _(v):
    return L.page_after(v.experiments, "created_at", "id", (F.lit("1996-06-01 00:00:00").cast("timestamp"), "exp-5"), 25).select("id")


@query("l3_sort_by", "SELECT id, name FROM experiments ORDER BY name, cents DESC, id")
def _(v):
    return L.sort_by(v.experiments, "name:asc,cents:desc,id").select("id", "name")


_NEXT = "SELECT *, lead(phase) OVER w AS next_phase, lead(created_at) OVER w AS next_at FROM experiment_events WINDOW w AS (PARTITION BY experiment_id ORDER BY created_at, seq)"


@query("e7_phase_durations", f"SELECT phase, count(*) AS n, CAST(sum(epoch(next_at) - epoch(created_at)) AS BIGINT) AS seconds FROM ({_NEXT}) WHERE next_at IS NOT NULL GROUP BY 1")
def _(v):
    return E.phase_durations(v.experiment_events)


@query("e7_bad_transitions", f"SELECT phase, next_phase, count(*) AS n FROM ({_NEXT}) WHERE next_phase <> phase AND phase || '>' || next_phase NOT IN ({', '.join(repr(f'{a}>{b}') for a, b in E.TRANSITIONS)}) GROUP BY 1, 2")
def _(v):
    return E.bad_transitions(v.experiment_events)


@query("e8_guard_violations", "SELECT experiment_id, seq, action, state FROM (SELECT *, lag(phase) OVER (PARTITION BY experiment_id ORDER BY created_at, seq) AS state FROM experiment_events) WHERE (action IN ('update', 'delete') AND coalesce(state = 'running', false)) OR (action = 'promote' AND state IS DISTINCT FROM 'completed')")
def _(v):
    return E.guard_violations(v.experiment_events).select("experiment_id", "seq", "action", "state")


@query("e9_durations", "SELECT status, coalesce(CAST(epoch(completed_at) - epoch(started_at) AS BIGINT), -1) AS duration_seconds, count(*) AS n FROM experiments GROUP BY 1, 2")
def _(v):
    return E.experiment_durations(v.experiments).fillna(-1, ["duration_seconds"]).groupBy("status", "duration_seconds").agg(F.count("*").alias("n"))


@query(
    "dq1_validate_specs",
    """SELECT id, CASE WHEN key % 11 = 0 THEN 'name length,' ELSE '' END || CASE WHEN key % 7 = 0 THEN 'duration,' ELSE '' END || CASE WHEN key % 5 = 0 THEN 'two variants,baseline and candidate,' ELSE '' END || CASE WHEN key % 3 = 0 THEN 'nodes,' ELSE '' END AS errors FROM experiments""",
)
def _(v):
    nodes = F.when(F.col("key") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("n1")))
    variant = lambda n: F.struct(F.lit(n).alias("name"), nodes.alias("nodes"))
    specs = v.experiments.select(
        "id", F.when(F.col("key") % 11 == 0, "x").otherwise(F.col("name")).alias("name"), F.when(F.col("key") % 7 == 0, "soon").otherwise("24h").alias("duration"), F.when(F.col("key") % 5 == 0, F.array(variant("baseline"))).otherwise(F.array(variant("candidate"), variant("baseline"))).alias("variants")
    )
    return Q.validate_specs(specs).select("id", F.array_join(F.transform("errors", lambda e: F.concat(e, F.lit(","))), "").alias("errors"))


@query(
    "dq2_validate_pipelines",
    """SELECT o_orderkey AS pipeline, CASE WHEN o_orderkey % 3 = 0 THEN 'memory_limiter first,' ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN 'batch last,' ELSE '' END || CASE WHEN o_orderkey % 7 = 0 THEN 'edges,' ELSE '' END AS errors FROM orders""",
)
def _(v):
    k = F.col("pipeline")
    orders = v.table("orders").select(F.col("o_orderkey").alias("pipeline"))
    first, last = F.when(k % 3 == 0, "transform").otherwise("memory_limiter"), F.when(k % 5 == 0, "filter").otherwise("batch")
    steps = orders.select("pipeline", F.posexplode(F.array(first, F.lit("resourcedetection"), last)).alias("pos", "processor"))
    edges = orders.select("pipeline", F.lit("resourcedetection").alias("source"), F.when(k % 7 == 0, "nowhere").otherwise(last).alias("target"))
    return Q.validate_pipelines(steps, edges).select("pipeline", F.array_join(F.transform("errors", lambda e: F.concat(e, F.lit(","))), "").alias("errors"))


@query("dq3_constraints", "SELECT id, CASE WHEN key % 13 = 0 THEN 'status' ELSE 'completed' END AS first_error FROM experiments WHERE key % 13 = 0 OR (completed_at IS NOT NULL AND key % 4 = 0)")
def _(v):
    bad = v.experiments.withColumns({"status": F.when(F.col("key") % 13 == 0, "odd").otherwise(F.col("status")), "completed_at": F.when(F.col("key") % 4 == 0, F.col("completed_at") - F.make_dt_interval(F.lit(30))).otherwise(F.col("completed_at"))})
    return Q.check_constraints(bad, PHASE_OF).select("id", F.get("errors", F.lit(0)).alias("first_error"))


@query("dq3_not_unique", "SELECT owner, name, count(*) AS n FROM experiments GROUP BY 1, 2 HAVING count(*) > 1")
def _(v):
    return Q.not_unique(v.experiments, ["owner", "name"])


@query("dq4_check_ids", "SELECT id, regexp_matches('exp-' || lpad(CAST(key AS VARCHAR), CASE WHEN key % 2 = 0 THEN 8 ELSE 7 END, '0'), '^exp-[a-z0-9]{8}$') AS valid FROM experiments")
def _(v):
    padded = F.concat(F.lit("exp-"), F.when(F.col("key") % 2 == 0, F.lpad(F.col("key").cast("string"), 8, "0")).otherwise(F.lpad(F.col("key").cast("string"), 7, "0")))
    return Q.check_ids(v.experiments.withColumn("padded", padded), "padded").select("id", "valid")


@query("dq5_rate_limit", f"SELECT user_id, endpoint, CAST(floor(epoch(ts) / {DAY}) AS BIGINT) * {DAY} AS window_start, count(*) AS requests, max(m) AS max_requests FROM request_log JOIN (VALUES ('view', 1), ('click', 2)) l(endpoint, m) USING (endpoint) GROUP BY 1, 2, 3 HAVING count(*) > max(m)")
def _(v):
    limits = v.spark.createDataFrame([("view", 1), ("click", 2)], "endpoint string, max_requests int")
    return Q.rate_limit_breaches(v.request_log, limits, DAY)


@query(
    "dq5_rate_limit_first",
    f"""WITH RECURSIVE r AS (SELECT user_id, endpoint, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM request_log WHERE endpoint IN ('view', 'click')),
    w(user_id, endpoint, s) AS (SELECT user_id, endpoint, min(t) FROM r GROUP BY 1, 2 UNION ALL SELECT w.user_id, w.endpoint, min(r.t) FROM w JOIN r ON r.user_id = w.user_id AND r.endpoint = w.endpoint AND r.t >= w.s + {DAY} GROUP BY w.user_id, w.endpoint, w.s)
    SELECT w.user_id, w.endpoint, w.s AS window_start, count(*) AS requests, max(CASE w.endpoint WHEN 'view' THEN 1 ELSE 2 END) AS max_requests FROM w JOIN r ON r.user_id = w.user_id AND r.endpoint = w.endpoint AND r.t >= w.s AND r.t < w.s + {DAY}
    GROUP BY 1, 2, 3 HAVING count(*) > max(CASE w.endpoint WHEN 'view' THEN 1 ELSE 2 END)""",
)
def _(v):
    limits = v.spark.createDataFrame([("view", 1), ("click", 2)], "endpoint string, max_requests int")
    return Q.rate_limit_breaches(v.request_log, limits, DAY, anchor="first")


@query("dq6_indistinct_variants", "SELECT host_name, exe, count(*) AS series FROM (SELECT host_name, exe, pid, metric, count(DISTINCT variant) AS n FROM variants GROUP BY ALL) GROUP BY 1, 2 HAVING min(n) = 2")
def _(v):
    return Q.indistinct_variants(v.variants, ["host_name", "exe"], ["pid", "metric"])


@query("x_duration_interval", "SELECT id, format('INTERVAL ''{} {:02d}:{:02d}:00'' DAY TO SECOND', m // 1440, m // 60 % 24, m % 60) AS duration FROM (SELECT id, key % 50 * CASE WHEN key % 2 = 0 THEN 60 ELSE 1 END AS m FROM experiments)")
def _(v):
    text = F.concat((F.col("key") % 50).cast("string"), F.when(F.col("key") % 2 == 0, "h").otherwise("m"))
    return v.experiments.select("id", X.duration_interval(text).cast("string").alias("duration"))
