"""Queries over stored tables: recorded series, sketches, updates in place and tables by process; and over label-dependent metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from procmetrics import functions as X
from procmetrics import sources as S
from procmetrics.model import ALL_COUNTERS, DISK_IO, bucket
from procmetrics.operators import aggregates as A
from procmetrics.operators import joins as J
from procmetrics.operators import series as W
from procmetrics.operators import sketches as H
from procmetrics.operators import transforms as P
from procmetrics.plans import pipelines as N
from procmetrics.plans import recording as R
from procmetrics.queries import query
from procmetrics.queries.views import BLOCK, DAY, STALE
from procmetrics.sources import stored

_DAY = f"CAST(floor(epoch(ts) / {DAY}) AS BIGINT)"
_BLOCK = f"CAST(floor(epoch(ts) / {BLOCK}) AS BIGINT)"
_SERIES = "count(DISTINCT (host_name, pid, metric))"

# cardinality with subtotals
for _mode, _sql in (("rollup", "ROLLUP (host_name, owner)"), ("cube", "CUBE (host_name, owner)"), ("sets", "GROUPING SETS ((host_name), (owner), ())")):

    @query(
        f"a16_series_{_mode}",
        f"SELECT host_name, owner, CAST(GROUPING(host_name, owner) AS BIGINT) AS level, {_SERIES} AS series, count(*) AS points, CAST(sum(value) AS BIGINT) AS value, round({_SERIES} / (SELECT {_SERIES} FROM raw), 6) AS share, round({_SERIES} * 0.002, 6) AS cost FROM raw GROUP BY {_sql}",
    )
    def _(v, mode=_mode):
        out = A.attribution_series(v.raw, ["host_name", "owner"], mode, price=0.002)
        return out.withColumns({c: X.round6(F.col(c)) for c in ("share", "cost")})


_NAMES = "count(DISTINCT (exe, metric))"


@query("a16_series_shared", f"SELECT owner, host_name, CAST(GROUPING(owner, host_name) AS BIGINT) AS level, {_NAMES} AS series, count(*) AS points, CAST(sum(value) AS BIGINT) AS value, round({_NAMES} / (SELECT {_NAMES} FROM raw), 6) AS share FROM raw GROUP BY CUBE (owner, host_name)")
def _(v):
    """Series that stand under many hosts, so that subtotals are less than their parts together."""
    out = A.attribution_series(v.raw, ["owner", "host_name"], "cube", series=["exe", "metric"])
    return out.withColumn("share", X.round6(F.col("share")))


# recorded series
def recorded(v, points, rule, columns=None):
    """The rule's rows after three runs: over two earlier states of the table, and over all of it.

    Points that come of windows or of several pipelines are stored first (columns says what of them), since each run reads its points
    twice, for the last time and for the rows, and no filter of times passes through a window.
    """
    path = v.folder("recorded")
    if columns:
        points.select(*columns).write.parquet(f"{path}/points")
        points = v.spark.read.parquet(f"{path}/points")
    for until in ("2024-01-09 05:00:00", "2024-01-20 17:00:00", None):
        R.record(points if until is None else points.where(F.col("ts") < F.lit(until).cast("timestamp")), rule, path, 5 * DAY)
    return R.recorded(v.spark, path, rule)


@query(
    "a2_recorded_reduction",
    f"""SELECT host_name, bucket, b AS baseline, c AS candidate, round((b - c) / b, 6) AS reduction FROM (SELECT host_name, {_DAY} AS bucket, count(DISTINCT CASE WHEN variant = 'baseline' THEN (pid, metric) END) AS b,
    count(DISTINCT CASE WHEN variant = 'candidate' THEN (pid, metric) END) AS c FROM variants GROUP BY 1, 2)""",
)
def _(v):
    return recorded(v, v.variants, R.reduction_rule(DAY), ["host_name", "pid", "metric", "variant", "ts"]).withColumn("reduction", X.round6(F.col("reduction")))


@query("a7_recorded_cost", f"SELECT host_name, variant, {_DAY} AS bucket, round(sum(value)::DOUBLE / {DAY}.0 * 3600 / 1073741824 * 0.25, 6) AS hourly_cost FROM variants WHERE metric = 'process.memory.physical' GROUP BY 1, 2, 3")
def _(v):
    points = v.variants.where(X.eq("metric", "process.memory.physical"))
    return recorded(v, points, R.cost_rule(DAY, "value"), ["host_name", "variant", "ts", "value"]).withColumn("hourly_cost", X.round6(F.col("hourly_cost")))


_COUNTED = ["host_name", "pid", "metric", "ts", "point_id", "value"]
_CPU, _MEMORY = ("CASE WHEN metric = 'process.cpu.time' THEN value END", "CASE WHEN metric = 'process.memory.physical' THEN value END")


@query("a20_recorded_overhead", f"SELECT host_name, {_DAY} AS bucket, round(sum({_CPU})::DOUBLE / {DAY}, 6) AS cpu_rate, round(avg({_MEMORY}), 4) AS memory_mean, coalesce(max({_MEMORY}), -1) AS memory_max, round(max({_MEMORY}) / 2e8, 6) AS memory_ratio FROM base GROUP BY 1, 2")
def _(v):
    out = recorded(v, v.datapoints, R.overhead_rule(DAY, 2e8, STALE), _COUNTED).fillna(-1, ["memory_max"])
    return out.withColumns({"cpu_rate": X.round6(F.col("cpu_rate")), "memory_mean": F.round("memory_mean", 4), "memory_ratio": X.round6(F.col("memory_ratio"))})


_RATES = f"""SELECT *, {_DAY} AS bucket, CAST(sum(value) OVER w AS BIGINT) AS increase FROM base WHERE metric = 'process.cpu.time'
    WINDOW w AS (PARTITION BY host_name, pid ORDER BY epoch_us(ts) RANGE BETWEEN {5 * DAY * 1000000 - 1} PRECEDING AND CURRENT ROW)"""


@query("w2_recorded_rate", f"SELECT host_name, pid, metric, bucket, increase, round(increase::DOUBLE / {5 * DAY}, 6) AS rate FROM (SELECT *, row_number() OVER (PARTITION BY host_name, pid, bucket ORDER BY ts DESC, point_id DESC) AS n FROM ({_RATES})) WHERE n = 1")
def _(v):
    out = recorded(v, v.datapoints, R.rate_rule(DAY, 5 * DAY, STALE, "process.cpu.time"), _COUNTED)
    return out.withColumn("rate", X.round6(F.col("rate")))


# sketches
@query("a1_sketch_rollup", f"SELECT host_name, block, count(*) AS points, {_SERIES} AS exact, true AS within FROM (SELECT *, {_BLOCK} AS block FROM raw) GROUP BY 1, 2")
def _(v):
    """Ten days' series from the sketches of days; within says that the estimate is three standard errors from the exact count at most."""
    days = recorded(v, v.raw, R.cardinality_sketch_rule(DAY, ["host_name"]))
    found = H.roll_up_series(days, ["host_name", F.floor(F.col("bucket") * DAY / BLOCK).alias("block")])
    exact = A.cardinality(v.raw.withColumn("block", bucket("ts", BLOCK)), ["host_name", "block"]).withColumnRenamed("series", "exact")
    within = F.abs(F.col("series") - F.col("exact")) <= F.ceil(F.col("exact") * H.distinct_error())
    return found.join(exact, ["host_name", "block"]).select("host_name", "block", "points", "exact", within.alias("within"))


@query("a13_sketch_rollup", "SELECT endpoint, count(*) AS n, true AS p50_holds, true AS p95_holds, true AS p99_holds FROM request_log GROUP BY 1")
def _(v):
    """Quantiles of all days from the sketches of each, held against the ranks that they have among all values."""
    days = recorded(v, v.request_log, R.quantile_sketch_rule(DAY, ["endpoint"], "latency_ms"))
    found = H.roll_up_quantiles(days, ["endpoint"])
    held = H.quantile_holds(v.request_log, ["endpoint"], "latency_ms", found)
    return held.drop("n").join(found.select("endpoint", "n"), "endpoint")


@query("l4_heavy_labels", "SELECT label, owner, count(*) AS n FROM (SELECT owner, CASE WHEN value % 4 <> 0 THEN exe ELSE exe || '-' || point_id END AS label FROM raw) GROUP BY 1, 2 ORDER BY n DESC, label, owner LIMIT 15")
def _(v):
    """A quarter of the rows has a label of its own, which 256 counters don't hold; the frequent ones are found all the same."""
    label = F.when(F.col("value") % 4 != 0, F.col("exe")).otherwise(F.concat_ws("-", "exe", F.col("point_id").cast("string")))
    return H.heavy_labels(v.raw.select("owner", label.alias("label")), ["label", "owner"], 15, 256)


@query("l4_heavy_labels_rare", "SELECT host_name, pid, k, count(*) AS n FROM raw GROUP BY 1, 2, 3 ORDER BY n DESC, host_name, pid, k LIMIT 20")
def _(v):
    """Label sets that are all about as rare, so that the candidates prove nothing and everything is counted."""
    return H.heavy_labels(v.raw.select("host_name", "pid", X.pick("attrs", "k").alias("k")), ["host_name", "pid", "k"], 20, 64)


# patterns by their beginnings
_PATTERNS = """SELECT '^Customer#' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') || '[0-4]$' AS pattern FROM supplier UNION ALL SELECT '^(Customer#0000' || lpad(CAST(s_suppkey AS VARCHAR), 4, '0') || '|Supplier).*7' FROM supplier
    UNION ALL SELECT '^Customer#00000' || (s_suppkey % 100) || '*9$' FROM supplier UNION ALL SELECT '99$|^none'"""


@query("j8_match_indexed", f"SELECT c_custkey, pattern FROM customer JOIN (SELECT DISTINCT pattern FROM ({_PATTERNS})) ON regexp_matches(c_name, pattern)")
def _(v):
    key = F.col("s_suppkey")
    made = [
        F.concat(F.lit("^Customer#"), F.lpad(key.cast("string"), 8, "0"), F.lit("[0-4]$")), F.concat(F.lit("^(Customer#0000"), F.lpad(key.cast("string"), 4, "0"), F.lit("|Supplier).*7")),
        F.concat(F.lit("^Customer#00000"), (key % 100).cast("string"), F.lit("*9$")), F.lit("99$|^none"),
    ]
    patterns = v.table("supplier").select(F.explode(F.array(*made)).alias("pattern"))
    return J.match_indexed(v.table("customer"), patterns, "c_name").select("c_custkey", "pattern")


# updates in place
@query(
    "j13_merge_updates",
    "SELECT id, coalesce(u.event_type, status) AS status, coalesce(epoch_us(u.at), -1) AS updated_at FROM experiments LEFT JOIN (SELECT experiment_id, arg_max(event_type, (created_at, seq, event_type)) AS event_type, max(created_at) AS at FROM experiment_events GROUP BY 1) u ON id = experiment_id",
)
def _(v):
    """The stored table after earlier updates, then all of them, then all once more."""
    path, none = v.folder("experiments"), {"updated_at": F.lit(None).cast("timestamp"), "seq": F.lit(None).cast("long"), "year": F.year("created_at")}
    v.experiments.withColumns(none).write.partitionBy("year").parquet(path)
    updates = v.experiment_events.select(F.col("experiment_id").alias("id"), F.col("event_type").alias("status"), F.col("created_at").alias("updated_at"), "seq")
    for some in (updates.where(F.col("updated_at") < F.lit("1996-06-01").cast("timestamp")), updates, updates):
        stored.merge_updates(v.spark, path, some, "year")
    return v.spark.read.parquet(path).select("id", "status", F.coalesce(F.unix_micros("updated_at"), F.lit(-1)).alias("updated_at"))


# tables by process
def by_process(v, buckets: int = 8):
    return stored.write_by_process(v.datapoints, f"by_process_{uuid.uuid4().hex[:12]}", v.folder("by-process"), buckets)


@query("w1_by_process", "SELECT point_id, metric, value FROM base")
def _(v):
    return W.cumulative_to_delta(by_process(v), max_staleness=STALE).select("point_id", "metric", "value")


@query("n2_by_process", "SELECT point_id, pid, metric, value, priority FROM prioritised WHERE priority <> 'low'")
def _(v):
    return N.priority_filter_v1(by_process(v), BLOCK, placed=True, max_staleness=STALE).select("point_id", "pid", "metric", "value", "priority")


# metrics told apart by a label
_SPLIT = "CASE WHEN metric = 'process.disk.io' THEN CASE WHEN CAST(k AS BIGINT) % 2 = 0 THEN 'process.disk.io.read' ELSE 'process.disk.io.write' END ELSE metric END"


def _directed(df):
    way = F.when(X.pick("attrs", "k").cast("long") % 2 == 0, "read").otherwise("write")
    return P.split_metric(P.set_map_attrs(df, {"direction": (way, "upsert")}), "process.disk.io", "direction", DISK_IO)


@query("p12_split_io", f"SELECT point_id, {_SPLIT} AS metric FROM raw")
def _(v):
    return _directed(v.raw).select("point_id", "metric")


_DIRECTED = f"""SELECT *, CASE WHEN c THEN value - lag(value) OVER w ELSE value END AS v, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS gap FROM (SELECT * REPLACE ({_SPLIT} AS metric), metric IN ('process.cpu.time', 'process.disk.io') AS c FROM datapoints)
    WINDOW w AS (PARTITION BY host_name, pid, metric ORDER BY ts, point_id)"""


@query(
    "k6_vendor_entities",
    f"""SELECT arg_max(exe, (ts, point_id)) AS "processDisplayName", arg_max(exe || ' --owner=' || owner || ' ' || k, (ts, point_id)) AS "commandLine", host_name AS hostname, pid AS "processId", pid // 2 AS "parentProcessId", {_BLOCK} AS bucket,
    round(avg(CASE WHEN metric = 'process.cpu.utilization' THEN v END), 6) AS "cpuPercent", round(avg(CASE WHEN metric = 'process.memory.physical' THEN v END), 6) AS "memoryResidentSizeBytes",
    round(sum(CASE WHEN metric = 'process.disk.io.read' THEN v END) / {BLOCK}.0, 6) AS "ioReadBytesPerSecond", round(sum(CASE WHEN metric = 'process.disk.io.write' THEN v END) / {BLOCK}.0, 6) AS "ioWriteBytesPerSecond"
    FROM ({_DIRECTED}) WHERE NOT c OR (v >= 0 AND gap <= {STALE}) GROUP BY host_name, pid, bucket""",
)
def _(v):
    tree = {"command_line": F.concat("exe", F.lit(" --owner="), "owner", F.lit(" "), X.pick("attrs", "k")), "parent_pid": F.expr("pid div 2")}
    deltas = W.cumulative_to_delta(_directed(v.datapoints.withColumns(tree)), ALL_COUNTERS, max_staleness=STALE)
    out = S.to_vendor_entities(deltas, BLOCK)
    return out.withColumns({c: X.round6(F.col(c)) for c in (*S.VENDOR_GAUGES.values(), *S.VENDOR_RATES.values())})


# JSON of any shape
def _shapes(v):
    e = v.table("events")
    odd = F.concat(F.lit('{"k": "'), "event_type", F.lit('", "deep": {"n": ['), F.col("user_id").cast("string"), F.lit(", 2.5]}}"))
    shape = F.when(F.col("event_id") % 4 == 0, F.col("props")).when(F.col("event_id") % 4 == 1, odd).when(F.col("event_id") % 4 == 2, F.concat(F.lit("[1, "), F.col("user_id").cast("string"), F.lit("]"))).otherwise(F.expr("left(props, length(props) - 1)"))
    return e.select("event_id", shape.alias("shape"))


@query(
    "s5_variant",
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) ELSE -1 END AS number, CASE event_id % 4 WHEN 0 THEN json_extract_string(props, '$.k') WHEN 1 THEN event_type END AS name,
    CASE WHEN event_id % 4 = 1 THEN user_id ELSE -1 END AS deep, CASE WHEN event_id % 4 = 2 THEN user_id ELSE -1 END AS second FROM events""",
)
def _(v):
    fields = {"number": ("$.k", "bigint"), "name": ("$.k", "string"), "deep": ("$.deep.n[0]", "bigint"), "second": ("$[1]", "bigint")}
    return S.parse_variant(_shapes(v), "shape", fields).fillna(-1, ["number", "deep", "second"]).select("event_id", *fields)


@query("s5_variant_fields", "SELECT 'k' AS key, CASE event_id % 4 WHEN 0 THEN 'BIGINT' ELSE 'STRING' END AS kind, count(*) AS n FROM events WHERE event_id % 4 < 2 GROUP BY 1, 2 UNION ALL SELECT 'deep', 'OBJECT<n: ARRAY<DECIMAL(*,*)>>', count(*) FROM events WHERE event_id % 4 = 1")
def _(v):
    return S.variant_fields(_shapes(v), "shape").withColumn("kind", F.regexp_replace("kind", r"\(\d+,\d+\)", "(*,*)"))
