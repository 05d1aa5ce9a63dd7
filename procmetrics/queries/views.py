"""Views derived from the given tables, the same in Spark and in SQL. They stand for telemetry and control-plane tables."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from procmetrics.sources.stored import shared_folder

# Fixed values of the derived views.
NAMES = ["nginx-worker", "postgres", "redis-server", "kafka", "kubelet", "systemd", "sshd", "python-app", "java", "node-service", "chrome-tab", "firefox", "code", "slack", "datadog-agent", "grep", "cron-job", "envoy", "mysqld", "vim"]
OWNERS = ["root", "app", "svc"]
METRIC_OF = {"error": "process.cpu.time", "click": "process.cpu.utilization", "view": "process.memory.physical", "signup": "process.disk.io", "purchase": "process.threads"}
PHASE_OF = ["pending", "generating", "deploying", "running", "analyzing", "completed", "failed"]
ACTION_OF = ["update", "delete", "promote", "view"]
DAY = 86400
BLOCK = 10 * DAY
#: Points of a series are a day or so apart, so counters may be older here than in the pipelines' default.
STALE = 5 * DAY


def _pick(names: list[str], index) -> F.Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), index.cast("int") + 1)


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        # the given tables have times without zone
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def folder(self, name: str) -> str:
        return shared_folder(self.spark, name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def datapoints(self) -> DataFrame:
        e = self.table("events")
        metric = F.coalesce(*[F.when(F.col("event_type") == t, m) for t, m in METRIC_OF.items()])
        d = e.select(
            F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("point_id"), F.concat(F.lit("host-"), F.col("user_id") % 7).alias("host_name"), F.expr("user_id div 7").alias("pid"),
            _pick(NAMES, F.col("user_id") % 20).alias("exe"), _pick(OWNERS, F.col("user_id") % 3).alias("owner"), metric.alias("metric"), F.round(F.col("value") * 100).cast("long").alias("c"),
            F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("attrs"),
        )
        w = Window.partitionBy("host_name", "pid", "metric", F.floor(F.unix_seconds("ts") / BLOCK)).orderBy("ts", "point_id").rowsBetween(Window.unboundedPreceding, 0)
        counter = F.col("metric").isin("process.cpu.time", "process.disk.io")
        value = F.when(counter, F.sum("c").over(w)).when(F.col("metric") == "process.memory.physical", F.col("c") * 10000).otherwise(F.col("c"))
        return d.withColumn("value", value).drop("c")

    @cached_property
    def raw(self) -> DataFrame:
        """Datapoints without running counters: no window, so filters reach the scan."""
        e = self.table("events")
        metric = F.coalesce(*[F.when(F.col("event_type") == t, m) for t, m in METRIC_OF.items()])
        return e.select(
            F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("point_id"), F.concat(F.lit("host-"), F.col("user_id") % 7).alias("host_name"), F.expr("user_id div 7").alias("pid"), _pick(NAMES, F.col("user_id") % 20).alias("exe"),
            _pick(OWNERS, F.col("user_id") % 3).alias("owner"), metric.alias("metric"), F.round(F.col("value") * 100).cast("long").alias("value"), F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("attrs"),
        )

    @cached_property
    def hosts(self) -> DataFrame:
        s = self.table("supplier").join(F.broadcast(self.table("nation")), F.col("s_nationkey") == F.col("n_nationkey")).withColumn("host_name", F.concat(F.lit("host-"), F.col("s_suppkey") % 7))
        first = s.groupBy("host_name").agg(F.min_by(F.struct("n_name", "n_regionkey"), "s_suppkey").alias("f"))
        return first.select("host_name", F.when(F.col("f.n_regionkey") % 2 == 0, "linux").otherwise("windows").alias("os_type"), F.col("f.n_name").alias("region"), F.when(F.col("f.n_regionkey") < 2, "prod").otherwise("dev").alias("environment"))

    @cached_property
    def experiments(self) -> DataFrame:
        o = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "completed").otherwise("failed")
        created = F.col("o_orderdate").cast("timestamp")
        done = F.when(F.col("o_orderstatus") != "O", created + F.make_dt_interval(F.lit(2) + F.col("o_orderkey") % 5))
        return o.select(
            F.concat(F.lit("exp-"), F.col("o_orderkey")).alias("id"), F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("name"), F.col("c_name").alias("owner"), status.alias("status"), created.alias("created_at"),
            (created + F.make_dt_interval(F.lit(1))).alias("started_at"), done.alias("completed_at"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
        )

    @cached_property
    def experiment_events(self) -> DataFrame:
        n = F.col("l_linenumber") + F.col("l_quantity").cast("long")
        return self.table("lineitem").select(
            F.concat(F.lit("exp-"), F.col("l_orderkey")).alias("experiment_id"), F.col("l_shipdate").cast("timestamp").alias("created_at"), F.concat("l_linestatus", "l_returnflag").alias("event_type"), (F.col("l_linenumber") * 100 + F.col("l_quantity").cast("long")).alias("seq"),
            _pick(PHASE_OF, n % 7).alias("phase"), _pick(ACTION_OF, n % 4).alias("action"),
        )

    @cached_property
    def request_log(self) -> DataFrame:
        return self.table("events").select("user_id", F.col("event_type").alias("endpoint"), F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100).cast("long").alias("latency_ms"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"))

    @cached_property
    def bench_datapoints(self) -> DataFrame:
        metric = _pick(["process.cpu.time", "process.cpu.utilization", "process.memory.physical", "process.memory.virtual", "process.disk.io", "process.threads", "process.open_file_descriptors"], F.col("l_linenumber") % 7)
        return self.table("lineitem").select(
            F.col("l_shipdate").cast("timestamp").alias("ts"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point_id"), F.concat(F.lit("host-"), F.col("l_suppkey")).alias("host_name"), F.col("l_partkey").alias("pid"),
            _pick(NAMES, F.col("l_partkey") % 20).alias("exe"), _pick(OWNERS, F.col("l_partkey") % 3).alias("owner"), metric.alias("metric"), F.col("l_quantity").cast("long").alias("value"), F.create_map(F.lit("k"), F.col("l_returnflag")).alias("attrs"),
        )

    @cached_property
    def base(self) -> DataFrame:
        """Datapoints through the baseline pipeline."""
        from procmetrics.plans.pipelines import baseline_v1

        return baseline_v1(self.datapoints, max_staleness=STALE)

    @cached_property
    def prioritised(self) -> DataFrame:
        from procmetrics.plans.pipelines import with_priority

        return with_priority(self.base, BLOCK)

    @cached_property
    def categorised(self) -> DataFrame:
        from procmetrics.operators.transforms import classify_category

        return classify_category(self.prioritised)

    @cached_property
    def variants(self) -> DataFrame:
        """Datapoints through the baseline and the priority filter."""
        from functools import partial

        from procmetrics.operators.ranking import run_variants
        from procmetrics.plans.pipelines import baseline_v1, priority_filter_v1

        return run_variants(self.datapoints, {"baseline": partial(baseline_v1, max_staleness=STALE), "candidate": partial(priority_filter_v1, seconds=BLOCK, max_staleness=STALE)})


def _list(names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


_METRIC = "CASE event_type " + " ".join(f"WHEN '{t}' THEN '{m}'" for t, m in METRIC_OF.items()) + " END"
_BASE = f"ts, event_id AS point_id, 'host-' || (user_id % 7) AS host_name, user_id // 7 AS pid, {_list(NAMES)}[user_id % 20 + 1] AS exe, {_list(OWNERS)}[user_id % 3 + 1] AS owner, {_METRIC} AS metric"

#: Each view and the views that it reads.
SQL_VIEWS = {
    "raw": f"SELECT {_BASE}, CAST(round(value * 100) AS BIGINT) AS value, json_extract_string(props, '$.k') AS k FROM events",
    "datapoints": f"""SELECT ts, point_id, host_name, pid, exe, owner, metric, k, CASE WHEN metric IN ('process.cpu.time', 'process.disk.io')
        THEN CAST(sum(value) OVER (PARTITION BY host_name, pid, metric, CAST(floor(epoch(ts) / {BLOCK}) AS BIGINT) ORDER BY ts, point_id ROWS UNBOUNDED PRECEDING) AS BIGINT)
        WHEN metric = 'process.memory.physical' THEN value * 10000 ELSE value END AS value FROM raw""",
    "hosts": """SELECT host_name, CASE WHEN r % 2 = 0 THEN 'linux' ELSE 'windows' END AS os_type, n AS region, CASE WHEN r < 2 THEN 'prod' ELSE 'dev' END AS environment
        FROM (SELECT 'host-' || (s_suppkey % 7) AS host_name, arg_min(n_name, s_suppkey) AS n, arg_min(n_regionkey, s_suppkey) AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)""",
    "experiments": """SELECT 'exp-' || o_orderkey AS id, o_orderkey AS key, o_orderpriority AS name, c_name AS owner, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'completed' ELSE 'failed' END AS status,
        o_orderdate AS created_at, o_orderdate + INTERVAL 1 DAY AS started_at, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + to_days(CAST(2 + o_orderkey % 5 AS INTEGER)) END AS completed_at,
        CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders JOIN customer ON o_custkey = c_custkey""",
    "experiment_events": f"""SELECT 'exp-' || l_orderkey AS experiment_id, l_shipdate AS created_at, l_linestatus || l_returnflag AS event_type, CAST(l_linenumber * 100 + CAST(trunc(l_quantity) AS BIGINT) AS BIGINT) AS seq,
        {_list(PHASE_OF)}[(l_linenumber + CAST(trunc(l_quantity) AS BIGINT)) % 7 + 1] AS phase, {_list(ACTION_OF)}[(l_linenumber + CAST(trunc(l_quantity) AS BIGINT)) % 4 + 1] AS action FROM lineitem""",
    "request_log": "SELECT user_id, event_type AS endpoint, ts, CAST(round(value * 100) AS BIGINT) AS latency_ms, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status FROM events",
}

_PRIORITY = "CASE WHEN regexp_matches(exe, '^(systemd|init|kernel)') OR regexp_matches(exe, '^(sshd|chronyd|networkd)') THEN 'high' WHEN regexp_matches(exe, '^(nginx|apache|haproxy|envoy|postgres|mysql|mongodb|redis|elasticsearch|kafka|rabbitmq|nats|kubelet|dockerd|containerd)') THEN 'critical'"
SQL_VIEWS |= {
    "base": f"""SELECT ts, point_id, host_name, pid, exe, owner, metric, k, v AS value, gap FROM (SELECT *, CASE WHEN metric IN ('process.cpu.time', 'process.disk.io') THEN value - lag(value) OVER w ELSE value END AS v,
        CASE WHEN metric IN ('process.cpu.time', 'process.disk.io') THEN (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 END AS gap FROM datapoints WINDOW w AS (PARTITION BY host_name, pid, metric ORDER BY ts, point_id))
        WHERE metric NOT IN ('process.cpu.time', 'process.disk.io') OR (v >= 0 AND gap <= {STALE})""",
    "prioritised": f"""SELECT *, {_PRIORITY} WHEN regexp_matches(exe, '^(python|java|node|ruby|go)') AND coalesce(memory_value > 100000000, false) THEN 'medium' ELSE 'low' END AS priority
        FROM (SELECT *, max(CASE WHEN metric = 'process.memory.physical' THEN value END) OVER (PARTITION BY host_name, pid, CAST(floor(epoch(ts) / {BLOCK}) AS BIGINT)) AS memory_value FROM base)""",
    "categorised": """SELECT *, CASE WHEN priority = 'low' THEN 'true' END AS aggregate, CASE WHEN regexp_matches(exe, '^(grep|sed|awk|find|ls|ps)') THEN 'utilities' WHEN regexp_matches(exe, '^(datadog|newrelic|prometheus)') THEN 'monitoring'
        WHEN regexp_matches(exe, '^(slack|teams|zoom|discord)') THEN 'communication' WHEN regexp_matches(exe, '^(code|idea|eclipse|vim|emacs)') THEN 'dev_tools' WHEN regexp_matches(exe, '^(chrome|firefox|safari|edge)') THEN 'browsers'
        WHEN priority = 'low' THEN 'other' END AS category FROM prioritised""",
    "variants": """SELECT point_id, ts, host_name, pid, exe, owner, metric, value, 'baseline' AS variant FROM base UNION ALL
        SELECT point_id, ts, host_name, pid, exe, owner, metric, value, 'candidate' AS variant FROM prioritised WHERE priority <> 'low'""",
}


def with_views(sql: str) -> str:
    """The query with the views that it reads, in order, as common table expressions."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name, body in SQL_VIEWS.items():
            if re.search(rf"\b(FROM|JOIN)\s+{name}\b", text) and name not in needed:
                need(body)
                if name not in needed:
                    needed.append(name)

    need(sql)
    ctes = ", ".join(f"{n} AS ({SQL_VIEWS[n]})" for n in needed)
    own = sql.strip()
    if not ctes:
        return own
    for start in ("WITH RECURSIVE ", "WITH "):
        if own.upper().startswith(start):
            return f"{start}{ctes}, {own[len(start):]}"
    return f"WITH {ctes} {own}"
