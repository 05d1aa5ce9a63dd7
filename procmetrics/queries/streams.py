"""Streaming queries over the events table: the stream is run to its end and its output read back."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from procmetrics import sources as S
from procmetrics import streaming as T
from procmetrics.queries import query
from procmetrics.queries.views import DAY, METRIC_OF, NAMES, OWNERS, STALE, Views, _pick

#: The host of a row that only moves the watermark on.
END = "~end"


def _folder(v: Views) -> str:
    return v.folder("stream")


def _datapoints(events: DataFrame) -> DataFrame:
    metric = F.coalesce(*[F.when(F.col("event_type") == t, m) for t, m in METRIC_OF.items()])
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("point_id"), F.concat(F.lit("host-"), F.col("user_id") % 7).alias("host_name"), F.expr("user_id div 7").alias("pid"), _pick(NAMES, F.col("user_id") % 20).alias("exe"),
        _pick(OWNERS, F.col("user_id") % 3).alias("owner"), metric.alias("metric"), F.round(F.col("value") * 100).cast("long").alias("value"), F.when(F.expr("user_id div 7 % 2 = 0"), "baseline").otherwise("candidate").alias("variant"),
    )


def _stream(v: Views) -> DataFrame:
    """The events table as a stream of datapoints. The folder has many tables, so the one is picked by a glob."""
    return _datapoints(v.spark.readStream.schema(v.table("events").schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 100).parquet(f"{v.dir}/event[s].parquet"))


def _finish(v: Views, df: DataFrame, mode: str = "append", path: str | None = None) -> DataFrame:
    """Runs the stream over all there is and reads what it wrote. In update mode rows have the number of their micro-batch, which replaces itself if it comes again."""
    path = path or _folder(v)
    if mode == "append":
        df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return v.spark.read.schema(df.schema).parquet(f"{path}/out")
    T.start_export(df, {"out": T.parquet_sink(f"{path}/out")}, f"{path}/state", mode=mode).awaitTermination()
    return v.spark.read.schema(StructType([*df.schema.fields, StructField("batch", IntegerType())])).parquet(f"{path}/out")


def _windows(v: Views, df: DataFrame, keys: list[str]) -> DataFrame:
    """Every window of an aggregation, also those still open when the stream ends: update mode gives all versions, the last one stays."""
    out = _finish(v, df, "update")
    newest = out.groupBy("window", *keys).agg(F.max_by(F.struct(*df.columns), "batch").alias("r"))
    return newest.select("r.*")


def _in_turns(v: Views, parts: Sequence[DataFrame], build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The stream over what has come so far, after each part, from one checkpoint; then over a row far in the future, so that nothing stays open."""
    path = _folder(v)
    far = v.spark.range(1).select(*[(F.lit("2100-01-01").cast("timestamp") if f.name == "ts" else F.lit(END) if f.name == "host_name" else F.lit(None).cast(f.dataType)).alias(f.name) for f in parts[0].schema.fields])
    for part in [*parts, far]:
        part.write.mode("append").parquet(f"{path}/in")
        out = _finish(v, build(v.spark.readStream.schema(part.schema).parquet(f"{path}/in")), path=path)
    return out


_DAY = f"CAST(floor(epoch(ts) / {DAY}) AS BIGINT) * {DAY}"
_SIDE = "CASE WHEN pid % 2 = 0 THEN 'baseline' ELSE 'candidate' END"


@query("s8_stream_datapoints", "SELECT epoch_us(ts) AS at, host_name, pid, exe, owner, metric, value / 1.0 AS value FROM raw")
def _(v):
    path = _folder(v)
    v.raw.withColumn("value", F.col("value").cast("double")).write.parquet(f"{path}/in")
    return _finish(v, S.stream_datapoints(v.spark, f"{path}/in").select(F.unix_micros("ts").alias("at"), "host_name", "pid", "exe", "owner", "metric", "value"), path=path)


@query(
    "t1_watermark",
    f"""SELECT {_DAY} AS day, host_name, count(*) AS points FROM raw WHERE point_id % 2 = 0 OR {_DAY} + {DAY} > (SELECT max(epoch(ts)) FROM raw WHERE point_id % 2 = 0) - {DAY} GROUP BY 1, 2""",
)
def _(v):
    """Odd points come when the even ones have moved the watermark on: those of closed days are dropped."""
    counts = lambda s: T.with_lateness(s, "1 day").groupBy(F.window("ts", "1 day"), "host_name").agg(F.count("*").alias("points"))
    out = _in_turns(v, [v.raw.where("point_id % 2 = 0"), v.raw.where("point_id % 2 = 1")], counts)
    return out.where(F.col("host_name") != END).select(F.unix_seconds("window.start").alias("day"), "host_name", "points")


@query("t2_stream_cardinality", f"SELECT {_DAY} AS day, {_SIDE} AS variant, count(DISTINCT (host_name, pid, metric)) AS series FROM raw GROUP BY 1, 2")
def _(v):
    rows = _finish(v, T.stream_cardinality(T.with_lateness(_stream(v), "1 day"), "1 day", exact=True))
    return rows.groupBy(F.unix_seconds("window.start").alias("day"), "variant").agg(F.count("*").alias("series"))


@query("t2_stream_cardinality_approx")
def _(v):
    out = _windows(v, T.stream_cardinality(T.with_lateness(_stream(v), "1 day"), "1 day"), ["variant"])
    return out.select(F.unix_seconds("window.start").alias("day"), "variant", "series")


@query("t3_stream_cost", f"SELECT {_DAY} - d * {DAY} AS start, {_SIDE} AS variant, CAST(sum(value) AS BIGINT) AS bytes, round(sum(value)::DOUBLE / {2 * DAY} * 3600 / 1073741824 * 0.25, 9) AS hourly_cost FROM raw, range(0, 2) t(d) GROUP BY 1, 2")
def _(v):
    out = _windows(v, T.stream_cost(T.with_lateness(_stream(v), "1 day"), length="2 days", slide="1 day", seconds=2 * DAY), ["variant"])
    return out.select(F.unix_seconds("window.start").alias("start"), "variant", "bytes", F.round("hourly_cost", 9).alias("hourly_cost"))


@query(
    "t4_sessions",
    f"""SELECT host_name, pid, epoch_us(min(ts)) AS started, epoch_us(max(ts)) + {DAY * 1000000} AS ended, count(*) AS points FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= {DAY * 1000000} THEN 1 ELSE 0 END) OVER (PARTITION BY host_name, pid ORDER BY ts, point_id ROWS UNBOUNDED PRECEDING) AS s
    FROM (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY host_name, pid ORDER BY ts, point_id)) AS gap FROM raw)) GROUP BY host_name, pid, s""",
)
def _(v):
    halves = [v.raw.where("ts < '2024-01-15'"), v.raw.where("ts >= '2024-01-15'")]
    out = _in_turns(v, halves, lambda s: T.process_sessions(T.with_lateness(s, "1 day"), "1 day"))
    return out.where(F.col("host_name") != END).select("host_name", "pid", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "points")


@query("t7_stream_dedup", "SELECT point_id FROM raw")
def _(v):
    """All points come twice at once, and once more in a later micro-batch: the last day's meet what the state remembers, older ones are late."""
    twice = v.raw.drop("attrs").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    dedup = lambda s: T.stream_dedup(T.with_lateness(s, "1 day"), ["point_id"]).select("point_id", "host_name")
    return _in_turns(v, [twice, twice.where("copy = 1")], dedup).where(F.col("host_name") != END).select("point_id")


_SIDES = f"SELECT {_DAY} AS day, metric, CAST(coalesce(sum(value) FILTER (pid % 2 = 0), 0) AS BIGINT) AS baseline, CAST(coalesce(sum(value) FILTER (pid % 2 = 1), 0) AS BIGINT) AS candidate, count(DISTINCT pid % 2) AS sides FROM raw GROUP BY 1, 2"


@query("t8_stream_compare", f"SELECT day, metric, baseline, candidate, candidate - baseline AS difference FROM ({_SIDES})")
def _(v):
    out = _windows(v, T.stream_compare(T.with_lateness(_stream(v), "1 day"), "1 day", ["metric"]), ["metric"])
    return out.select(F.unix_seconds("window.start").alias("day"), "metric", "baseline", "candidate", "difference")


@query("t8_stream_join", "SELECT b.host_name, b.metric, b.point_id AS baseline_point_id, c.point_id AS candidate_point_id FROM raw b JOIN raw c ON b.host_name = c.host_name AND b.metric = c.metric AND b.pid % 2 = 0 AND c.pid % 2 = 1 AND abs(epoch_us(b.ts) - epoch_us(c.ts)) <= 3600000000")
def _(v):
    """The stream keeps the points of each window; pairs, which grow with the square of points a day, are made where they are read."""
    side = lambda name: T.with_lateness(_stream(v).where(F.col("variant") == name), "1 day")
    keys, hour, values = ["host_name", "metric"], 3600, ["point_id"]
    return T.window_pairs(_windows(v, T.stream_join_windows(side("baseline"), side("candidate"), keys, hour, values), keys), keys, hour, values)


@query("t9_stream_enrich", "SELECT point_id, region, unnest(CASE owner WHEN 'root' THEN ['hot', 'audit'] ELSE ['cold'] END) AS route FROM raw JOIN hosts USING (host_name)")
def _(v):
    return _finish(v, T.stream_enrich(_stream(v), v.hosts, "owner", {"root": ["hot", "audit"]}, ["cold"]).select("point_id", "region", "route"))


@query("t10_export", "SELECT 'a' AS sink, point_id FROM raw UNION ALL SELECT 'b', point_id FROM raw WHERE owner = 'root'")
def _(v):
    path = _folder(v)
    sinks = {"a": T.parquet_sink(f"{path}/a", lambda b: b.select("point_id")), "b": T.parquet_sink(f"{path}/b", lambda b: b.where("owner = 'root'").select("point_id"))}
    T.start_export(_stream(v), sinks, f"{path}/state").awaitTermination()
    read = lambda s: v.spark.read.schema("point_id long, batch int").parquet(f"{path}/{s}").select(F.lit(s).alias("sink"), "point_id")
    return read("a").unionByName(read("b"))


@query("t11_update_feed", "SELECT 'exp-' || pid AS experiment_id, arg_max(metric, (ts, metric)) AS status, epoch_us(max(ts)) AS updated_at FROM raw GROUP BY 1")
def _(v):
    rows = _stream(v).select(F.concat(F.lit("exp-"), "pid").alias("experiment_id"), F.col("metric").alias("status"), "ts", "value")
    out = _finish(v, T.update_feed(rows, ["value"]), "update")
    newest = out.groupBy("experiment_id").agg(F.max(F.struct("updated_at", "status")).alias("r"))
    return newest.select("experiment_id", F.col("r.status").alias("status"), F.unix_micros("r.updated_at").alias("updated_at"))


@query(
    "t12_stream_top_k",
    f"""SELECT start, host_name, pid, total, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY start, host_name ORDER BY total DESC, pid) AS INTEGER) AS place FROM
    (SELECT CAST(floor(epoch(ts) / {10 * DAY}) AS BIGINT) * {10 * DAY} AS start, host_name, pid, CAST(sum(value) AS BIGINT) AS total FROM raw GROUP BY 1, 2, 3)) WHERE place <= 2""",
)
def _(v):
    path = _folder(v)
    T.stream_top_k(T.with_lateness(_stream(v), "1 day"), 2, "10 days", T.parquet_sink(f"{path}/top"), f"{path}/state").awaitTermination()
    out = v.spark.read.schema("window struct<start:timestamp,end:timestamp>, host_name string, pid long, total long, place int, batch int").parquet(f"{path}/top")
    last = out.groupBy("window", "host_name", "place").agg(F.max_by(F.struct("pid", "total"), "batch").alias("r")).select("window", "host_name", "r.*", "place")
    return last.select(F.unix_seconds("window.start").alias("start"), "host_name", "pid", "total", "place")


@contextmanager
def _rocksdb(v: Views) -> Iterator[None]:
    """The state store that timers need; what the session had before is put back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = v.spark.conf.get(key, None)
    v.spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        v.spark.conf.unset(key) if before is None else v.spark.conf.set(key, before)


@query(
    "t5_stream_delta",
    f"""SELECT host_name, pid, metric, t AS at, value FROM (SELECT host_name, pid, metric, epoch_us(ts) AS t, (value - lag(value) OVER w) / 1.0 AS value, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap FROM raw
    WHERE metric IN ('process.cpu.time', 'process.disk.io') WINDOW w AS (PARTITION BY host_name, pid, metric ORDER BY ts, point_id)) WHERE value >= 0 AND gap <= {STALE * 1000000}""",
)
def _(v):
    halves = [v.raw.where("ts < '2024-01-15'").drop("attrs"), v.raw.where("ts >= '2024-01-15'").drop("attrs")]
    with _rocksdb(v):
        out = _in_turns(v, halves, lambda s: T.stream_delta(s, STALE, delay="1 day"))
    return out.select("host_name", "pid", "metric", F.unix_micros("ts").alias("at"), "value")


_HOLD, _STEP = 3600, DAY // 8


@query(
    "t6_stream_alerts",
    f"""WITH r AS (SELECT host_name AS series, epoch_us(ts) AS t, value > 3000 AS a FROM raw), n AS (SELECT *, lag(a) OVER w AS pa, lag(t) OVER w AS pt, lead(a) OVER w AS na, lead(t) OVER w AS nt FROM r WINDOW w AS (PARTITION BY series ORDER BY t)),
    g AS (SELECT *, sum(CASE WHEN pa AND t - pt <= {_STEP * 1000000} THEN 0 ELSE 1 END) OVER (PARTITION BY series ORDER BY t) AS run FROM n WHERE a),
    e AS (SELECT series, min(t) AS since, max(t) AS last, arg_max(CASE WHEN NOT na AND nt - t <= {_STEP * 1000000} THEN nt ELSE t + {_STEP * 1000000} END, t) AS stop FROM g GROUP BY series, run)
    SELECT series, since AS at, 'pending' AS state FROM e UNION ALL SELECT series, since + {_HOLD * 1000000}, 'firing' FROM e WHERE since + {_HOLD * 1000000} <= stop
    UNION ALL SELECT series, stop, CASE WHEN since + {_HOLD * 1000000} <= stop THEN 'resolved' ELSE 'inactive' END FROM e""",
)
def _(v):
    """Condition, duration and step are such that runs fire, end by a false point and end by a gap."""
    halves = [v.raw.where("ts < '2024-01-15'").select("host_name", "ts", "value"), v.raw.where("ts >= '2024-01-15'").select("host_name", "ts", "value")]
    with _rocksdb(v):
        out = _in_turns(v, halves, lambda s: T.stream_alerts(s, F.col("value") > 3000, _HOLD, _STEP, "host_name", "1 day"))
    return out.select("series", F.unix_micros("ts").alias("at"), "state")
