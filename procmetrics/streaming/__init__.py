"""Structured Streaming counterparts. Times are event times; watermark delays are parameters."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from procmetrics.model import COUNTERS, PROCESS, SERIES
from procmetrics.operators.filters import route
from procmetrics.operators.transforms import detect_resource


def with_lateness(df: DataFrame, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    return df.withWatermark(ts, delay)


def stream_cardinality(df: DataFrame, window: str, by: Sequence[str] = ("variant",), series: Sequence[str] = SERIES, exact: bool = False, approx_error: float = 0.05) -> DataFrame:
    """Series of each window. exact gives the window's distinct (window, by, series) rows, to be counted after the stream, since one query can't do both."""
    at = df.withColumn("window", F.window("ts", window))
    if exact:
        return at.select("window", *by, *series).dropDuplicates(["window", *by, *series])
    return at.groupBy("window", *by).agg(F.approx_count_distinct(F.xxhash64(*series), approx_error).alias("series"))


def stream_cost(df: DataFrame, by: Sequence[str] = ("variant",), size: str = "value", length: str = "5 minutes", slide: str = "30 seconds", seconds: float = 300, price: float = 0.25) -> DataFrame:
    """Hourly cost of the bytes in sliding windows."""
    summed = df.groupBy(F.window("ts", length, slide), *by).agg(F.sum(size).alias("bytes"))
    return summed.withColumn("hourly_cost", F.col("bytes") / seconds * 3600 / 2**30 * price)


def process_sessions(df: DataFrame, gap: str, keys: Sequence[str] = PROCESS) -> DataFrame:
    """Lifetimes: runs of points less than the gap apart. Works on batches too; a stream gives a lifetime once the watermark has passed its end."""
    out = df.groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("points"))
    return out.select(*keys, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "points")


def _sorted(rows: Iterator[pd.DataFrame], *by: str) -> list[np.ndarray]:
    """These columns of a key's rows of one micro-batch, ordered by them. The rows' other columns and the key go with each batch of Arrow, so a row takes some bytes."""
    parts = [[pdf[c].to_numpy("datetime64[us]" if c == "ts" else None) for c in by] for pdf in rows]
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    order = np.lexsort(columns[::-1])
    return [c[order] for c in columns]


def _wake(handle: StatefulProcessorHandle, at: pd.Timestamp | None) -> None:
    """One timer at most for a key, in whole milliseconds not before the time."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    if at is not None:
        handle.registerTimer(-(-at.value // 1_000_000))


#: How a slot's last points are stored.
_POINTS = pa.schema([("host_name", pa.string()), ("pid", pa.string()), ("metric", pa.string()), ("ts", pa.timestamp("us")), ("value", pa.float64()), ("place", pa.int64())])


class _Delta(StatefulProcessor):
    """The last points of a slot's series are the state, as one table. A point goes when the watermark is so far that none can follow it within max_staleness."""

    def __init__(self, max_staleness: float | None):
        self.max_staleness = max_staleness

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "points binary")

    def _keep(self, points: pd.DataFrame, timerValues) -> None:  # noqa: N803
        if self.max_staleness is not None:
            stale = np.timedelta64(round(self.max_staleness * 1e6), "us")
            points = points[points["ts"] + stale >= np.datetime64(timerValues.getCurrentWatermarkInMs(), "ms")]
            _wake(self.handle, pd.Timestamp(points["ts"].max() + stale) if len(points) else None)
        if len(points):
            sink = pa.BufferOutputStream()
            table = pa.Table.from_pandas(points, schema=_POINTS, preserve_index=False)
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            self.last.update((sink.getvalue().to_pybytes(),))
        else:
            self.last.clear()

    def _kept(self) -> pd.DataFrame:
        return (pa.ipc.open_stream(bytes(self.last.get()[0])).read_all() if self.last.exists() else _POINTS.empty_table()).to_pandas()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        old, new = self._kept(), pd.concat([pdf[[*SERIES, "ts", "value", "place"]] for pdf in rows])
        points = pd.concat([old, new], ignore_index=True)
        series = points.groupby(list(SERIES), sort=False, dropna=False).ngroup().to_numpy()
        ts, used = points["ts"].to_numpy("datetime64[us]"), np.full(len(points), np.datetime64(-(2**62), "us"))
        used[series[: len(old)]] = ts[: len(old)]
        fresh = np.flatnonzero(ts >= used[series])  # others are older than what has been used
        value, place = points["value"].to_numpy(float), points["place"].to_numpy()
        order = fresh[np.lexsort([value[fresh], place[fresh], ts[fresh], fresh >= len(old), series[fresh]])]
        points, series, ts = points.iloc[order], series[order], ts[order]
        delta, gap = np.diff(value[order]), np.diff(ts) / np.timedelta64(1, "s")
        good = 1 + np.flatnonzero((np.diff(series) == 0) & (delta >= 0) & (True if self.max_staleness is None else gap <= self.max_staleness))
        self._keep(points[np.append(series[1:] != series[:-1], True)], timerValues)
        yield points.iloc[good][[*SERIES, "ts"]].assign(value=delta[good - 1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self._keep(self._kept(), timerValues)
        return iter([])

    def close(self) -> None:
        pass


def stream_delta(df: DataFrame, max_staleness: float | None = 600, metrics: Sequence[str] = COUNTERS, delay: str = "10 minutes", slots: int = 256) -> DataFrame:
    """(host_name, pid, metric, ts, value): counters to deltas with the last point of each series as state. Needs the RocksDB state store.

    Points later than the delay are dropped. Without max_staleness any later point may still follow, so states stay for ever. Of points of one
    time the smaller point_id comes first, as in batches; without that column they are ordered by value. Points without a time are left out.

    Series are dealt to so many slots by hash, and each slot is one key of the stream: its points of a micro-batch are worked on as
    arrays and its states written as one, since a call of the state store for every series costs far more than its points. A task holds a
    slot's part of a micro-batch; the number of slots stays as it is for the life of a checkpoint.
    """
    place = (F.col("point_id") if "point_id" in df.columns else F.lit(0)).cast("long").alias("place")
    points = df.where(F.col("metric").isin(list(metrics)) & F.col("ts").isNotNull()).select(*SERIES, "ts", place, F.col("value").cast("double").alias("value"))
    # pandas would make floats of numbers among which there is a null
    points = points.withColumns({"slot": F.pmod(F.xxhash64(*SERIES), F.lit(slots)).cast("int"), "pid": F.col("pid").cast("string")})
    out = with_lateness(points, delay).groupBy("slot").transformWithStateInPandas(_Delta(max_staleness), "host_name string, pid string, metric string, ts timestamp, value double", "Append", "EventTime")
    return out.withColumn("pid", F.col("pid").cast("long"))


class _Alert(StatefulProcessor):
    """The open run of active points is the state: its start, its last point and whether it has fired.

    A timer waits for what comes without a further point: the run fires when held long enough, and ends a step after its last point.
    """

    def __init__(self, hold: float, step: float):
        self.hold, self.step = pd.Timedelta(seconds=hold), pd.Timedelta(seconds=step)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "since timestamp, last timestamp, fired boolean")

    def _open(self):
        if not self.run.exists():
            return None
        since, last, fired = self.run.get()
        return pd.Timestamp(since), pd.Timestamp(last), fired

    def _keep(self, run) -> None:
        if run is None:
            self.run.clear()
            _wake(self.handle, None)
            return
        since, last, fired = run
        self.run.update((since.to_pydatetime(), last.to_pydatetime(), fired))
        _wake(self.handle, last + self.step if fired else min(since + self.hold, last + self.step))

    def _fire(self, run, until: pd.Timestamp, out: list) -> tuple:
        since, last, fired = run
        if not fired and since + self.hold <= until:
            out.append((since + self.hold, "firing"))
            fired = True
        return since, last, fired

    def _end(self, run, at: pd.Timestamp, out: list) -> None:
        out.append((at, "resolved" if self._fire(run, at, out)[2] else "inactive"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ts, active = _sorted(rows, "ts", "active")
        run, out = self._open(), []
        # only points where the state can turn are looked at: the first, those after a gap or of another state, and the last
        turn = np.flatnonzero(np.concatenate([[True], (active[1:] != active[:-1]) | (np.diff(ts) > self.step.to_timedelta64())]))
        for first, last in zip(turn, [*(turn[1:] - 1), len(ts) - 1], strict=True):
            begin, end = pd.Timestamp(ts[first]), pd.Timestamp(ts[last])
            if run is not None and begin - run[1] > self.step:
                self._end(run, run[1] + self.step, out)
                run = None
            if active[first]:
                if run is None:
                    out.append((begin, "pending"))
                    run = (begin, begin, False)
                run = self._fire((run[0], end, run[2]), end, out)
            elif run is not None:
                self._end(run, begin, out)
                run = None
        self._keep(run)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        run, out = self._open(), []
        if run is not None:
            passed, end = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms"), run[1] + self.step
            if passed >= end:
                self._end(run, end, out)
                run = None
            else:
                run = self._fire(run, end, out)
            self._keep(run)
        yield self._rows(key, out)

    def _rows(self, key, out: list) -> pd.DataFrame:
        return pd.DataFrame({"series": pd.Series([key[0]] * len(out), dtype=object), "ts": pd.Series([t for t, _ in out], dtype="datetime64[ns]"), "state": pd.Series([s for _, s in out], dtype=object)})

    def close(self) -> None:
        pass


def stream_alerts(df: DataFrame, condition: Column, hold: float, step: float, key: str = "series", delay: str = "10 minutes") -> DataFrame:
    """(series, ts, state) at each change of state: pending, firing once held long enough, then resolved; inactive if it never fired.

    A run ends at a point where the condition is false or absent, or a step after its last point if none follows by then. Times are
    those of the change, not of the next point. Points later than the delay are dropped. Only open runs are state.
    """
    rows = df.select(F.col(key).alias("series"), "ts", F.coalesce(condition, F.lit(False)).alias("active"))
    return with_lateness(rows, delay).groupBy("series").transformWithStateInPandas(_Alert(hold, step), "series string, ts timestamp, state string", "Append", "EventTime")


def stream_dedup(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drops repeated deliveries within the watermark."""
    return df.dropDuplicatesWithinWatermark(list(keys))


def stream_compare(df: DataFrame, window: str, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Sums of both variants in one window: one aggregation and one state, not a join of two streams."""
    side = lambda v: F.sum(F.when(F.col("variant") == v, F.col(value)).otherwise(0))
    out = df.groupBy(F.window("ts", window), *by).agg(side("baseline").alias("baseline"), side("candidate").alias("candidate"))
    return out.withColumn("difference", F.col("candidate") - F.col("baseline"))


def stream_join(baseline: DataFrame, candidate: DataFrame, keys: Sequence[str], within: str, values: Sequence[str] = ("ts", "value")) -> DataFrame:
    """(keys, baseline_ and candidate_ values) of points of two streams that agree on the keys and lie no further apart than the time within (days or less, as 1 HOUR).

    Both streams need a watermark; state goes when no partner can come any more. Keys and slot of time, twice as long as within, are what
    state is looked up by: a candidate stands in its own slot, a baseline point in those that its reach touches, two but for edges. So
    each pair meets once, half of what meets is a result, and the points of one key spread over all partitions.
    """
    slot = lambda at: F.expr(f"unix_micros({at}) div greatest(2 * unix_micros(timestamp_seconds(0) + INTERVAL {within}), 1)")
    side = lambda df, name: df.select(*[F.col(k).alias(f"_{name}_{k}") for k in keys], *[F.col(c).alias(f"{name}_{c}") for c in dict.fromkeys(["ts", *values])])
    left = side(baseline, "baseline").withColumn("_baseline_slot", F.explode(F.sequence(slot(f"baseline_ts - INTERVAL {within}"), slot(f"baseline_ts + INTERVAL {within}"))))
    right = side(candidate, "candidate").withColumn("_candidate_slot", slot("candidate_ts"))
    same = " AND ".join(f"_baseline_{k} = _candidate_{k}" for k in [*keys, "slot"])
    near = f"candidate_ts BETWEEN baseline_ts - INTERVAL {within} AND baseline_ts + INTERVAL {within}"
    out = left.join(right, F.expr(f"{same} AND {near}"))
    return out.select(*[F.col(f"_baseline_{k}").alias(k) for k in keys], *[f"{name}_{c}" for name in ("baseline", "candidate") for c in values])


def stream_join_windows(baseline: DataFrame, candidate: DataFrame, keys: Sequence[str], within: float, values: Sequence[str] = ("ts", "value")) -> DataFrame:
    """(window, keys, baseline, candidate): the points that stream_join would pair, as lists of each side. A batch that reads them makes the pairs by window_pairs.

    State and output grow with the points, where pairs grow with their square. Windows last three times within (seconds) and begin every
    two, so a point is in one or two, and two points that are near enough share just one in whose first two thirds the earlier one lies.
    Both streams need a watermark; a window's state goes when it has passed. The lists of one key and window are one row.
    """
    step = max(round(within * 1e6), 1)
    side = lambda df, name: df.select(*keys, "ts", F.struct(F.unix_micros("ts").alias("_at"), *values).alias(name))
    both = side(baseline, "baseline").unionByName(side(candidate, "candidate"), allowMissingColumns=True).dropna(subset=["ts", *keys])
    lists = [F.collect_list(name).alias(name) for name in ("baseline", "candidate")]
    return both.groupBy(F.window("ts", f"{3 * step} microseconds", f"{2 * step} microseconds"), *keys).agg(*lists)


def window_pairs(windows: DataFrame, keys: Sequence[str], within: float, values: Sequence[str] = ("ts", "value")) -> DataFrame:
    """The rows of stream_join from what stream_join_windows gave, each pair once.

    Pairs are made last, where they are used, so none is shuffled or stored. Baseline points are rows by then, so no task holds a window's
    pairs, and the points of a large window can be dealt to several tasks.
    """
    micros, start = round(within * 1e6), F.unix_micros("window.start")
    points = windows.select(start.alias("_start"), *keys, F.explode("baseline").alias("b"))
    lists = windows.select(start.alias("_of_start"), *[F.col(k).alias(f"_of_{k}") for k in keys], "candidate")
    same = F.expr(" AND ".join(["_start = _of_start", *[f"{k} = _of_{k}" for k in keys]]))
    near = f"abs(b._at - c._at) <= {micros} AND least(b._at, c._at) < _start + {2 * max(micros, 1)}"
    pairs = points.join(lists.hint("merge"), same).select("_start", *keys, "b", F.explode("candidate").alias("c")).where(near)
    return pairs.select(*keys, *[F.col(f"{s}.{c}").alias(f"{name}_{c}") for s, name in (("b", "baseline"), ("c", "candidate")) for c in values])


def stream_enrich(df: DataFrame, hosts: DataFrame, attribute: str, table: Mapping[str, Sequence[str]], default: Sequence[str]) -> DataFrame:
    """Host facts from a static table, then routes."""
    return route(detect_resource(df, hosts), attribute, table, default)


def parquet_sink(path: str, keep: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> Callable[[DataFrame, int], None]:
    """A sink for start_export. Each micro-batch has a folder of its own, so one that is sent again replaces itself."""
    return lambda batch, number: keep(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")


def start_export(df: DataFrame, sinks: Mapping[str, Callable[[DataFrame, int], None]], checkpoint: str, every: str | None = None, mode: str = "append") -> StreamingQuery:
    """Each micro-batch to every sink. Without a period all that is there is processed, then it ends.

    After a failure a micro-batch comes again with the same number, by which a sink must write once (as parquet_sink does).
    """

    def send(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for sink in sinks.values():
                sink(batch, number)
        finally:
            batch.unpersist()

    writer = df.writeStream.outputMode(mode).foreachBatch(send).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def update_feed(df: DataFrame, metrics: Sequence[str] = ()) -> DataFrame:
    """(experiment_id, status, updated_at, metrics map): the newest status and figures of each experiment, for update mode."""
    newest = df.groupBy("experiment_id").agg(F.max(F.struct("ts", "status", *metrics)).alias("r"))
    entries = F.array(*[F.struct(F.lit(m).alias("key"), F.col("r")[m].cast("double").alias("value")) for m in metrics]) if metrics else F.array().cast("array<struct<key:string,value:double>>")
    return newest.select("experiment_id", F.col("r.status").alias("status"), F.col("r.ts").alias("updated_at"), F.map_from_entries(entries).alias("metrics"))


def stream_top_k(df: DataFrame, k: int, window: str, sink: Callable[[DataFrame, int], None], checkpoint: str, by: Sequence[str] = ("host_name",), name: str = "pid") -> StreamingQuery:
    """Totals of each window, ranked in each micro-batch, since streams have no ranking windows.

    Each micro-batch has all windows, open ones too (complete mode), so a window's places of the last one hold.
    """
    from pyspark.sql import Window

    totals = df.groupBy(F.window("ts", window), *by, name).agg(F.sum("value").alias("total"))

    def rank(batch: DataFrame, number: int) -> None:
        place = F.row_number().over(Window.partitionBy("window", *by).orderBy(F.desc("total"), name))
        sink(batch.withColumn("place", place).where(F.col("place") <= k), number)

    return start_export(totals, {"top": rank}, checkpoint, mode="complete")
