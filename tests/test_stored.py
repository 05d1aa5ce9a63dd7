"""Stored tables: recorded series, updates in place, tables by process; sketches against exact results; plans."""

import random
import re
from collections import Counter
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from procmetrics.operators import aggregates as A
from procmetrics.operators import joins as J
from procmetrics.operators import series as W
from procmetrics.operators import sketches as H
from procmetrics.operators import transforms as P
from procmetrics.plans import pipelines as N
from procmetrics.plans import recording as R
from procmetrics.queries.views import BLOCK, STALE, Views
from procmetrics.sources import parse_variant, stored, to_vendor_entities, variant_fields

SF = "/root/testdata/sf0.001"
ORIGIN = datetime(2024, 1, 1, tzinfo=timezone.utc)


def files(path):
    """Names, sizes and times of a table's files, by partition."""
    root = Path(path.removeprefix("file:").replace("//", "/"))
    return {str(p.relative_to(root)): (p.stat().st_size, p.stat().st_mtime_ns) for p in root.rglob("*.parquet")}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition|Exchange RoundRobin", plan_of(df).split("== Initial Plan ==")[0]))


# recorded series
def points(spark, hours, seed=1):
    rng = random.Random(seed)
    rows = [(ORIGIN + timedelta(hours=h, minutes=m), h * 10 + m, f"h{m % 2}", m % 3, "process.cpu.time" if m % 2 else "process.memory.physical", float(h * 5 + m), ("baseline", "candidate")[rng.randrange(2)], "redis" if m % 3 else "vim") for h in range(hours) for m in range(8)]
    return spark.createDataFrame(rows, "ts timestamp, point_id long, host_name string, pid long, metric string, value double, variant string, exe string")


RULES = [
    R.reduction_rule(3600), R.coverage_rule(3600), R.cost_rule(7200, "value"), R.overhead_rule(3600, 100.0, 7200), R.rate_rule(3600, 3 * 3600, 7200, "process.cpu.time"),
]


def test_recording_makes_its_points_once(spark, monkeypatch):
    """Each run reads stored points: no later read goes through the pipelines of both variants."""
    from procmetrics.queries import stored as registered

    seen = []
    record = R.record
    monkeypatch.setattr(registered.R, "record", lambda df, *args: (seen.append(plan_of(df)), record(df, *args)))
    v = Views(spark, SF)
    assert registered.recorded(v, v.variants, R.reduction_rule(86400), ["host_name", "pid", "metric", "variant", "ts"]).count() > 0
    assert len(seen) == 3 and not any("Window" in plan or "Exchange" in plan for plan in seen)


@pytest.mark.parametrize("rule", RULES, ids=lambda r: r.name)
def test_two_runs_give_the_rows_of_one(spark, rule):
    whole, path, once = points(spark, 60), stored.shared_folder(spark, "recorded"), stored.shared_folder(spark, "recorded")
    R.record(whole, rule, once, part=6 * 3600)
    want = Counter(tuple(r) for r in R.recorded(spark, once, rule).select(*sorted(R.recorded(spark, once, rule).columns)).collect())
    for hours in (17, 40, 60):
        before = files(f"{path}/{rule.name}/rows") if hours > 17 else {}
        R.record(whole.where(F.col("ts") < F.lit(ORIGIN + timedelta(hours=hours))), rule, path, part=6 * 3600)
        after = files(f"{path}/{rule.name}/rows")
        first_open = (int(ORIGIN.timestamp()) + ({17: 0, 40: 17, 60: 40}[hours] - 1) * 3600) // (6 * 3600)
        closed = {f: x for f, x in before.items() if int(re.search(r"part=(\d+)", f)[1]) < first_open}
        assert hours == 17 or len(closed) > 1 and all(after.get(f) == x for f, x in closed.items())  # not a file of a closed part has changed
    got = R.recorded(spark, path, rule)
    assert Counter(tuple(r) for r in got.select(*sorted(got.columns)).collect()) == want and sum(want.values()) > 20
    before = files(f"{path}/{rule.name}/rows")
    R.record(whole.limit(0), rule, path, part=6 * 3600)
    assert files(f"{path}/{rule.name}/rows") == before
    some = R.recorded(spark, path, rule, int(ORIGIN.timestamp()) + 50 * 3600)
    assert 0 < some.count() < sum(want.values()) / 2 and "PartitionFilters: [isnotnull(part" in plan_of(some)
    with pytest.raises(ValueError):
        R.record(whole, rule, path, part=12 * 3600)


def test_recording_reads_open_parts_only(spark):
    path = stored.shared_folder(spark, "points")
    points(spark, 60).write.parquet(path)
    seen = []
    rule = R.Rule("seen", lambda df: (seen.append(plan_of(df)), R.reduction_rule(3600).build(df))[1], 3600, 1800)
    out = stored.shared_folder(spark, "recorded")
    table = spark.read.parquet(path)
    R.record(table.where(F.col("ts") < F.lit(ORIGIN + timedelta(hours=30))), rule, out, part=6 * 3600)
    R.record(table, rule, out, part=6 * 3600)
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in seen[1]
    late = points(spark, 2).withColumn("pid", F.lit(99).cast("long"))  # of a closed part
    before = R.recorded(spark, out, rule).count()
    R.record(table.unionByName(late), rule, out, part=6 * 3600)
    assert R.recorded(spark, out, rule).count() == before


def test_a_part_stays_open_for_the_delay(spark):
    rule, path = R.reduction_rule(3600), stored.shared_folder(spark, "recorded")
    R.record(points(spark, 13), rule, path, part=6 * 3600, delay=3 * 3600)
    late = points(spark, 13).unionByName(points(spark, 13).where("hour(ts) = 11").withColumn("pid", F.lit(77).cast("long")))
    R.record(late, rule, path, part=6 * 3600, delay=3 * 3600)
    at = R.recorded(spark, path, rule).where((F.col("bucket") % 24) == 11).agg(F.sum("baseline") + F.sum("candidate")).first()[0]
    plain = R.reduction_rule(3600).build(late).where((F.col("bucket") % 24) == 11).agg(F.sum("baseline") + F.sum("candidate")).first()[0]
    assert at == plain


# updates in place
def test_merge_rewrites_touched_partitions_only(spark):
    path = stored.shared_folder(spark, "table")
    row = lambda k: (f"e{k}", "running", None, None, None if k % 10 == 9 else k % 4, k)
    spark.createDataFrame([row(k) for k in range(40)] + [row(3)], "id string, status string, updated_at timestamp, seq long, month int, other long").repartition(1).write.partitionBy("month").parquet(path)
    t = lambda h: ORIGIN + timedelta(hours=h)
    updates = spark.createDataFrame([("e3", "done", t(2), 1), ("e3", "old", t(1), 9), ("e7", "done", t(2), 1), ("e7", "later", t(2), 2), ("none", "x", t(1), 1), (None, "x", t(1), 1), ("e9", "failed", t(1), 1)], "id string, status string, updated_at timestamp, seq long")
    before = files(path)
    assert set(stored.merge_updates(spark, path, updates, "month")) == {3, None}
    after = files(path)
    kept = {f for f in before if "month=3" not in f and "DEFAULT" not in f}
    assert kept and all(after[f] == before[f] for f in kept) and not any(f in after for f in before if f not in kept)
    read = {(r["id"], r["other"]): (r["status"], r["seq"]) for r in spark.read.parquet(path).collect()}
    assert read["e3", 3] == ("done", 1) and read["e7", 7] == ("later", 2) and read["e9", 9] == ("failed", 1)
    assert spark.read.parquet(path).count() == 41 and sum(s == "running" for s, _ in read.values()) == 37
    assert stored.merge_updates(spark, path, updates, "month") == [] and files(path) == after  # a second run writes nothing
    older = spark.createDataFrame([("e3", "stale", t(2), 0)], updates.schema)
    assert stored.merge_updates(spark, path, older, "month") == [] and stored.merge_updates(spark, path, updates.limit(0), "month") == []
    assert set(stored.merge_updates(spark, path, spark.createDataFrame([("e4", "done", t(0), 0)], updates.schema), "month")) == {0}


# tables by process
def test_merge_of_updates_of_one_time_does_not_depend_on_their_order_or_runs(spark):
    kind = "id string, status string, updated_at timestamp, seq long"
    update = lambda *statuses: spark.createDataFrame([("x", s, ORIGIN, 1) for s in statuses], kind).coalesce(1)
    for runs in ([("a", "c", "b")], [("b", "c", "a")], [("c",), ("a", "b")], [("a",), ("c",), ("b",)]):
        path = stored.shared_folder(spark, "merged")
        spark.createDataFrame([("x", "old", None, None, 1), ("y", "old", None, None, 1)], f"{kind}, part int").write.partitionBy("part").parquet(path)
        for run in runs:
            stored.merge_updates(spark, path, update(*run), "part")
        assert {r["id"]: r["status"] for r in spark.read.parquet(path).collect()} == {"x": "c", "y": "old"}
        assert stored.merge_updates(spark, path, update(*runs[0]), "part") == []
        timeless = spark.createDataFrame([("x", "z", None, None), ("y", "z", None, None)], kind)
        assert stored.merge_updates(spark, path, timeless, "part") == []



def test_pipelines_over_a_table_by_process_need_no_shuffle(spark):
    d = Views(spark, SF).datapoints
    table = stored.write_by_process(d, "points_by_process", stored.shared_folder(spark, "by-process"), 8)
    assert shuffles(W.cumulative_to_delta(table)) == 0
    assert shuffles(N.baseline_v1(table, max_staleness=STALE)) == 0
    assert shuffles(N.priority_filter_v1(table, BLOCK, placed=True)) == 0
    assert shuffles(A.cardinality(table, ["host_name", "pid", "metric"])) == 0
    assert shuffles(N.priority_filter_v1(d.drop("value").withColumn("value", F.lit(1)), BLOCK)) == 1  # and over any other table one
    used = N.utilisation(N.baseline_v1(table, max_staleness=STALE).withColumn("bucket", F.lit(1).cast("long")), 60)
    assert shuffles(used) == 0
    spark.sql("DROP TABLE points_by_process")


# cardinality with subtotals
def test_attribution_reduces_rows_before_it_lays_them_out(spark):
    rows = [("h1", "a", 1, "m", 2)] * 5 + [("h1", "b", 1, "m", 3), ("h2", None, 1, "m", 1), ("h2", None, 2, "m", 1), (None, "a", 1, "m", 4)]
    df = spark.createDataFrame(rows, "host_name string, owner string, pid long, metric string, value long")
    out = A.attribution_series(df, ["host_name", "owner"], "cube", series=["pid", "metric"], price=2.0)
    got = {(r["host_name"], r["owner"], r["level"]): (r["series"], r["points"], r["value"], r["cost"]) for r in out.collect()}
    assert got[None, None, 3] == (2, 9, 19, 4.0) and got["h1", None, 1] == (1, 6, 13, 2.0) and got["h1", "a", 0] == (1, 5, 10, 2.0)
    assert got["h2", None, 0] == got["h2", None, 1] == (2, 2, 2, 4.0) and got[None, None, 1] == (1, 1, 4, 2.0) and got[None, None, 2] == (2, 2, 2, 4.0) and got[None, "a", 2] == (1, 6, 14, 2.0)
    lines = plan_of(A.attribution_series(df, ["host_name", "owner"], "rollup")).split("\n")
    expand = next(k for k, x in enumerate(lines) if "Expand" in x)
    assert any("Exchange hashpartitioning(host_name" in x for x in lines[expand:]) and any("partial_count" in x for x in lines[expand:])
    assert A.attribution_series(df.limit(0), ["host_name"], "cube").count() in (0, 1)
    with pytest.raises(ValueError):
        A.attribution_series(df, ["host_name"], "other")


# sketches
def test_series_sketches_roll_up_within_their_bound(spark):
    df = spark.range(120_000).select((F.col("id") % 3).cast("string").alias("host_name"), (F.col("id") % 40_000).alias("pid"), F.lit("m").alias("metric"), (F.col("id") % 24).alias("hour"))
    stored_ = H.series_sketches(df, ["host_name", "hour"])
    day = {r["host_name"]: r for r in H.roll_up_series(stored_, ["host_name"]).collect()}
    exact = {r["host_name"]: r["series"] for r in A.cardinality(df, ["host_name"]).collect()}
    total = H.roll_up_series(stored_, []).first()
    assert total["points"] == 120_000 and abs(total["series"] - 120_000) < 120_000 * H.distinct_error()
    assert all(abs(day[h]["series"] - n) <= n * H.distinct_error() and day[h]["points"] == 40_000 for h, n in exact.items())
    assert stored_.agg(F.max(F.octet_length("sketch"))).first()[0] < 5000
    assert H.roll_up_series(H.series_sketches(df.limit(0), ["host_name"]), ["host_name"]).count() == 0


def test_quantile_sketches_roll_up_within_their_bound(spark):
    df = spark.range(60_000).select((F.col("id") % 24).alias("hour"), F.when(F.col("id") % 100 == 0, None).otherwise(F.pmod(F.xxhash64("id"), F.lit(1000)) * F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000))).alias("v"))
    found = H.roll_up_quantiles(H.quantile_sketches(df, ["hour"], "v"), [F.lit(1).alias("one")], (0.1, 0.5, 0.99))
    held = H.quantile_holds(df.withColumn("one", F.lit(1)), ["one"], "v", found, (0.1, 0.5, 0.99)).first()
    assert held["n"] == found.first()["n"] == 59_400 and held["p10_holds"] and held["p50_holds"] and held["p99_holds"]
    wrong = found.withColumn("p50", F.col("p50") * 2)
    assert not H.quantile_holds(df.withColumn("one", F.lit(1)), ["one"], "v", wrong, (0.1, 0.5, 0.99)).first()["p50_holds"]


@pytest.mark.parametrize("items", [64, 4096])
def test_heavy_labels_are_those_of_counting_all(spark, items):
    rng = random.Random(4)
    heavy = [(f"label{int(rng.paretovariate(0.7))}" if rng.random() < 0.6 else f"own{k}", rng.choice([None, "a"])) for k in range(20_000)]
    even = [(f"e{k % 3000}", "a") for k in range(9000)]
    for rows in (heavy, even, heavy[:3], []):
        df = spark.createDataFrame(rows, "label string, owner string")
        want = sorted(Counter(rows).items(), key=lambda x: (-x[1], x[0][0], x[0][1] is not None, x[0][1] or ""))[:10]
        assert [((r["label"], r["owner"]), r["n"]) for r in H.heavy_labels(df, ["label", "owner"], 10, items).collect()] == want


# patterns
def test_indexed_patterns_match_as_all_pairs_do(spark):
    patterns = ["^abc[0-9]", "^abc*", "^ab?", "^(abc|de).*", "^(abc|de)*x", "^abc|de", "^a{0}b", "x$", "^(abc|d[e])", "^abcdefghijklmnopqrstuvwxyz", "(?i)^ABC", "^(a|b)|c", "^", "", "^abc", "^a.c", "^\\d", None, "^abc"]
    names = ["abc1", "abc", "ab", "a", "b", "de", "dex", "xde", "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqr", "ABC", "c", "", None, "7up", "abc1", "ac"]
    df = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k long, exe string")
    table = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    got = Counter((r["k"], r["pattern"]) for r in J.match_indexed(df, table).collect())
    want = Counter((r["k"], r["pattern"]) for r in df.join(table.distinct(), F.expr("exe rlike pattern")).collect())
    assert got == want and len(want) > 50
    begins = {(r["pattern"], r["prefix"]) for r in J.pattern_prefixes(table.where("pattern IS NOT NULL")).collect()}
    assert {("^abc*", "ab"), ("^(abc|de).*", "de"), ("^abc|de", None), ("^(abc|de)*x", None), ("x$", None), ("^ab?", "a")} <= begins
    assert "BroadcastNestedLoopJoin" in plan_of(J.match_indexed(df, table)) and J.match_indexed(df.limit(0), table).count() == 0


# metrics told apart by a label, entities, variants
def test_split_metrics_are_counters_of_their_own(spark):
    rows = [(ORIGIN + timedelta(seconds=10 * k), k, "h", 1, "vim", f"vim {k}", 1 + k // 4, "process.disk.io", float(v), {"direction": d} if d else None) for k, (v, d) in enumerate([(100, "read"), (1000, "write"), (160, "read"), (1500, "write"), (7, None), (9, "other")])]
    df = spark.createDataFrame(rows, "ts timestamp, point_id long, host_name string, pid long, exe string, command_line string, parent_pid long, metric string, value double, attrs map<string,string>")
    split = P.split_metric(df, "process.disk.io", "direction", {"read": "process.disk.io.read", "write": "process.disk.io.write"})
    deltas = W.cumulative_to_delta(split, ["process.disk.io", "process.disk.io.read", "process.disk.io.write"])
    assert {(r["metric"], r["value"]) for r in deltas.collect()} == {("process.disk.io.read", 60.0), ("process.disk.io.write", 500.0), ("process.disk.io", 2.0)}
    row = to_vendor_entities(deltas, 60).first()
    assert row.asDict() == {"processDisplayName": "vim", "commandLine": "vim 5", "hostname": "h", "processId": 1, "parentProcessId": 2, "bucket": 28401120, "cpuPercent": None, "memoryResidentSizeBytes": None, "ioReadBytesPerSecond": 1.0, "ioWriteBytesPerSecond": 500 / 60}


def test_variants_of_any_shape(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": {"c": [1, "x"]}}'), (2, "[1]"), (3, "nonsense"), (4, None), (5, '{"a": "text"}'), (6, "7")], "id long, doc string")
    got = {r["id"]: tuple(r)[2:] for r in parse_variant(df, "doc", {"a": ("$.a", "bigint"), "c": ("$.b.c[1]", "string"), "first": ("$[0]", "int")}).collect()}
    assert got == {1: (1, "x", None), 2: (None, None, 1), 3: (None,) * 3, 4: (None,) * 3, 5: (None,) * 3, 6: (None,) * 3}
    assert {(r["key"], r["kind"], r["n"]) for r in variant_fields(df, "doc").collect()} == {("a", "BIGINT", 1), ("a", "STRING", 1), ("b", "OBJECT<c: ARRAY<VARIANT>>", 1)}


# top-k by utilisation
def test_top_k_ranks_by_average_utilisation(spark):
    # process 1 uses 8 s of CPU in 100 s, process 2 6 s in 20 s: more for the time that it ran
    rows = [(0, 1, 0.0), (100, 1, 8.0), (80, 2, 0.0), (100, 2, 6.0), (100, 3, 5.0)]
    df = spark.createDataFrame([(ORIGIN + timedelta(seconds=s), k, "h", p, "x", "process.cpu.time", v) for k, (s, p, v) in enumerate(rows)], "ts timestamp, point_id long, host_name string, pid long, exe string, metric string, value double")
    assert [r["pid"] for r in N.topk_v1(df, 1, 600, 60).collect()] == [2]
    assert sorted(r["pid"] for r in N.topk_v1(df, 5, 600, 60).collect()) == [1, 2]
    assert [r["pid"] for r in N.topk_v1(df, seconds=600, mode="threshold", threshold=0.3).collect()] == [2]
    assert sorted(r["pid"] for r in N.topk_v1(df, seconds=600, mode="threshold", threshold=0.08).collect()) == [1, 2]
    with pytest.raises(ValueError):
        N.topk_v1(df, mode="threshold")
