"""Shards of near equal size by sampled splitters (operator 11).

Records are ordered by key: id, then text hash. A sample of keys, each drawn in proportion to its bytes, gives the quantiles that part the
order into ranges; ranges that turn out overfull are sampled again and subdivided. Exact bytes of the ranges say in which of them the edges
of the shards lie, and only those are summed record by record. So each shard is a run of the order, and its size is that of the others
but for one record.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from procmetrics.llm.common import cut, documents, shared_dir, sql_crc32
from procmetrics.operators.transforms import small

#: Ranges: one for each so many bytes, between these bounds; so boundaries and what is known of ranges stay small on the driver.
RANGE_BYTES, LEAST_RANGES, MOST_RANGES = 8 << 20, 64, 4096
#: Keys drawn for each range; how often overfull ranges are sampled again; and by how much a range may pass the mean.
DRAWS, ROUNDS, OVERFULL = 32, 3, 2
#: Bytes of text in a file of a shard, about.
FILE_BYTES = 64 << 20
#: A group of copies of over this part of a shard is dealt out by chance in proportion to its place; there are at most HOT x shards such.
HOT = 8


def _tie() -> Column:
    return F.xxhash64("text")


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Adds id, tie and size to a struct of the whole row, so that its columns may have any names."""
    text = F.col(text_col).cast("string")
    rows = df.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), text.alias("text"))
    return rows.select("row", "id", _tie().alias("tie"), (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"))


def _order(key: tuple) -> tuple:
    return (key[0] is not None, key[0] or 0, key[1])


def _fixed(value, kind: str) -> Column:
    """A constant of that type, from JSON; the optimizer folds it into a literal."""
    return F.from_json(F.lit(json.dumps({"v": value})), f"v {kind}")["v"]


def place_of(key: Column, bounds: list[tuple]) -> Column:
    """How many of the ascending bounds (id, tie) are at or below the key. Two short searches instead of one long."""
    width = max(1, int(len(bounds) ** 0.5))
    rows = [[{"id": i, "tie": t} for i, t in bounds[k : k + width]] for k in range(0, len(bounds), width)]
    if not rows:
        return F.lit(0)
    kind = "struct<id:bigint,tie:bigint>"
    upto = lambda these: F.size(F.filter(these, lambda b: b <= key))
    outer = upto(_fixed([r[0] for r in rows], f"array<{kind}>"))
    return F.when(outer == 0, 0).otherwise((outer - 1) * width + upto(F.get(_fixed(rows, f"array<array<{kind}>>"), outer - 1)))


def _key() -> Column:
    return F.struct("id", "tie")


def quantiles(drawn: list[tuple[tuple, int]], parts: int) -> list[tuple]:
    """The keys at which each of so many equal parts of the draws begins, but for the first."""
    drawn = sorted(drawn, key=lambda d: _order(d[0]))
    total, seen, last, out = sum(n for _, n in drawn), 0, 0, []
    for key, n in drawn:
        at, seen = seen * parts // total, seen + n
        if out[-1:] != [key] and (at > last or seen > n and seen * parts // total > at + 1):  # a key of several parts has a range of its own
            out.append(key)
        last = at
    return out


@dataclass
class Range:
    bytes: int = 0
    rows: int = 0
    keys: int = 0
    start: int = 0  # bytes of all ranges before


@dataclass
class Plan:
    """shards, all bytes, ascending bounds of the ranges, what each range holds, splitters (the first key of each shard but the first), and hot groups of copies."""

    shards: int
    bytes: int = 0
    bounds: list[tuple] = field(default_factory=list)
    ranges: list[Range] = field(default_factory=list)
    splitters: list[tuple] = field(default_factory=list)
    hot: list[dict] = field(default_factory=list)


def _drawn(groups: DataFrame, rate: Column, turn: int) -> list[tuple[tuple, int]]:
    """Keys and how often each is drawn: rate draws a byte on average. The chance is a hash of the key, so a job that runs again draws the same."""
    chance = (F.xxhash64("id", "tie", F.lit(turn)).bitwiseAND((1 << 53) - 1)) / float(1 << 53)
    rows = groups.select("id", "tie", F.floor(F.col("bytes") * rate + chance).alias("n")).where("n > 0").collect()  # DRAWS for each range
    return [((r["id"], r["tie"]), r["n"]) for r in rows]


def _count(groups: DataFrame, bounds: list[tuple]) -> list[Range]:
    found = groups.groupBy(place_of(_key(), bounds).alias("range")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.count("*").alias("keys")).collect()  # a row for each range
    out = [Range() for _ in range(len(bounds) + 1)]
    for r in found:
        out[r["range"]] = Range(r["bytes"], r["n"], r["keys"])
    start = 0
    for r in out:
        r.start, start = start, start + r.bytes
    return out


def make_plan(groups: DataFrame, shards: int) -> Plan:
    """The plan for distinct keys (id, tie, n, bytes)."""
    total = groups.agg(F.sum("bytes")).first()[0]
    plan = Plan(shards, total or 0)
    if not total:
        return plan
    wanted = min(MOST_RANGES, max(LEAST_RANGES, total // RANGE_BYTES))
    plan.bounds = quantiles(_drawn(groups, F.lit(wanted * DRAWS / total), 0), wanted)
    plan.ranges = _count(groups, plan.bounds)
    for turn in range(1, ROUNDS + 1):
        over = {k: -(-r.bytes * wanted // total) for k, r in enumerate(plan.ranges) if r.bytes * wanted > OVERFULL * total and r.keys > 1}
        if not over:
            break
        rates = _fixed([over[k] * DRAWS / plan.ranges[k].bytes if k in over else 0.0 for k in range(len(plan.ranges))], "array<double>")
        again = groups.withColumn("range", place_of(_key(), plan.bounds)).where(F.get(rates, F.col("range")) > 0)
        drawn: dict[int, list] = {k: [] for k in over}
        old = [_order(b) for b in plan.bounds]
        for key, n in _drawn(again, F.get(rates, F.col("range")), turn):
            drawn[bisect_right(old, _order(key))].append((key, n))
        more = {b for k, keys in drawn.items() for b in quantiles(keys, over[k])} - set(plan.bounds)
        if not more:
            break
        plan.bounds = sorted({*plan.bounds, *more}, key=_order)
        plan.ranges = _count(groups, plan.bounds)
    _exact(groups, plan)
    return plan


def _shard_at(start: Column, size: Column, plan: Plan) -> Column:
    """The shard in which the middle of a piece lies."""
    return F.least(F.lit(plan.shards - 1), F.call_function("div", (start * 2 + size) * plan.shards, F.lit(2 * plan.bytes))).cast("int")


def _exact(groups: DataFrame, plan: Plan) -> None:
    """Splitters and hot groups, from sums within the ranges in which they lie."""
    edges = [plan.bytes * k // plan.shards for k in range(1, plan.shards)]
    starts = [r.start for r in plan.ranges]
    holding = [bisect_right(starts, e) - 1 for e in edges]
    hot = (F.col("bytes") > plan.bytes // (plan.shards * HOT)) & (F.col("n") > 1)
    order = [_order(b) for b in plan.bounds]
    wide = [bisect_right(order, _order((r["id"], r["tie"]))) for r in groups.where(hot).select("id", "tie").collect()]  # HOT x shards at most
    needed = sorted({*holding, *wide})
    inside = groups.withColumn("range", place_of(_key(), plan.bounds)).where(F.col("range").isin(needed))
    before = F.sum("bytes").over(Window.partitionBy("range").orderBy(F.asc_nulls_first("id"), "tie").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes")
    placed = inside.withColumn("start", F.get(_fixed(starts, "array<bigint>"), F.col("range")) + before).withColumn("shard", _shard_at(F.col("start"), F.col("bytes"), plan))
    found = placed.select(F.when(hot, F.struct("id", "tie", "start", "n", "bytes")).alias("hot"), "shard", "range", _key().alias("key"))
    rows = found.groupBy("shard", "range", "hot").agg(F.min("key").alias("key")).collect()  # a row for each edge, range and hot group
    plan.hot = [r["hot"].asDict() for r in rows if r["hot"]]
    firsts = [(tuple(r["key"]), r["shard"]) for r in rows]
    for k, range_ in enumerate(holding, 1):
        after = [key for key, shard in firsts if shard >= k]
        if range_ < len(plan.bounds):  # if no key of the range lies beyond the edge, the next range begins there
            after.append(plan.bounds[range_])
        plan.splitters += [min(after, key=_order)] if after else []


def shard_of(plan: Plan) -> Column:
    """The shard of a row with id, tie and chance. Copies of a hot group lie at a place by chance, as many places as there are copies."""
    plain = place_of(_key(), plan.splitters)
    if not plan.hot:
        return plain
    found = F.get(F.filter(_fixed(plan.hot, "array<struct<id:bigint,tie:bigint,start:bigint,n:bigint,bytes:bigint>>"), lambda h: h["id"].eqNullSafe(F.col("id")) & (h["tie"] == F.col("tie"))), 0)
    each = F.call_function("div", found["bytes"], found["n"])
    return F.when(found.isNotNull(), _shard_at(found["start"] + F.floor(F.col("chance") * found["n"]) * each, each, plan)).otherwise(plain)


def _files(plan: Plan) -> tuple[list[int], list[int], int]:
    """For each range its first file, and among how many its keys are dealt; and the number of files. Neighbouring ranges share a file until it is full."""
    per = max(1, min(FILE_BYTES, -(-plan.bytes // plan.shards)))
    first, parts, at, held = [], [], 0, 0
    for r in plan.ranges:
        spread = -(-r.bytes // FILE_BYTES) if r.bytes > 2 * FILE_BYTES and r.rows > 1 else 1
        if held and held + r.bytes // 2 > per or spread > 1 and held:
            at, held = at + 1, 0
        first.append(at)
        parts.append(spread)
        if spread > 1:
            at, held = at + spread, 0
        else:
            held += r.bytes
    return first, parts, at + 1


def write_shards(df: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes every row below path/rows/shard=N as (part, place, row), and path/manifest: rows and bytes of each file, and rows before it in its shard.

    Size is the bytes of the text (null: none) plus one. Shards are runs of the order by id (null first), then text hash; sizes differ
    by one record at most, but where copies that repeat an id and its text make up an eighth of a shard or more: those are dealt by chance.
    Ids are integers. Repeated rows stay repeated, columns may have any names, and an empty table gives no shards. Texts are read twice
    and shuffled once, by range.
    """
    spark = df.sparkSession
    rows = _keyed(df, id_col, text_col)
    groups = cut(rows.groupBy("id", "tie").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), f"{path}/keys")
    plan = make_plan(groups, shards)
    first, parts, files = _files(plan)
    of_range = lambda values: F.get(_fixed(values, "array<int>"), F.col("range"))
    dealt = rows.withColumns({"chance": F.rand(11) if plan.hot or max(parts, default=1) > 1 else F.lit(0.0), "range": place_of(_key(), plan.bounds)})
    file = of_range(first) + F.floor(F.col("chance") * of_range(parts)).cast("int")
    dealt = dealt.select("row", "id", "tie", "size", F.coalesce(file, F.lit(0)).alias("file"), shard_of(plan).cast("int").alias("shard"))
    sorted_ = dealt.repartitionById(files, F.col("file")).sortWithinPartitions("shard", F.asc_nulls_first("id"), "tie")
    out = sorted_.select("shard", F.col("file").alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place"), "size", "row")
    out.write.partitionBy("shard").option("compression", "zstd").parquet(f"{path}/rows")
    out.limit(0).write.parquet(f"{path}/schema")
    written = spark.read.schema(out.schema).parquet(f"{path}/rows")
    per = written.groupBy("shard", "part").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), F.min("place").alias("first_place"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per.withColumn("before", before).write.parquet(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(shard, slot, row) of every row as it lies in the shards; slots of a shard count from 0 without gaps."""
    rows = spark.read.schema(spark.read.parquet(f"{path}/schema").schema).parquet(f"{path}/rows")
    files = small(read_manifest(spark, path).select("shard", "part", "first_place", "before"))
    return rows.join(files, ["shard", "part"]).select("shard", (F.col("before") + F.col("place") - F.col("first_place")).alias("slot"), "row")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written into 16 shards and read back."""
    path = shared_dir(spark, "shards")
    write_shards(documents(spark, sf_dir), path)
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return read_shards(spark, path).select(
        F.col("row.doc_id").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


# For ids that differ, as those of the given tables do. The absent shard is a double here, as data frames of pandas make it.
ORACLE = f"""
WITH d AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS size, {sql_crc32("coalesce(text, '')")} AS text_crc32 FROM documents),
s AS (SELECT *, CAST(least(15, (2 * sum(size) OVER (ORDER BY doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size) * 16 // (2 * sum(size) OVER ())) AS INTEGER) AS shard FROM d)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST) - 1 AS slot, CAST(NULL AS DOUBLE) AS grown_shard FROM s
"""
