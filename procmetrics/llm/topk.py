"""Exact top-k inner products by block-at-a-time pruning (operator 4)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from procmetrics.llm.common import cut, shared_dir
from procmetrics.operators.transforms import small

#: Components in a block, blocks in a group, queries in a batch, batches that meet a group at once. They bound what a task holds.
CELLS, GROUP, BATCH, TOGETHER = 65536, 64, 256, 16
#: Groups whose extremes one task holds.
BUNDLE = 4096


def quantised(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, dims, ints): floor(256 * x) of each component. Null vectors and those with null or non-finite components are left out."""
    x = F.col(vec_col).cast("array<double>")
    fine = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return df.where(F.col(id_col).isNotNull() & x.isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), F.size(vec_col).alias("dims"), F.transform(x, lambda v: F.floor(v * 256)).alias("ints"))


def _packed(matrix: np.ndarray) -> bytes:
    """A matrix of integers in the smallest signed type that holds them, after a byte with its width."""
    top = max(int(matrix.max(initial=0)), -1 - int(matrix.min(initial=0)))
    kind = next(k for k in ("<i2", "<i4", "<i8") if top <= np.iinfo(k).max)
    return bytes([int(kind[2])]) + matrix.astype(kind).tobytes()


def _matrix(body: bytes, rows: int, dims: int) -> np.ndarray:
    return np.frombuffer(body, f"<i{body[0]}", offset=1).astype(np.int64).reshape(rows, dims)


def blocks(rows: DataFrame, size: int | None = None) -> DataFrame:
    """(dims, part, block, ids, matrix, high, low): forward indexes of rows of neighbouring ids, up to size of them or CELLS components.

    Rows are sorted by dims and id over ranges; a block never crosses a range, so some are short. ids are little-endian longs, as are high
    and low, the extremes of each component.
    """

    def run(batches):
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        held: list[tuple[int, np.ndarray, np.ndarray]] = []

        def flush(whole: bool):
            """Full blocks of what is held; the rest as well, if whole."""
            nonlocal made, held
            dims, ids, m = held[0][0], np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            n = size or max(1, CELLS // max(1, dims))
            stop = len(ids) if whole else len(ids) // n * n
            for lo in range(0, stop, n):
                some = m[lo : min(lo + n, stop)]
                row = [[dims], [part], [made], [ids[lo : min(lo + n, stop)].tobytes()], [_packed(some)], [some.max(axis=0).tobytes()], [some.min(axis=0).tobytes()]]
                made += 1
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4), strict=True)], names=["dims", "part", "block", "ids", "matrix", "high", "low"])
            held = [(dims, ids[stop:], m[stop:])] if stop < len(ids) else []

        for batch in batches:
            dims = batch.column("dims").to_numpy()
            edge = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
            for a, b in zip(edge, edge[1:], strict=False):
                if a == b:
                    continue
                some = batch.slice(a, b - a)
                if held and held[0][0] != dims[a]:
                    yield from flush(True)
                held.append((int(dims[a]), some.column("id").to_numpy(), some.column("ints").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(b - a, int(dims[a]))))
                yield from flush(False)
        if held:
            yield from flush(True)

    ordered = rows.repartitionByRange("dims", "id").sortWithinPartitions("dims", "id")
    return ordered.mapInArrow(run, "dims int, part int, block long, ids binary, matrix binary, high binary, low binary")


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T: in doubles while no partial sum can pass 2^53, else in 64-bit integers."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The largest score each query could have in each block: the sum over components of the larger of the two extreme products."""
    return _product(np.maximum(queries, 0), high) + _product(np.minimum(queries, 0), low)


LEAST = np.iinfo(np.int64).min + 1  # the least that can be negated


class Leaders:
    """The k best of each query so far: ids and scores by score down, then id up; places not yet filled have the least score."""

    def __init__(self, queries: int, k: int):
        self.ids, self.scores = np.full((queries, k), np.iinfo(np.int64).max), np.full((queries, k), LEAST)

    def take(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        all_ids = np.concatenate([self.ids[rows], np.broadcast_to(ids, scores.shape)], axis=1)
        all_scores = np.concatenate([self.scores[rows], scores], axis=1)
        order = np.lexsort((all_ids, -all_scores), axis=1)[:, : self.ids.shape[1]]
        self.ids[rows], self.scores[rows] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_scores, order, 1)


def search_blocks(q_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[Leaders, np.ndarray]:
    """The k best of some blocks (ids, matrix) for each query, and how many blocks each query scored.

    Each query goes through the blocks from its highest bound down, a block at a time, and stops at the first whose bound lies below its k-th
    score, be it the one so far or floor, a k-th score from elsewhere. A block of equal bound may hold a smaller id and is scored.
    """
    best, scored = Leaders(len(q_ids), k), np.zeros(len(q_ids), np.int64)
    top = bounds(queries, np.stack([m.max(axis=0) for _, m in found]), np.stack([m.min(axis=0) for _, m in found]))
    order = np.argsort(-top, axis=1, kind="stable")
    going = np.arange(len(q_ids))
    for turn in range(len(found)):
        block = order[going, turn]
        need = top[going, block] >= np.maximum(best.scores[going, -1], floor[going])
        going, block = going[need], block[need]
        if not len(going):
            break
        scored[going] += 1
        for b in np.unique(block):
            rows, (ids, matrix) = going[block == b], found[b]
            scores = _product(queries[rows], matrix)
            scores[q_ids[rows][:, None] == ids[None]] = LEAST
            best.take(rows, ids, scores)
    return best, scored


def _stacked(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(len(column), dims)


def extremes(held: DataFrame) -> DataFrame:
    """(dims, part, run, high, low) of each group of blocks."""

    def run(key, table):
        dims = key[0].as_py()
        high, low = _stacked(table["high"], dims).max(axis=0), _stacked(table["low"], dims).min(axis=0)
        return pa.table({c: pa.array([k.as_py()], t) for c, k, t in zip(("dims", "part", "run"), key, (pa.int32(), pa.int32(), pa.int64()), strict=True)} | {"high": [high.tobytes()], "low": [low.tobytes()]})

    return held.select("dims", "part", "run", "high", "low").groupBy("dims", "part", "run").applyInArrow(run, "dims int, part int, run long, high binary, low binary")


def _floors(row: dict, queries: int) -> np.ndarray:
    """The k-th score that each query of a batch has from elsewhere."""
    floor = np.full(queries, LEAST)
    for x in row["floors"] or []:
        floor[x["place"]] = x["score"]
    return floor


def _against_extremes(pairs: DataFrame, asked: DataFrame, ends: DataFrame, run, schema: str) -> DataFrame:
    """run for each lot of queries and bundle of groups: only the groups' extremes travel, not their blocks."""
    keys = ["dims", "q_part", "lot", "bundle"]
    named = lambda columns: pairs.select(*[F.col(c).alias(c) for c in columns])  # noqa: E731  (columns of each side's own)
    left = asked.join(small(named(keys).distinct()), ["dims", "q_part", "lot"]).groupBy(*keys)
    right = named(pairs.columns).join(ends, ["dims", "part", "run"]).select("dims", "part", "run", "q_part", "lot", "bundle", "high", "low").groupBy(*keys)
    return left.cogroup(right).applyInArrow(run, schema)


def most_promising(pairs: DataFrame, asked: DataFrame, ends: DataFrame) -> DataFrame:
    """Of the pairs of a lot of queries and a group (dims, part, run, q_part, lot, bundle), those in which some query has its highest bound."""

    def run(key, left, right):
        dims, out = key[0].as_py(), []
        high, low = _stacked(right["high"], dims), _stacked(right["low"], dims)
        for r in left.to_pylist():
            n = len(r["q_ids"]) // 8
            bound = bounds(_matrix(r["q_matrix"], n, dims), high, low)
            found = right.select(["dims", "part", "run", "q_part", "lot"]).take(pa.array(bound.argmax(axis=1)))
            out.append(found.append_column("batch", pa.array([r["batch"]] * n, pa.int64())).append_column("place", pa.array(np.arange(n, dtype=np.int32))).append_column("bound", pa.array(bound.max(axis=1))))
        return pa.concat_tables(out)

    each = _against_extremes(pairs, asked, ends, run, "dims int, part int, run long, q_part int, lot long, batch long, place int, bound long")
    best = each.groupBy("batch", "place").agg(F.max_by(F.struct("dims", "part", "run", "q_part", "lot"), F.struct("bound", "part", "run")).alias("g"))
    return best.select("g.*").distinct()


def worth_searching(pairs: DataFrame, asked: DataFrame, ends: DataFrame) -> DataFrame:
    """Of the same pairs, those whose bound reaches the floor of some query; the blocks of groups in which no query of a lot can find anything stay where they are."""

    def run(key, left, right):
        dims, kept = key[0].as_py(), np.zeros(right.num_rows, bool)
        high, low = _stacked(right["high"], dims), _stacked(right["low"], dims)
        for r in left.to_pylist():
            n = len(r["q_ids"]) // 8
            kept |= (bounds(_matrix(r["q_matrix"], n, dims), high, low) >= _floors(r, n)[:, None]).any(axis=0)
        return right.filter(pa.array(kept)).select(["dims", "part", "run", "q_part", "lot"])

    return _against_extremes(pairs, asked, ends, run, "dims int, part int, run long, q_part int, lot long")


FOUND = "query_id long, batch long, place int, vec_id long, score long, blocks int, scored int"


def search(df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", block: int | None = None, batch: int = BATCH) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of df of highest integer inner product for each row of queries, itself left out.

    Ties go to the smaller id; with fewer rows all are given. Vectors of another length than the query's take no part, nor do vectors
    that are null or hold null or non-finite components; an empty table gives an empty result. Repeated ids count as rows of
    their own, except that a query never finds its own id. Other columns are not read.
    """
    found = search_work(df, queries, k, id_col, vec_col, block, batch).where(F.col("vec_id").isNotNull())
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("batch", "place").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_work(df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", block: int | None = None, batch: int = BATCH) -> DataFrame:
    """(query_id, batch, place, vec_id, score, blocks, scored): what each group of blocks gave to each query, and of how many blocks it scored how many.

    vec_id is null where a group gave nothing. Blocks of neighbouring ids are dealt in groups. First each lot of queries goes through the
    groups in which one of them has its highest bound, which gives every query a k-th score; with that as its floor it goes through
    those other groups whose extremes let some query find more. A task holds one group and TOGETHER batches; a group is copied for
    each lot that needs it.
    """
    spark = df.sparkSession
    path = shared_dir(spark, "topk")
    run = lambda size: F.floor(F.col("block") / size)
    held = cut(blocks(quantised(df, id_col, vec_col), block).withColumn("run", run(GROUP)), f"{path}/blocks")
    asked = cut(blocks(quantised(queries, id_col, vec_col), batch).select("dims", F.shiftleft(F.col("part").cast("long"), 32).bitwiseOR(F.col("block")).alias("batch"), F.col("part").alias("q_part"), run(TOGETHER).alias("lot"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix")), f"{path}/queries")
    numbered = F.row_number().over(Window.partitionBy("dims").orderBy("part", "run")) - 1
    ends = cut(extremes(held), f"{path}/extremes")
    groups = cut(ends.select("dims", "part", "run").withColumn("g", numbered), f"{path}/groups")  # numbers only
    lots = cut(asked.select("dims", "q_part", "lot").distinct(), f"{path}/lots")
    meets = cut(lots.join(small(groups), "dims").select("dims", "part", "run", "q_part", "lot", F.floor(F.col("g") / BUNDLE).alias("bundle")), f"{path}/meets")
    keys = ["dims", "part", "run", "q_part", "lot"]

    def task(key, left: pa.Table, right: pa.Table):
        dims = key[0].as_py()
        found = [(np.frombuffer(i, "<i8"), _matrix(m, len(i) // 8, dims)) for i, m in zip(right["ids"].to_pylist(), right["matrix"].to_pylist(), strict=True)]
        out = []
        for r in left.to_pylist():
            q_ids = np.frombuffer(r["q_ids"], "<i8")
            best, scored = search_blocks(q_ids, _matrix(r["q_matrix"], len(q_ids), dims), _floors(r, len(q_ids)), found, k)
            rows, place = np.nonzero(best.scores > LEAST)
            rows = np.concatenate([rows, np.flatnonzero((best.scores <= LEAST).all(axis=1))])
            none = np.arange(len(rows)) >= len(place)
            at = np.concatenate([place, np.zeros(len(rows) - len(place), np.int64)])
            columns = [q_ids[rows], np.full(len(rows), r["batch"]), rows.astype(np.int32), pa.array(best.ids[rows, at], mask=none), pa.array(best.scores[rows, at], mask=none), np.full(len(rows), len(found), np.int32), scored[rows].astype(np.int32)]
            out.append(pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["query_id", "batch", "place", "vec_id", "score", "blocks", "scored"]))
        empty = pa.schema([("query_id", pa.int64()), ("batch", pa.int64()), ("place", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64()), ("blocks", pa.int32()), ("scored", pa.int32())])
        return pa.Table.from_batches(out, empty)

    def through(pairs: DataFrame, questions: DataFrame) -> DataFrame:
        own = lambda: small(pairs.select(*[F.col(c).alias(c) for c in keys]))  # noqa: E731  (columns of each side's own)
        left = questions.join(own(), ["dims", "q_part", "lot"]).groupBy(*keys)
        right = held.drop("high", "low").join(own(), ["dims", "part", "run"]).groupBy(*keys)
        return left.cogroup(right).applyInArrow(lambda key, a, b: task(key, a, b), FOUND)

    no_floor = F.lit(None).cast("array<struct<place:int,score:long>>")
    if groups.where("g > 0").isEmpty():  # one group of each length: there is nothing to choose
        return through(meets, asked.withColumn("floors", no_floor))
    leading = cut(most_promising(meets, asked, ends), f"{path}/leading")
    first = cut(through(leading, asked.withColumn("floors", no_floor)), f"{path}/first")
    kth = first.withColumn("n", F.row_number().over(Window.partitionBy("batch", "place").orderBy(F.desc("score"), "vec_id"))).where((F.col("n") == k) & F.col("vec_id").isNotNull())
    floors = kth.groupBy("batch").agg(F.collect_list(F.struct("place", "score")).alias("floors"))  # one for each query of a batch
    asked = asked.join(floors, "batch", "left")
    kept = cut(worth_searching(meets.join(leading, keys, "left_anti").select(*meets.columns), asked, ends), f"{path}/kept")
    return first.unionByName(through(kept, asked))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows for every row whose id is divisible by 50, the stated query set."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(rows, rows.where(F.col("vec_id") % 50 == 0))


ORACLE = """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([p[1] * p[2] for p in list_zip(q.e, c.e)]) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""
