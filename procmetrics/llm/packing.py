"""Variable-capacity best-fit packing of token sequences over the histogram of their lengths (operator 9).

How bins are filled depends only on how many pieces of each length there are. The histogram has at most as many rows as the largest
capacity, whatever the number of documents; best-fit runs on it with multiplicities, and Spark then places every piece by its rank
among the pieces of its length, brings the pieces of a bin together and writes the bins: their ids, and where each document lies.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from procmetrics.llm.common import cut, documents, offsets_of, shared_dir, small_batches, text_slices
from procmetrics.llm.hash_store import find_between, load_arrays, save_arrays

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Tokens that opening a bin costs beside its length; so a larger bin costs less a token.
OVERHEAD = 64
#: Bytes of text that a task encodes at once; larger slices take less time, smaller ones less memory.
SLICE = 3 << 20


@dataclass
class Group:
    """count bins of equal contents: their lengths in order, and the room left in a bin of that capacity."""

    lengths: tuple[int, ...]
    room: int
    capacity: int
    count: int


def _opening(length: int, left: dict[int, int], capacities: tuple[int, ...], overhead: int) -> int:
    """The capacity of least cost for each token that the bin can be expected to hold.

    A bin of capacity c opened for this length can hold at most c tokens, and no more than this and all shorter pieces left have.
    """
    supply = sum(n * size for size, n in left.items())
    fitting = [c for c in capacities if c >= length]
    return min(fitting, key=lambda c: ((c + overhead) / max(length, min(c, supply)), c))


def best_fit(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> list[Group]:
    """Bins for a histogram of lengths, all of 1 to the largest capacity: best-fit decreasing, in runs of equal bins.

    Each length in falling order goes to the open bins of least room that fit, as many at once as there are; when none fits, bins of
    the least-cost capacity are opened. At last each bin is downsized to the least capacity that holds its contents.
    """
    capacities = tuple(sorted(capacities))
    by_room: dict[int, list[Group]] = defaultdict(list)
    rooms: list[int] = []
    left = dict(histogram)

    def put(group: Group) -> None:
        if not by_room[group.room]:
            bisect.insort(rooms, group.room)
        by_room[group.room].append(group)

    for length in sorted(histogram, reverse=True):
        n = left.pop(length)
        while n:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                group = by_room[room].pop()
                if not by_room[room]:
                    rooms.pop(at)
                took = min(n, group.count)
                if took < group.count:
                    put(Group(group.lengths, group.room, group.capacity, group.count - took))
            else:
                capacity = _opening(length, {**left, length: n}, capacities, overhead)
                each = capacity // length  # a bin of this length alone, filled at once
                if n >= each:
                    took = n // each
                    put(Group((length,) * each, capacity - each * length, capacity, took))
                    n -= took * each
                    continue
                group, took = Group((), capacity, capacity, 1), 1
            n -= took
            put(Group((*group.lengths, length), group.room - length, group.capacity, took))
    return [Group(g.lengths, c - sum(g.lengths), c, g.count) for room in sorted(by_room) for g in by_room[room] for c in [next(c for c in capacities if c >= sum(g.lengths))]]


def placements(groups: list[Group]) -> dict[str, np.ndarray]:
    """By length (ascending, as runs between starts) and rank: pieces of ranks from the first rank on go to bins from the first bin on, at the offset."""
    out: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    first_bin = 0
    for group in groups:
        offset = 0
        for length in group.lengths:
            out[length].append((used[length], first_bin, offset, group.capacity))
            used[length] += group.count
            offset += length
        first_bin += group.count
    rows = np.array([r for length in sorted(out) for r in out[length]], np.int64).reshape(-1, 4)
    most = max(out, default=0)
    start = offsets_of(np.array([len(out.get(length, ())) for length in range(most + 1)], np.int64))
    return {"start": start, "rank": rows[:, 0].copy(), "bin": rows[:, 1].copy(), "offset": rows[:, 2].copy(), "capacity": rows[:, 3].copy()}


def word_ids(end_id: int | None = 1):
    """Encodes with the 49k word tokenizer; each text, also an empty or null one, ends with end_id."""
    import public_tokenizers

    from procmetrics.llm.token_store import word_encoder

    encoder, tail = word_encoder(public_tokenizers.path("word_bpe_49k.json")), np.array([] if end_id is None else [end_id], np.uint32)
    return lambda texts: [np.concatenate([ids, tail]) for ids in encoder.encode([t or "" for t in texts])]


def pieces(df: DataFrame, tokens, largest: int, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE) -> DataFrame:
    """(id, piece, first, len, part, local, ids): the ids of each text, cut into pieces of at most the largest capacity.

    ids are little-endian, 16 bits each if all of a piece fit, else 32. local numbers the pieces of a length within their task, part. A text
    without ids has one piece of none.
    """

    def run(batches):
        from pyspark import TaskContext

        encode, part, seen = tokens(), TaskContext.get().partitionId(), np.zeros(largest + 1, np.int64)
        for slice_ in text_slices(batches, "text", slice_bytes):
            owner, piece, first, size, local, bodies = [], [], [], [], [], []
            for row, ids in enumerate(encode(slice_.column("text").to_pylist())):
                for k, at in enumerate(range(0, max(len(ids), 1), largest)):
                    some = ids[at : at + largest]
                    owner.append(row)
                    piece.append(k)
                    first.append(at)
                    size.append(len(some))
                    local.append(seen[len(some)])
                    seen[len(some)] += 1
                    bodies.append(some.astype("<u2" if not len(some) or some.max() < 1 << 16 else "<u4").tobytes())
            ints = [pa.array(piece, pa.int32()), pa.array(first, pa.int64()), pa.array(size, pa.int32()), pa.array([part] * len(size), pa.int32()), pa.array(local, pa.int64())]
            yield pa.RecordBatch.from_arrays([slice_.column("id").take(pa.array(owner, pa.int64())), *ints, pa.array(bodies, pa.binary())], names=["id", "piece", "first", "len", "part", "local", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, piece int, first long, len int, part int, local long, ids binary")


def _unpacked(body: bytes, size: int) -> np.ndarray:
    return np.frombuffer(body, "<u2" if len(body) == 2 * size else "<u4").astype(np.int32)


def pack(df: DataFrame, path: str, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, tokens=word_ids, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE) -> None:
    """Writes the bins of df's token sequences below path: (bin_id, bin_size, ids, pieces), and the pieces without ids, which have no bin.
    ids are written as little-endian bytes; read_bins gives them as arrays.

    tokens() gives, in a task, the function from a list of texts to their arrays of ids. pieces of a bin are structs (id, piece, first, offset,
    n_tokens) in the order in which they lie; ids beyond the last are absent, not padded. Null texts count as empty. Repeated ids are
    documents of their own. An empty table gives no bins. Other columns are not read.
    """
    spark, largest = df.sparkSession, max(capacities)
    with small_batches(spark, 2000):
        rows = cut(pieces(df, tokens, largest, id_col, text_col, slice_bytes), f"{path}/pieces")
    counts = cut(rows.where("len > 0").groupBy("len", "part").agg(F.count("*").alias("n")), f"{path}/counts")
    histogram = {r["len"]: r["n"] for r in counts.groupBy("len").agg(F.sum("n").alias("n")).collect()}  # a row for each length at most
    save_arrays(f"{path}/plan", "rules", placements(best_fit(histogram, capacities, overhead)))

    def save(key, table):
        before = np.zeros(largest + 1, np.int64)
        before[table["len"].to_numpy()] = table["before"].to_numpy()
        save_arrays(f"{path}/plan", str(key[0].as_py()), {"before": before})
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32())})

    ranked = counts.select("len", "part", (F.sum("n").over(Window.partitionBy("len").orderBy("part")) - F.col("n")).alias("before"))
    cut(ranked.groupBy("part").applyInArrow(save, "part int"), f"{path}/parts")

    def place(batches):
        rules, before = load_arrays(f"{path}/plan", "rules"), {}
        for batch in batches:
            size, part = batch.column("len").to_numpy(), batch.column("part").to_numpy()
            rank = batch.column("local").to_numpy().copy()
            for p in np.unique(part):
                mine = part == p
                if p not in before:
                    before[p] = load_arrays(f"{path}/plan", str(p))["before"]
                rank[mine] += before[p][size[mine]]
            low, high = rules["start"][size], rules["start"][size + 1]
            at, there = find_between(rules["rank"], low, high, rank)
            at = np.where(there, at, at - 1)  # the run that begins at or before the rank
            columns = [rules["bin"][at] + rank - rules["rank"][at], rules["capacity"][at].astype(np.int32), rules["offset"][at].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "piece", "first", "len", "ids")), *map(pa.array, columns)], names=["id", "piece", "first", "len", "ids", "bin_id", "bin_size", "bin_offset"])

    kind = df.schema[id_col].dataType.simpleString()
    placed = rows.where("len > 0").mapInArrow(place, f"id {kind}, piece int, first long, len int, ids binary, bin_id long, bin_size int, bin_offset int")
    sorted_ = placed.repartition("bin_id").sortWithinPartitions("bin_id", "bin_offset")

    def assemble(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            bins = batch.column("bin_id").to_numpy()
            last = int(np.searchsorted(bins, bins[-1])) if len(bins) else 0
            if last:  # all bins before the last one are whole
                yield _bins([*held, batch.slice(0, last)])
                held = []
            elif held and len(bins) and held[-1].column("bin_id")[-1].as_py() != bins[0]:
                yield _bins(held)
                held = []
            held.append(batch.slice(last))
        if any(b.num_rows for b in held):
            yield _bins(held)

    struct = f"struct<id:{kind},piece:int,first:bigint,offset:int,n_tokens:int>"
    with small_batches(spark):
        sorted_.mapInArrow(assemble, f"bin_id long, bin_size int, ids binary, pieces array<{struct}>").write.option("compression", "zstd").parquet(f"{path}/bins")
    rows.where("len = 0").select("id", "piece", "first").write.parquet(f"{path}/empty")


def _bins(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One row for each bin of sorted pieces. Its ids are bytes as those of pieces: 16 bits each, unless some piece needs 32."""
    table = pa.Table.from_batches(parts).combine_chunks()
    column = lambda name: table[name].combine_chunks() if table[name].num_chunks != 1 else table[name].chunk(0)
    bins, size, bodies = column("bin_id").to_numpy(), column("len").to_numpy(), column("ids").to_pylist()
    first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    edge = np.append(first, len(bins)).astype(np.int32)
    wide = np.fromiter(map(len, bodies), np.int64, len(bodies)) > 2 * size
    for k in np.flatnonzero(np.logical_or.reduceat(wide, first)):  # the narrow pieces of a bin with a wide one
        for at in range(edge[k], edge[k + 1]):
            bodies[at] = _unpacked(bodies[at], size[at]).astype("<u4").tobytes()
    ids = [b"".join(bodies[a:b]) for a, b in zip(edge.tolist(), edge[1:].tolist(), strict=False)]
    structs = pa.StructArray.from_arrays([column("id"), column("piece"), column("first"), column("bin_offset"), column("len")], names=["id", "piece", "first", "offset", "n_tokens"])
    lists = [pa.array(ids, pa.binary()), pa.ListArray.from_arrays(pa.array(edge), structs)]
    return pa.RecordBatch.from_arrays([pa.array(bins[first]), column("bin_size").take(pa.array(first)), *lists], names=["bin_id", "bin_size", "ids", "pieces"])


def _bin(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, pa.StructArray]:
    """The ids and pieces of a bin as written."""
    rows = batch.column("pieces")[row].values
    return _unpacked(batch.column("ids")[row].as_py(), int(rows.field("n_tokens").to_numpy().sum())), rows


def read_bins(spark: SparkSession, path: str) -> DataFrame:
    """(bin_id, bin_size, ids array<int>, pieces) of every bin as written."""

    def run(batches):
        for batch in batches:
            ids = [_bin(batch, r)[0] for r in range(batch.num_rows)]
            lists = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("bin_id"), batch.column("bin_size"), lists, batch.column("pieces")], names=["bin_id", "bin_size", "ids", "pieces"])

    bins = spark.read.parquet(f"{path}/bins")
    return bins.mapInArrow(run, f"bin_id long, bin_size int, ids array<int>, pieces {bins.schema['pieces'].dataType.simpleString()}")


def read_pieces(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, piece, first, n_tokens, bin_id, bin_size, bin_offset, ids_crc32) of every piece, from the bins as written; pieces without ids have no bin."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                ids, rows = _bin(batch, r)
                ids = ids.astype("<u4")
                offset, size = rows.field("offset").to_numpy(), rows.field("n_tokens").to_numpy()
                crc = [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(offset.tolist(), size.tolist(), strict=True)]
                same = [batch.column(c).slice(r, 1).take(pa.array(np.zeros(len(rows), np.int64))) for c in ("bin_id", "bin_size")]
                yield pa.RecordBatch.from_arrays([rows.field("id"), rows.field("piece"), rows.field("first"), rows.field("n_tokens"), *same, rows.field("offset"), pa.array(crc, pa.int64())], names=["id", "piece", "first", "n_tokens", "bin_id", "bin_size", "bin_offset", "ids_crc32"])

    bins, empty = spark.read.parquet(f"{path}/bins"), spark.read.parquet(f"{path}/empty")
    kind = empty.schema["id"].dataType.simpleString()
    full = bins.mapInArrow(run, f"id {kind}, piece int, first long, n_tokens int, bin_id long, bin_size int, bin_offset int, ids_crc32 long")
    none = empty.select("id", "piece", "first", F.lit(0).alias("n_tokens"), *[F.lit(None).cast(t).alias(c) for c, t in (("bin_id", "long"), ("bin_size", "int"), ("bin_offset", "int"))], F.lit(0).cast("long").alias("ids_crc32"))
    return full.unionByName(none).withColumnRenamed("id", id_col)


def packed(docs: DataFrame, slice_bytes: int = SLICE) -> DataFrame:
    """The pieces of docs after packing: the bins are written below the shared folder and read back, some hundred at a time, since a bin is large."""
    spark = docs.sparkSession
    path = shared_dir(spark, "packing")
    pack(docs, path, slice_bytes=slice_bytes)
    with small_batches(spark, 200):
        return cut(read_pieces(spark, path), f"{path}/placed")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, packed, written as bins and read back."""
    return packed(documents(spark, sf_dir))
