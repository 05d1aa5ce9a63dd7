"""Near copies: every pair of texts whose sets of shingles have a Jaccard similarity of 0.8 or more (pipeline).

Fingerprints (operator 7) find the closest pairs; others of 0.8 and more differ by up to 17 of 64 bits, so no choice of blocks finds
them all. Prefixes do: if shingles are in one order for all texts, two sets that are so alike share m of the first
n - ceil(0.8 n) + m shingles of each. Every candidate is decided by the sets themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procmetrics.llm.common import clear, cut, offsets_of, shared_dir, small_batches, split_words, text_slices
from procmetrics.llm.components import connected_components
from procmetrics.llm.simhash import _majority, _shingle_hashes, close_pairs
from procmetrics.operators.transforms import small

#: One text of so many tells which shingles are common, and at most so many are remembered. Both bear on the work, never on the result.
SAMPLE, COMMON = 16, 200_000
#: Likewise: how many shingles the longer prefixes must share, and up to how many nodes of a shingle are compared without stars.
SHARED, FEW = 6, 16
#: And how many further nodes of a common shingle those that are still apart meet before all of them meet.
PIVOTS = 4
#: Longs of a set's parities.
LONGS = 8
#: Tables of up to so many bytes as files are broadcast; hash tables of long keys take some seven times as much.
BROADCAST = 8 << 20


def _sets(batches, shingle: int):
    """Of each slice: the rows, the shingle hashes of all texts with how many each has, and the distinct ones of each text, ascending."""
    for part in text_slices(batches, "text", 1 << 20):
        words, counts = split_words(part.column("text"))
        hashes, made = _shingle_hashes(words.cast(pa.binary()).to_pylist(), counts, shingle)
        at = offsets_of(made)
        yield part, hashes, made, [np.unique(hashes[at[k] : at[k + 1]].view(np.int64)) for k in range(len(made))]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = offsets_of(np.fromiter(map(len, arrays), np.int64, len(arrays))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *arrays])))


def _nodes(sets: list[np.ndarray]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s.tobytes()) for s in sets), np.uint64, len(sets)).view(np.int64)


def _parities(sets: list[np.ndarray]) -> pa.ListArray:
    """For each bit, whether it stands for an odd number of the set's shingles. Two sets differ in as many shingles at least as in bits, since those in both change none."""
    bits = 64 * LONGS
    at = np.concatenate([np.empty(0, np.int64), *(k * bits + (s & (bits - 1)) for k, s in enumerate(sets))])
    odd = np.bincount(at, minlength=len(sets) * bits) % 2
    return pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * LONGS), pa.array(np.packbits(odd.astype(bool), bitorder="little").view(np.int64)))


def shingle_sets(texts: DataFrame, shingle: int = 5) -> DataFrame:
    """(node, shingles) of a column of texts: the hash of each text's set of shingles, and the set."""

    def run(batches):
        for _, _, _, sets in _sets(batches, shingle):
            yield pa.RecordBatch.from_arrays([pa.array(_nodes(sets)), _lists(sets)], names=["node", "shingles"])

    return texts.mapInArrow(run, "node long, shingles array<long>")


def common_shingles(texts: DataFrame, shingle: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that three or more sampled texts have, ascending, and in how many they are."""
    sampled = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    counts = shingle_sets(sampled, shingle).select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    rows = counts.where("n > 2").orderBy(F.desc("n"), "s").limit(COMMON).toArrow().sort_by("s")
    return rows["s"].to_numpy(), rows["n"].to_numpy()


def prefixes(keyed: DataFrame, common: tuple[np.ndarray, np.ndarray], shingle: int, hundredths: int) -> DataFrame:
    """(id, h, node, fp, n, parities, prefix) of every row: node, size and parities of its set, the fingerprint, and the set's first shingles, rare ones first.

    Null and empty texts have no shingles; fewer words than a shingle make one shingle. Words are as in fingerprints.
    """
    names, often = common

    def first(found: np.ndarray) -> np.ndarray:
        if len(names):
            at = np.minimum(np.searchsorted(names, found), len(names) - 1)
            found = found[np.argsort(np.where(names[at] == found, often[at], 0), kind="stable")]
        least = -(-len(found) * hundredths // 100)
        return found[: len(found) - least + min(SHARED, least)]

    def run(batches):
        for part, hashes, made, sets in _sets(batches, shingle):
            sizes = np.fromiter(map(len, sets), np.int32, len(sets))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("h"), pa.array(_nodes(sets)), pa.array(_majority(hashes, made)), pa.array(sizes), _parities(sets), _lists([first(s) for s in sets])], names=["id", "h", "node", "fp", "n", "parities", "prefix"])

    kind = keyed.schema["id"].dataType.simpleString()
    return keyed.mapInArrow(run, f"id {kind}, h long, node long, fp long, n int, parities array<long>, prefix array<long>")


def sorted_join(df: DataFrame) -> DataFrame:
    """Marks df to be joined by sorting: a table with a row for each node would pass through the driver as a hash table, and there take many times its bytes."""
    return df.hint("merge")


def _ordered(a: str, b: str):
    return F.least(a, b).alias("u"), F.greatest(a, b).alias("v")


def near_components(keyed: DataFrame, rows: DataFrame, path: str, shingle: int = 5, hundredths: int = 80) -> DataFrame:
    """(node, root) of the nodes with links. keyed has (id, h, text), rows are its prefixes.

    Texts with the same set are one node. Texts whose fingerprints are equal or differ by three bits at most meet by operator 7's blocks;
    and each common prefix shingle links its nodes to one of them, so that a large group of copies becomes one component in a number
    of tests that grows with its size. Then all pairs of different components that share shingles are counted; prefixes are SHARED - 1
    longer than one shared shingle needs, so pairs with fewer than SHARED can't be alike. Nor is a node alike to any if others have fewer
    of its shingles than a pair must share; and a shingle whose nodes are one component takes no further part. So the rows of shared
    shingles grow with what may be alike, not with chance repeats, and are fewer after each step. Of the pairs of a large group that is
    no one component, those whose parities tell them apart don't leave the join.
    """
    whole = 100 + hundredths
    need = lambda n: f"least({SHARED}, ceil({n} * {hundredths} / 100.0))"  # noqa: E731  what two alike texts share at least, the smaller of n
    nodes = rows.where("n > 0").select("node", "fp", "n", "prefix")

    def alike(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (u, v) of nodes whose sets have the similarity. Only their texts are read and cut into shingles again."""
        pairs = cut(pairs.where("u <> v").distinct(), f"{path}/{name}_pairs")
        if pairs.isEmpty():
            return pairs
        wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        one = rows.select("node", "id", "h").join(sorted_join(wanted), "node", "left_semi").groupBy("node").agg(F.min(F.struct("id", "h")).alias("k"))
        one = small(cut(one.select(F.col("k.id").alias("one_id"), F.col("k.h").alias("one_h")), f"{path}/{name}_texts"), BROADCAST)
        texts = keyed.join(one, keyed["id"].eqNullSafe(one["one_id"]) & (keyed["h"] == one["one_h"]), "left_semi").select("text")
        with small_batches(rows.sparkSession):
            sets = cut(shingle_sets(texts, shingle).dropDuplicates(["node"]), f"{path}/{name}_sets")
        a, b = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"of_{x}")) for x in ("u", "v"))
        both, shared = pairs.join(sorted_join(a), "u").join(sorted_join(b), "v"), F.size(F.array_intersect("of_u", "of_v"))
        return cut(both.where(shared * whole >= (F.size("of_u") + F.size("of_v")) * hundredths).select("u", "v"), f"{path}/{name}")

    marks = cut(nodes.groupBy("fp").agg(F.min("node").alias("mark")), f"{path}/marks")
    same = nodes.select("node", "fp").distinct().join(marks, "fp").select(*_ordered("node", "mark"))
    close = close_pairs(marks.select("fp")).join(marks.select(F.col("fp").alias("u"), F.col("mark").alias("a")), "u").join(marks.select(F.col("fp").alias("v"), F.col("mark").alias("b")), "v").select(*_ordered("a", "b"))

    keys = nodes.select("node", "n", F.posexplode("prefix").alias("place", "key"))
    often = cut(keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), f"{path}/often")
    met = cut(keys.join(often, "key"), f"{path}/met/all")
    rich = met.groupBy("node").agg(F.count("*").alias("keys"), F.first("n").alias("n")).where(f"keys >= {need(f'ceil(n * {hundredths} / 100.0)')}")
    met = cut(met.join(sorted_join(rich.select("node")), "node", "left_semi"), f"{path}/met/rich")
    clear(rows.sparkSession, f"{path}/met", ("rich",))
    hot = met.where(f"m > {FEW}")
    pivot = hot.groupBy("key").agg(F.min_by(F.struct("node", "n", "place"), F.xxhash64("node", "key")).alias("p"))
    stars = hot.join(pivot, "key").where(f"least(n - place, p.n - p.place) * {whole} >= (n + p.n) * {hundredths}").select(*_ordered("node", "p.node"))

    first = alike(same.unionByName(close).unionByName(stars), "first")

    def open_rows(met: DataFrame, links: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """The roots so far; and with its node's root each row of met whose shingle has nodes of several roots."""
        roots = cut(connected_components(links), f"{path}/roots_{name}")
        named = met.drop("root").join(sorted_join(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
        several = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
        return roots, cut(named.join(sorted_join(several), "key", "left_semi"), f"{path}/met/{name}")

    roots, met = open_rows(met, first, "first")
    hot = met.where(f"m > {FEW}")
    others = F.array_distinct(F.array(*[F.min_by(F.struct("node", "n", "place", "root"), F.xxhash64("node", "key", F.lit(k))) for k in range(PIVOTS)]))
    pivots = hot.groupBy("key").agg(others.alias("p")).select("key", F.explode("p").alias("p"))
    stars = hot.join(pivots, "key").where(f"root <> p.root AND (least(place, p.place) + least(n - place, p.n - p.place)) * {whole} >= (n + p.n) * {hundredths}")
    links = alike(stars.select(*_ordered("node", "p.node")), "further")
    if not links.isEmpty():
        first = first.unionByName(links)
        roots, met = open_rows(met, first, "further")
    # of two alike texts, the first n - ceil(0.8 n) + 1 shingles share one already; so a common one further on in either text doesn't
    # make a pair meet. What a pair shares among those is bounded by how many late and early common shingles each text has; of those
    # whose nodes are one component a pair of two components shares none.
    late = F.expr(f"place > n - ceil(n * {hundredths} / 100.0)")
    of_common = met.where(f"m > {FEW}").groupBy("node").agg(F.count_distinct(F.when(late, F.col("key"))).alias("late"), F.count_distinct(F.when(~late, F.col("key"))).alias("early"))
    apart = met.where(~(late & F.expr(f"m > {FEW}"))).join(sorted_join(of_common), "node", "left")
    parities = rows.where("n > 0").groupBy("node").agg(F.first("parities").alias("parities"))
    apart = apart.join(sorted_join(parities), "node")
    left = cut(apart.select("parities", "key", "node", "n", "place", "root", F.expr(f"m > {FEW}").alias("common"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("late", "early")]).dropDuplicates(["key", "node"]), f"{path}/open")
    a, b = left.alias("a"), left.alias("b")
    sized = f"least(a.n, b.n) * 100 >= greatest(a.n, b.n) * {hundredths}"
    placed = f"(least(a.place, b.place) + least(a.n - a.place, b.n - b.place)) * {whole} >= (a.n + b.n) * {hundredths}"
    # two alike sets of a and b shingles differ in (a + b) * (1 - s) / (1 + s) at most
    differ = f"({' + '.join(f'bit_count(a.parities[{k}] ^ b.parities[{k}])' for k in range(LONGS))}) * {whole} <= (a.n + b.n) * {100 - hundredths}"
    crossing = a.join(b, F.expr(f"a.key = b.key AND a.root < b.root AND {sized} AND {placed} AND {differ}")).groupBy(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
    of = [F.first(f"{side}.{c}").alias(f"{c}_{side}") for side in "ab" for c in ("n", "late", "early")]
    found = crossing.agg(F.count("*").alias("m"), F.count_if("a.common").alias("c"), F.min("a.place").alias("i"), F.min("b.place").alias("j"), *of)
    unseen = lambda x, y: f"least(late_{x}, late_{y} + early_{y} - c) + least(early_{x} - c, late_{y})"  # noqa: E731  late in x, or late in y alone
    found = found.where(f"m + least({unseen('a', 'b')}, {unseen('b', 'a')}) >= {need('least(n_a, n_b)')} AND least(n_a - i, n_b - j) * {whole} >= (n_a + n_b) * {hundredths}")
    second = alike(found.select(*_ordered("u", "v")), "second")
    return roots if second.isEmpty() else connected_components(first.unionByName(second))


def keep_one(docs: DataFrame, shingle: int = 5, hundredths: int = 80) -> DataFrame:
    """One document of each component of near copies, that of least id (of equal ids, of least text hash), with all its columns.

    A null id comes after all others. Rows that repeat an id and its text stay or go together. Null and empty texts are one node. Other
    columns may have any names. An empty table gives an empty one. What goes is joined away, so texts aren't shuffled while it is small.
    """
    path = shared_dir(docs.sparkSession, "near")
    keyed = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"))
    with small_batches(docs.sparkSession):
        rows = cut(prefixes(keyed, common_shingles(keyed.select("text"), shingle), shingle, hundredths), f"{path}/rows")
    roots = cut(near_components(keyed, rows, path, shingle, hundredths), f"{path}/components")
    named = rows.select("id", "h", "node").join(sorted_join(roots), "node", "left").select(F.struct(F.col("id").isNull().alias("last"), "id", "h").alias("k"), F.coalesce("root", "node").alias("root"))
    kept = cut(named.groupBy("root").agg(F.min("k").alias("kept"), F.count("*").alias("rows")).where("rows > 1"), f"{path}/kept")
    gone = cut(named.join(small(kept, BROADCAST), "root").where("k <> kept").select(F.col("k.id").alias("gone_id"), F.col("k.h").alias("gone_h")).distinct(), f"{path}/gone")
    clear(docs.sparkSession, path, ("gone",))  # the result reads docs and gone alone
    gone = small(gone, BROADCAST)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_h"]), "left_anti")
