"""Exact deduplication by deterministic block naming (operator 5), in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procmetrics.llm.common import LOWER, UPPER, ascii_lower, cut, documents, shared_dir

BLOCK = 4096


def _blocks(text, size: int):
    """The text in pieces of size characters; one empty piece for an empty text. One linear pass, also for very long texts."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(F.length(text) <= size, F.array(text)).otherwise(pieces)


def _named(distinct: DataFrame, by: list[str], path: str, *also) -> DataFrame:
    """An integer name for each distinct row: its place in its sorted partition. Written at once, so that names never change."""
    return cut(distinct.sortWithinPartitions(*by).select(F.monotonically_increasing_id().alias("name"), *also), path)


def identities(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(rid, id_col, text_sha256, level, name): (level, name) is equal for two rows if and only if their texts are equal.

    Level 0: distinct blocks are sorted and numbered. Blocks travel to their numbers by a 64-bit hash; where two different blocks
    share a hash, by the block itself, so no collision can join two texts. Each further level names adjacent pairs of names (the last
    of an odd count with none) and halves the count, until each text has one name. Equal texts have as many blocks and so end
    on the same level. rid numbers the rows, since ids may repeat.
    """
    spark = df.sparkSession
    path = shared_dir(spark, "naming")
    rows = df.select(F.col(id_col), ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("norm"))
    pieces = rows.select(F.explode(_blocks(F.col("norm"), block)).alias("block"))
    names = _named(pieces.groupBy("block").agg(F.count("*").alias("n")), ["block"], f"{path}/names", F.xxhash64("block").alias("h"))
    table = cut(
        rows.select(
            F.monotonically_increasing_id().alias("rid"), id_col, F.sha2(F.col("norm"), 256).alias("text_sha256"), F.transform(_blocks(F.col("norm"), block), lambda b: F.xxhash64(b)).alias("hashes")
        ),
        f"{path}/rows",
    )
    at = table.select("rid", F.size("hashes").alias("n"), F.posexplode("hashes").alias("pos", "h"))
    clashes = names.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h")
    if not clashes.isEmpty():
        return _by_text(rows, id_col, block, path)
    state = cut(at.join(names, "h").select("rid", "n", "pos", "name"), f"{path}/state0")
    return _climb(table.drop("hashes"), state, path)


def _by_text(rows: DataFrame, id_col: str, block: int, path: str) -> DataFrame:
    """Level 0 with blocks joined by their text, for corpora in which two blocks share a hash. Rows are numbered once, in a file."""
    numbered = cut(rows.select(F.monotonically_increasing_id().alias("rid"), id_col, "norm"), f"{path}/numbered")
    at = numbered.select("rid", F.size(_blocks(F.col("norm"), block)).alias("n"), F.posexplode(_blocks(F.col("norm"), block)).alias("pos", "block"))
    names = _named(at.groupBy("block").agg(F.count("*").alias("k")), ["block"], f"{path}/text_names", "block")
    table = numbered.select("rid", id_col, F.sha2("norm", 256).alias("text_sha256"))
    return _climb(table, cut(at.join(names, "block").select("rid", "n", "pos", "name"), f"{path}/text_state0"), path)


def _climb(table: DataFrame, state: DataFrame, path: str) -> DataFrame:
    """Names pairs level by level. The number of levels is the binary logarithm of the longest text's blocks."""
    longest = state.agg(F.max("n")).first()[0] or 1
    done = state.where("n = 1").select("rid", F.lit(0).alias("level"), "name")
    level = 0
    while longest > 1:
        level += 1
        longest = (longest + 1) // 2
        side = lambda k: F.coalesce(F.max(F.when(F.col("pos") % 2 == k, F.col("name"))), F.lit(-1))
        pairs = state.where("n > 1").groupBy("rid", "n", F.floor(F.col("pos") / 2).alias("half")).agg(side(0).alias("a"), side(1).alias("b"))
        pairs = cut(pairs, f"{path}/pairs{level}")
        names = _named(pairs.select("a", "b").distinct(), ["a", "b"], f"{path}/names{level}", "a", "b")
        state = cut(pairs.join(names, ["a", "b"]).select("rid", F.floor((F.col("n") + 1) / 2).cast("int").alias("n"), F.col("half").alias("pos"), "name"), f"{path}/state{level}")
        done = done.unionByName(state.where("n = 1").select("rid", F.lit(level).alias("level"), "name"))
    return table.join(done, "rid")


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id_col, keep_id, group_size, kept, text_sha256) for every row; texts compare after lower-casing A-Z.

    Of equal texts the row of largest id stays; of several rows with that id exactly one stays. Null texts count as empty, null ids
    as smallest. An empty table gives an empty result. Other columns are not read.
    """
    named = identities(df, id_col, text_col, block)
    groups = named.groupBy("level", "name").agg(F.max(id_col).alias("keep_id"), F.max_by("rid", F.struct(id_col, "rid")).alias("keep_rid"), F.count("*").alias("group_size"))
    groups = cut(groups, shared_dir(df.sparkSession, "groups"))  # read from files, so that a hot group's rows may be split in the join
    return named.join(groups, ["level", "name"]).select(id_col, "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate class of every document."""
    return exact_duplicates(documents(spark, sf_dir))


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, that of largest id, with all its columns.

    Null texts count as empty, null ids as smallest; of rows that repeat an id and its text one stays. Rows travel as one struct, so
    other columns may have any names. An empty table gives an empty one.
    """
    keep = exact_duplicates(docs).where("kept").select(F.col("doc_id").alias("keep_id"), F.col("text_sha256").alias("keep_sha"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), F.sha2(ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), 256).alias("own_sha"))
    found = rows.join(keep, F.col("own_id").eqNullSafe(F.col("keep_id")) & (F.col("own_sha") == F.col("keep_sha")), "left_semi")
    return found.dropDuplicates(["own_id", "own_sha"]).select("row.*")


ORACLE = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""
