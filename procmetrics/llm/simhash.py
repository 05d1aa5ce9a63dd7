"""SimHash near-duplicates by pigeonhole blocks (operator 7)."""

from __future__ import annotations

from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procmetrics.llm.common import cut, documents, offsets_of, shared_dir, split_words, text_slices
from procmetrics.llm.components import connected_components

BITS, SEED = 64, 42


def _shingle_hashes(words: list[bytes], counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each text's shingles, text by text, and how many each text has."""
    starts = offsets_of(counts)
    digest = xxhash.xxh64_intdigest
    runs = zip(*(islice(words, k, None) for k in range(size)), strict=False)
    hashes = np.fromiter((digest(b" ".join(run), SEED) for run in runs), np.uint64)
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out, at = np.empty(int(made.sum()), np.uint64), offsets_of(made)
    for k in range(len(counts)):
        if counts[k] >= size:
            out[at[k] : at[k + 1]] = hashes[starts[k] : starts[k] + made[k]]
        elif counts[k]:
            out[at[k]] = digest(b" ".join(words[starts[k] : starts[k + 1]]), SEED)
    return out, made


def _majority(hashes: np.ndarray, made: np.ndarray) -> np.ndarray:
    """The 64-bit fingerprint of each text as a signed long: a bit is 1 if set in over half the text's hashes."""
    fingerprints = np.zeros(len(made), np.uint64)
    full = np.flatnonzero(made)
    if len(full):
        begin, bits = offsets_of(made)[full], np.zeros((len(full), BITS), np.int64)
        for lo in range(0, BITS, 8):  # byte by byte, for less memory
            byte = ((hashes >> np.uint64(lo)) & np.uint64(255)).astype(np.uint8)
            bits[:, lo : lo + 8] = np.add.reduceat(np.unpackbits(byte[:, None], axis=1, bitorder="little").astype(np.int32), begin, axis=0)
        over = 2 * bits > made[full][:, None]
        fingerprints[full] = (over.astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return fingerprints.view(np.int64)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id_col, fp long) for every row. Null and empty texts have fingerprint 0; fewer words than a shingle make one shingle."""

    def run(batches):
        for part in text_slices(batches, "text", 2 << 20):
            words, counts = split_words(part.column("text"))
            fp = _majority(*_shingle_hashes(words.cast(pa.binary()).to_pylist(), counts, shingle))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fp)], names=["id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, fp long").withColumnRenamed("id", id_col)


def block_masks(max_distance: int, blocks: int) -> list[int]:
    """Masks of every choice of blocks - max_distance blocks: fingerprints within the distance agree under one mask at least."""
    edge = [BITS * k // blocks for k in range(blocks + 1)]
    part = [((1 << (edge[k + 1] - edge[k])) - 1) << edge[k] for k in range(blocks)]
    masks = [sum(part[k] for k in chosen) for chosen in combinations(range(blocks), blocks - max_distance)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def close_pairs(distinct: DataFrame, max_distance: int = 3, blocks: int = 6) -> DataFrame:
    """(u, v) for the distinct fingerprints fp at max_distance or fewer differing bits; a pair can come once for each mask.

    The Hamming test stands inside the join on the masked bits, so that only true links leave it.
    """
    masks = F.array(*[F.lit(m).cast("long") for m in block_masks(max_distance, blocks)])
    keyed = distinct.select("fp", F.posexplode(masks).alias("mask_no", "mask")).select("fp", "mask_no", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    a, b = keyed.alias("a"), keyed.alias("b")
    near = F.expr(f"a.mask_no = b.mask_no AND a.key = b.key AND a.fp < b.fp AND bit_count(a.fp ^ b.fp) <= {max_distance}")
    return a.join(b, near).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_distance: int = 3, blocks: int = 6) -> DataFrame:
    """(id_col, fp, component_id, n_links): near-duplicate classes of all rows.

    Copies share a fingerprint and meet in an aggregation, never as pairs; only distinct fingerprints are joined. component_id is
    the least id reachable over links of max_distance or fewer bits; n_links counts the linked other fingerprints. Null ids keep
    their row and never name a component unless all its ids are null. Repeated rows stay repeated. An empty table gives none.
    """
    spark = df.sparkSession
    path = shared_dir(spark, "simhash")
    rows = cut(fingerprints(df, id_col, text_col, shingle), f"{path}/fp")
    distinct = rows.groupBy("fp").agg(F.min(id_col).alias("least_id"))
    links = cut(close_pairs(distinct.select("fp"), max_distance, blocks).distinct(), f"{path}/links")
    roots = connected_components(links)
    degree = links.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    named = distinct.join(roots, distinct.fp == roots.node, "left").join(degree, "node", "left")
    named = named.select("fp", "least_id", F.coalesce("root", "fp").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of = named.join(least, "root").select("fp", "component_id", "n_links")
    return rows.join(of, "fp").select(id_col, "fp", "component_id", "n_links")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", F.col("n_links").cast("long").alias("n_links"))
