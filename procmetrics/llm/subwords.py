"""Hashed character n-grams of words as arrays, and bounded samples of labelled texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procmetrics.llm.common import cut, shared_dir

#: The bound of a training sample's texts, in bytes.
MAX_BYTES = 256 << 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def word_ngrams(words: pa.Array, sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every byte n-gram of <word>, with the edge marks: so n-grams at an edge are affixes. Not ordered by word."""
    marked = [b"<%b>" % w for w in words.cast(pa.binary()).to_pylist()]
    text = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    word = np.repeat(np.arange(len(marked), dtype=np.int32), lengths)
    room = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(text))
    rolled = np.zeros(len(text), np.uint64)
    of_word, of_bucket = [], []
    for n in range(1, max(sizes) + 1):
        if n > len(text):
            break
        rolled = rolled[: len(text) - n + 1] * _FACTOR + text[n - 1 :] + np.uint64(n)
        if n in sizes:
            fits = np.flatnonzero(room[: len(rolled)] >= n)
            mixed = rolled[fits]
            mixed = (mixed ^ (mixed >> np.uint64(31))) * _FACTOR
            of_word.append(word[fits])
            of_bucket.append(((mixed >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32))
    if not of_word:
        return np.array([], np.int32), np.array([], np.int32)
    return np.concatenate(of_word), np.concatenate(of_bucket)


def mean_over_ngrams(word: np.ndarray, values: np.ndarray, n_words: int) -> np.ndarray:
    """The mean of the n-grams' values for each word; 0 for words without any."""
    counts = np.bincount(word, minlength=n_words)
    return np.bincount(word, weights=values, minlength=n_words) / np.maximum(counts, 1)


def labelled_sample(labels: DataFrame, docs: DataFrame, id_col: str, text_col: str, label_col: str, per_label: int, max_bytes: int = MAX_BYTES) -> list[tuple[str, object]]:
    """At most per_label (text, label) for each non-null label of labels, the rows of least hashed id; whole texts from docs.

    Labels are first counted; only ids whose hash lies below twice the share that is wanted are ranked, so a label of many rows never
    meets in one task. The chosen ids, at most per_label for each label, are the broadcast side of the join that fetches texts. All
    labels together take max_bytes of text at most: of each, texts in the order of their hashes while its part of that lasts.
    """
    ids = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("chosen_id"), F.col(label_col).alias("chosen_label")).distinct()
    ids = ids.withColumn("at", F.shiftrightunsigned(F.xxhash64("chosen_id"), 11) / F.lit(2.0**53))
    counts = {r["chosen_label"]: r["n"] for r in ids.groupBy("chosen_label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for label, n in counts.items() for x in (label, min(1.0, (2.0 * per_label + 100) / n))])
    order = Window.partitionBy("chosen_label").orderBy("at", "chosen_id")
    chosen = ids.where(F.col("at") < share[F.col("chosen_label")]).withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_label)
    texts = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).cast("string").alias("own_text"))
    found = texts.join(F.broadcast(chosen), F.col("own_id") == F.col("chosen_id")).dropDuplicates(["own_id", "chosen_label"])
    found = cut(found.select("own_id", "own_text", "chosen_label", "place", F.coalesce(F.octet_length("own_text"), F.lit(0)).alias("bytes")), shared_dir(docs.sparkSession, "sample"))
    left, taken = dict.fromkeys(counts, max_bytes // len(counts)), {}
    for r in sorted(found.select("chosen_label", "place", "bytes").collect(), key=lambda r: (str(r["chosen_label"]), r["place"])):
        left[r["chosen_label"]] -= r["bytes"]
        if left[r["chosen_label"]] >= 0:
            taken[r["chosen_label"]] = r["place"]
    if not taken:
        return []
    last = F.create_map(*[F.lit(x) for pair in taken.items() for x in pair])
    rows = found.where(F.col("place") <= F.try_element_at(last, F.col("chosen_label"))).select("own_id", "own_text", "chosen_label")
    return [(r["own_text"] or "", r["chosen_label"]) for r in rows.orderBy("own_id", "chosen_label").collect()]
