"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procmetrics.sources.stored import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, which all executors share. Only a local session, as in tests, may do without that setting."""
    return shared_folder(spark, name)


def cut(df: DataFrame, path: str, compression: str = "zstd") -> DataFrame:
    """Writes df below the shared folder and reads it again, so that no later stage depends on executors' disks."""
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, path: str, keep: tuple[str, ...] = ()) -> None:
    """Deletes what a call has written below a path of its own, but for the tables named, on which its result rests."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in files.listStatus(folder) if files.exists(folder) else ():
        if found.getPath().getName() not in keep:
            files.delete(found.getPath(), True)


#: Bytes of input for each shard of a table of distinct words, which are far fewer bytes.
SHARD_BYTES = 1 << 30


def word_shards(df: DataFrame) -> int:
    """Into how many shards df's distinct words go: as many as shuffles have partitions, and more as the input grows, so that a task's shard doesn't.

    The input's size is the optimizer's estimate; where that is unknown it isn't counted.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // SHARD_BYTES if size < 1 << 60 else 0)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Texts of ASCII alone take the quick built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; null ids give null."""
    return F.crc32(doc_id.cast("string")) % n


def trim() -> None:
    """Gives back to the system what earlier tasks of this worker have freed; a worker that serves many stages would otherwise keep the most of each."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc have no such call
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """What is run inside goes to Python so many rows at a time: whole texts in batches of Spark's default size fill JVM and worker by hundreds of MB. The session's own setting is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about max_bytes of text each, one row at least."""
    trim()
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of the texts, A-Z lower-cased, in order; and the number of words of each text."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = parts.flatten()
    full = pc.not_equal(pc.binary_length(words), 0)
    ends = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    return words.filter(full), np.diff(ends[offsets])


def offsets_of(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def sql_crc32(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text's UTF-8 bytes, byte by byte and bit by bit."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    shifts = "list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda a, b: {shifts}), 4294967295)"
