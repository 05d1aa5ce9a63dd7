"""Stored tables: folders that all executors share, updates in place, and tables laid out by process."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procmetrics.model import PROCESS, SERIES
from procmetrics.operators.ranking import latest_by
from procmetrics.operators.transforms import small


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, which all executors share. Only a local session may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set, and executors share no other folder")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def merge_updates(
    spark: SparkSession, path: str, updates: DataFrame, partition: str, keys: Sequence[str] = ("id",), columns: Sequence[str] = ("status",), order: Sequence[str] = ("updated_at", "seq")
) -> list:
    """Takes updates into the stored table at path, and returns the partitions rewritten.

    Of the updates of a key the newest counts, and only if it is newer than the row; it sets columns and order, which the table has. Of updates
    of one order, and of an update and a row of one order, that of the greatest columns counts, so neither the order of rows nor the
    way in which updates are parted into runs matters. An update of an absent key is left out, as is one without a key. Copy on write: keys and order alone tell which partitions are touched, and
    these are read, written aside and put in place as wholes; other partitions' files stay as they are. So a run that fails is run
    again, and a second run with the same updates finds nothing newer and writes nothing. Rows that repeat a key are all updated.
    """
    table = spark.read.parquet(path)
    aside = shared_folder(spark, "merge")
    named = lambda c: F.col(c).alias(f"_new_{c}")
    newest = latest_by(updates.select(*keys, *columns, *order).dropna(subset=list(keys)), keys, [*order, *columns])
    newest.select(*keys, *[named(c) for c in (*columns, *order)]).write.parquet(f"{aside}/newest")
    newest = small(spark.read.parquet(f"{aside}/newest"))
    # a row without a time is older than any update, and an update without one is never newer
    timed = F.struct(*[f"_new_{c}" for c in order]) > F.struct(*[F.lit(None).cast(table.schema[c].dataType).alias(c) for c in order])
    newer = timed & (F.struct(*[f"_new_{c}" for c in (*order, *columns)]) > F.struct(*order, *columns))
    hit = table.select(partition, *dict.fromkeys([*keys, *columns, *order])).join(newest, list(keys)).where(newer)
    touched = [r[0] for r in hit.select(partition).distinct().collect()]  # a row for each partition at most
    if not touched:
        return []
    present = [p for p in touched if p is not None]
    where = F.col(partition).isin(present) if present else F.lit(False)
    rows = table.where(where | F.col(partition).isNull() if len(present) < len(touched) else where).join(newest, list(keys), "left")
    fresh = F.coalesce(newer, F.lit(False))
    merged = rows.select(*[F.when(fresh, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in (*columns, *order) else F.col(c) for c in table.columns])
    merged.write.partitionBy(partition).parquet(f"{aside}/rows")
    staged = spark.read.schema(table.schema).parquet(f"{aside}/rows")
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    return touched


def write_by_process(df: DataFrame, name: str, path: str, buckets: int = 64, mode: str = "overwrite") -> DataFrame:
    """Writes datapoints as table name at path, in buckets by process, each in order of its series; and reads it.

    Whatever groups or orders by process or series afterwards needs no shuffle: deltas, rates, memory look-ups, distinct series. One task
    writes each bucket, so there are as many files as buckets; a bucket should be a few hundred MB, some 10,000 buckets for a few TB.
    """
    order = [c for c in (*SERIES, "ts") if c in df.columns]
    df.repartition(buckets, *PROCESS).write.mode(mode).format("parquet").bucketBy(buckets, *PROCESS).sortBy(*order).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)
