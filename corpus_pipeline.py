"""A corpus cleaned and packed in five stages; part of subpackage llm.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and reread as the next stage's docs. All but
the last give the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from procmetrics.llm import exact_dedup, language_id, near_copies, packing, secrets
from procmetrics.llm.common import cut, documents, shared_dir


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too) go, as no language can be told; texts of several languages stay. Operator 6.

    All stages keep repeated rows (but for the copies that two of them drop), null ids and nulls in other columns, and columns of any name;
    an empty table gives an empty one.
    """
    return language_id.keep_known(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, that of largest id; null texts count as empty. Operator 5."""
    return exact_dedup.drop_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of least id: similarity of five-word shingles 0.8 or more.

    Operator 7's fingerprints and blocks link the closest; what lies further apart comes from shared shingles. Texts without words are one group.
    """
    return near_copies.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced; every document stays, null and empty texts as they are. Operator 1."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A bin for every piece of every document's token sequence; the bins themselves are written beside it. Null texts have their end alone. Operator 9.

    Workers and JVM have served four stages by then, so texts are encoded in smaller slices than the operator takes on its own.
    """
    return packing.packed(docs, 1 << 20)


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", near_stage),
    ("secret scans", secrets_stage),
    ("best-fit packing", packing_stage),
]

#: The language field and the packing can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"{path}/{k}")
    return docs
