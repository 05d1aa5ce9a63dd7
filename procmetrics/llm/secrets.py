"""Secret scans with an incremental ledger of content-addressed blobs (operator 1)."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procmetrics.llm.common import cut, documents, shared_dir, small_batches, text_slices
from procmetrics.operators.transforms import small

VERSION = "rules-1"
#: Addresses of new blobs up to this size are sent to all executors, which then fetch those texts only.
FEW_BYTES = 1 << 20
#: Kinds in the order in which equal starts are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "pem", "jwt")
_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # [0-9a-f]+ takes whole runs, so this finds its matches of 24 and more
_PEM = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")
_JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

FINDINGS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("rank", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def find_secrets(text: str) -> list[dict]:
    """Spans of one text by start, then kind; code points, end exclusive. A plain substring test first spares most texts the slow pattern."""
    found = []
    low = text.lower()
    if any(word in low for word in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if "-----BEGIN " in text:
        found += [(m.start(), 3, m.end()) for m in _PEM.finditer(text)]
    if "eyJ" in text:
        found += [(m.start(), 4, m.end()) for m in _JWT.finditer(text)]
    return [{"start": s, "rank": r, "end": e} for s, r, e in sorted(found)]


def blob_ids(df: DataFrame, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(path, blob): the SHA-256 address of every version of every path; null texts count as empty."""
    return df.select(F.col(path_col).alias("path"), F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)).alias("blob"))


def _bodies(df: DataFrame, text_col: str) -> DataFrame:
    """(blob, body): compressed texts, each once per task at least while it is remembered; the shuffle removes the rest."""

    def run(batches):
        packer, seen = zstandard.ZstdCompressor(level=1), set()
        for part in text_slices(batches, "text"):
            ids, bodies = [], []
            for text in part.column("text").cast(pa.binary()).to_pylist():
                blob = hashlib.sha256(text or b"").digest()
                if blob not in seen:
                    if len(seen) >= 500_000:
                        seen.clear()
                    seen.add(blob)
                    ids.append(blob)
                    bodies.append(packer.compress(text or b""))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(bodies, pa.binary())], names=["blob", "body"])

    return df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "blob binary, body binary")


def _scan(bodies: DataFrame) -> DataFrame:
    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        kind = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                found = [find_secrets(unpack(body).decode("utf-8", "replace")) for body in part.column("body").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("blob"), pa.array(found, kind)], names=["blob", "findings"])

    return bodies.mapInArrow(run, T.StructType([T.StructField("blob", T.BinaryType()), T.StructField("findings", FINDINGS)]))


def open_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """(blob, findings, rule_version) scanned so far; an empty table for a new ledger."""
    schema = T.StructType([T.StructField("blob", T.BinaryType()), T.StructField("findings", FINDINGS), T.StructField("rule_version", T.StringType())])
    try:
        return spark.read.schema(schema).parquet(ledger)
    except Exception as e:  # the path doesn't exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def update_ledger(df: DataFrame, ledger: str, version: str = VERSION, text_col: str = "text") -> None:
    """Scans the blobs of df that the ledger lacks under this rule version, once each, and appends what was found (also nothing).

    Addresses alone are held against the ledger. Texts are fetched for new ones only: while these are few, before anything is shuffled.
    An empty table, or one without new blobs, adds no rows.
    """
    spark = df.sparkSession
    known = open_ledger(spark, ledger).where(F.col("rule_version") == version).select("blob")
    if known.isEmpty():
        bodies = _bodies(df, text_col)
    else:
        fresh = cut(blob_ids(df, text_col, text_col).select("blob").distinct().join(known, "blob", "left_anti"), shared_dir(spark, "fresh"))
        few = small(fresh, FEW_BYTES)
        texts = df.select(F.col(text_col).cast("string").alias("text"))
        address = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
        bodies = _bodies(texts.join(few, address == few["blob"], "left_semi"), "text") if few is not fresh else _bodies(texts, "text").join(fresh, "blob", "left_semi")
    fresh_bodies = bodies.groupBy("blob").agg(F.first("body").alias("body"))
    with small_batches(spark):
        _scan(fresh_bodies).withColumn("rule_version", F.lit(version)).write.mode("append").option("compression", "zstd").parquet(ledger)


def scan(df: DataFrame, ledger: str, version: str = VERSION, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(path, blob, findings) for every row of df, which may hold many versions of a path.

    findings are structs of start, rank (place in KINDS) and end. Null and empty texts have none. Repeated rows stay repeated; null
    paths are kept. Other columns are not read. Blobs known to the ledger aren't scanned again.
    """
    update_ledger(df, ledger, version, text_col)
    return _with_findings(blob_ids(df, path_col, text_col), ledger, version).select("path", "blob", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))


def _with_findings(rows: DataFrame, ledger: str, version: str) -> DataFrame:
    """Rows with a blob, beside its findings; null where the ledger has none.

    Only blobs with findings are joined, from a table of their own, so that the rows of a blob of many copies may be split.
    """
    known = open_ledger(rows.sparkSession, ledger).where((F.col("rule_version") == version) & (F.size("findings") > 0))
    hits = cut(known.select("blob", "findings").dropDuplicates(["blob"]), shared_dir(rows.sparkSession, "hits"))
    return rows.join(hits, "blob", "left")


def spans_text(findings: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", F.get(kinds, f["rank"]), f["start"].cast("string"), f["end"].cast("string"))), ",")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, by way of a new ledger."""
    found = scan(documents(spark, sf_dir), f"{shared_dir(spark, 'ledger')}/ledger")
    count = lambda rank: F.size(F.filter("findings", lambda f: f["rank"] == rank)).cast("long")
    base = F.filter("findings", lambda f: f["rank"] < 3)
    return found.select(
        F.col("path").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("findings")).alias("spans")
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by the mark and n_chars, if there, counted anew; documents without secrets are unchanged.

    Overlapping spans are replaced as one. The text is cut at span edges in one pass over its findings. Null texts stay null, empty ones
    empty; repeated rows stay repeated. Rows travel as one struct, so other columns may have any names. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    path = shared_dir(spark, "ledger")
    update_ledger(docs, f"{path}/ledger")
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    keyed = _with_findings(rows.withColumn("blob", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))), f"{path}/ledger", VERSION)
    keyed = keyed.withColumn("spans", F.transform("findings", lambda f: F.struct(f["start"].alias("s"), f["end"].alias("e"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    piece = lambda acc, s: F.struct(
        F.when(s["s"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["s"] - acc["at"]), F.lit(mark))).alias("out"), F.greatest(acc["at"], s["e"]).alias("at")
    )
    folded = F.aggregate("spans", start, piece)
    rest = F.concat(folded["out"], F.substring(F.col("text"), folded["at"] + 1, F.length("text")))
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(rest)
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("spans").isNull(), F.col("row")["n_chars"]).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    return keyed.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


_EITHER = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
_SQL_KINDS = (
    ("assign", f"""({_EITHER})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""", "length(regexp_extract(m, '[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6"),
    ("access", "AKIA[A-Z0-9]+", "length(m) >= 20"),
    ("hex", "[0-9a-f]+", "length(m) >= 24"),
    ("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "true"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "true"),
)


def _sql_spans(rank: int, kind: str, pattern: str, test: str) -> str:
    """Matches of one kind: each begins after what stands before it, the matches before and the parts between them."""
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, s, s + length(m) AS e FROM (SELECT doc_id, m, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s FROM
    (SELECT doc_id, found, parts, unnest(range(1, len(found) + 1)) AS i, unnest(found) AS m FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS found, string_split_regex(t, '{pattern}') AS parts FROM d))) WHERE {test}"""


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({" UNION ALL ".join(_sql_spans(k, *x) for k, x in enumerate(_SQL_KINDS))}),
g AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
      string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM f GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""
