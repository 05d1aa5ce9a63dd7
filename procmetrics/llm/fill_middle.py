"""Fill-in-the-middle transformation with content-defined chunk memoization (operator 13).

A text is cut where a rolling hash of its bytes says so, so equal passages give equal chunks wherever they stand. Of each distinct chunk a
worker keeps a summary: how many words begin in it, how many code points it has, and whether it begins and ends inside a word. Summaries
combine: where one chunk ends inside a word and the next begins inside one, the two share that word. From the combined counts follows the
chunk in which a cut lies, and only that one is searched.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Sequence
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procmetrics.llm.common import documents, text_slices
from procmetrics.llm.token_store import cut_points

#: Of chunks whose summaries a worker keeps: two generations of so many bytes at most.
CACHE_BYTES = 16 << 20
_SPACES = frozenset(b" \t\n\v\f\r")
_CONTINUED = bytes(range(0x80, 0xC0))  # UTF-8 bytes that don't begin a code point
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SENTINELS = (b"<P>", b"<S>", b"<M>")


def _summary(chunk: bytes) -> tuple[int, int, bool, bool]:
    """Words, code points, and whether the chunk begins and ends inside a word."""
    return len(chunk.split()), len(chunk.translate(None, _CONTINUED)), chunk[0] not in _SPACES, chunk[-1] not in _SPACES


class Summaries:
    """Summaries by content. Chunks are compared whole, so two that share a hash never share a summary."""

    def __init__(self, max_bytes: int = CACHE_BYTES):
        self.max_bytes, self.held, self.made = max_bytes, 0, 0
        self.young: dict[bytes, tuple] = {}
        self.old: dict[bytes, tuple] = {}

    def of(self, chunk: bytes) -> tuple[int, int, bool, bool]:
        found = self.young.get(chunk)
        if found is None:
            found = self.old.get(chunk)
            if found is None:
                found, self.made = _summary(chunk), self.made + 1
            if self.held > self.max_bytes:
                self.old, self.young, self.held = self.young, {}, 0
            self.young[chunk] = found
            self.held += len(chunk)
        return found


class Cuts:
    """The units of one text, counted from the summaries of its chunks. A unit is a word with the white space before it; white space at the end is one more."""

    def __init__(self, text: bytes, summaries: Summaries):
        ends = cut_points(np.frombuffer(text, np.uint8)).tolist() if text else []
        self.chunks = [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        found = [summaries.of(c) for c in self.chunks]
        self.joined = [k > 0 and found[k - 1][3] and found[k][2] for k in range(len(found))]
        self.words = list(accumulate((f[0] - j for f, j in zip(found, self.joined, strict=True)), initial=0))
        self.bytes = [0, *ends]
        self.chars = list(accumulate((f[1] for f in found), initial=0))
        self.heads = [f[2] for f in found]
        self.n = self.words[-1] + bool(found and not found[-1][3])

    def end_of(self, unit: int) -> tuple[int, int]:
        """Where the unit ends, counted from 1: in bytes, in code points. Unit 0 ends at the beginning."""
        if unit == 0:
            return 0, 0
        if unit > self.words[-1]:
            return self.bytes[-1], self.chars[-1]
        k = bisect_left(self.words, unit, 1) - 1  # the chunk in which the word begins
        local = unit - self.words[k] + self.joined[k]
        at = next(islice(_WORD.finditer(self.chunks[k]), local - 1, None)).end()
        while at == len(self.chunks[k]) and k + 1 < len(self.chunks) and self.heads[k + 1]:  # the word goes on in the next chunk
            k += 1
            at = _WORD.match(self.chunks[k]).end()
        return self.bytes[k] + at, self.chars[k] + len(self.chunks[k][:at].translate(None, _CONTINUED))


def _draws(doc_id, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def rearrange(text: bytes, doc_id, summaries: Summaries, rate: int = 50, spm: int = 80, seed: int = 42) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, code points of prefix and middle, and the output of one text."""
    cuts, (h1, h2, h3, h4) = Cuts(text, summaries), _draws(doc_id, seed)
    if not text or any(s in text for s in SENTINELS) or h3 % 100 >= rate:
        return cuts.n, "plain", None, None, text
    low, high = sorted((h1 % (cuts.n + 1), h2 % (cuts.n + 1)))
    (a, a_chars), (b, b_chars) = cuts.end_of(low), cuts.end_of(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return cuts.n, "spm", a_chars, b_chars - a_chars, b"".join((b"<S>", suffix, b"<P>", prefix, b"<M>", middle))
    return cuts.n, "psm", a_chars, b_chars - a_chars, b"".join((b"<P>", prefix, b"<S>", suffix, b"<M>", middle))


def fill_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 50, spm: int = 80, seed: int = 42) -> DataFrame:
    """(id_col, n, form, prefix_chars, middle_chars, output) for every row; form is plain, psm or spm.

    rate and spm are percentages: of texts rearranged, and of those in the order suffix, prefix, middle. Draws depend on the id alone, so equal
    ids are cut alike in units; a null id draws as an empty one. Null and empty texts, and texts that hold a sentinel, are plain. Repeated
    rows stay repeated; very long texts are taken whole, one at a time. Other columns are not read. An empty table gives none. Nothing is
    shuffled.
    """

    def run(batches):
        summaries = Summaries()
        for part in text_slices(batches, "text"):
            texts: Sequence[bytes | None] = part.column("text").cast(pa.binary()).to_pylist()
            rows = [rearrange(t or b"", i, summaries, rate, spm, seed) for t, i in zip(texts, part.column("id").to_pylist(), strict=True)]
            n, form, prefix, middle, output = zip(*rows, strict=True) if rows else [()] * 5
            columns = [part.column("id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("id", id_col)


def restore(output: str | Column, form: str | Column) -> Column:
    """The text from output and form. A rearranged text holds no sentinel of its own, so the three part it."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    part = lambda k: F.get(F.split(output, "<[PSM]>"), k)
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rearranged, and rebuilt from its output."""
    made = fill_middle(documents(spark, sf_dir))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore("output", "form"), 256).alias("restored_sha256"))


# Doubles here, since that is what data frames of pandas make of whole numbers and nulls.
_SPACE, _TEXT = r"\x20\x09-\x0D", r"[^\x20\x09-\x0D]"
ORACLE = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[{_SPACE}]*{_TEXT}+|[{_SPACE}]+') AS units, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT *, len(units) AS n, [CAST('0x' || substr(x, 8 * k + 1, 8) AS BIGINT) FOR k IN [0, 1, 2, 3]] AS h FROM t),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS low, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS high,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, coalesce(array_to_string(units[1:low], ''), '') AS a, coalesce(array_to_string(units[low + 1:high], ''), '') AS b, coalesce(array_to_string(units[high + 1:], ''), '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a)::DOUBLE END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b)::DOUBLE END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
