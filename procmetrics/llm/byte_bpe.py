"""Byte-level BPE: higher-order functions fold ranked merges over the byte arrays of distinct words (operator 10)."""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procmetrics.llm.common import cut, documents, offsets_of, shared_dir, text_slices, word_shards
from procmetrics.llm.hash_store import HashArrays, edges_of, find, save_arrays, shard_of

BUCKETS = 8192
#: Words of more bytes are merged by a heap: a fold's steps grow with the length, and each touches the whole array.
LONG = 512
#: Shards of the word table for each of common.word_shards; several, so that tasks are of like size.
SPREAD = 4
#: Words that a task remembers as sent; beyond, it forgets them and the shuffle drops what comes twice.
SEEN = 1_000_000
NONE = 2**31 - 1


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file: base64 of the bytes and the rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The ranks as one literal: an array of small maps from a piece's hex to its rank, by crc32 of the hex. Its size is the vocabulary's."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        name = piece.hex().upper()
        buckets[zlib.crc32(name.encode()) % BUCKETS][name] = rank
    return F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<map<string,int>>")


def _with(value: Column, then) -> Column:
    """then(value) with value evaluated once; a lambda's argument is the only local name that expressions have."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def encode_words(word: Column, ranks: dict[bytes, int]) -> Column:
    """Ids (array of int) of a binary column of words, each one piece of text between splits.

    The state is the array of pieces, at first single bytes, and the rank of each adjacent pair. Each step joins the pair of least rank,
    the leftmost of equals, and looks up the two pairs that this makes. A word of n bytes folds n - 1 steps; once nothing merges,
    the rest pass the state on. An empty word has no ids.
    """
    table = rank_map(ranks)
    rank = lambda piece: _with(F.hex(piece), lambda name: F.get(table, (F.crc32(name) % BUCKETS).cast("int"))[name])
    pair_rank = lambda a, b: F.coalesce(rank(F.concat(a, b)), F.lit(NONE))
    n = F.octet_length(word)
    bytes_ = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(word, i, F.lit(1)))
    start = _with(bytes_, lambda p: F.struct(p.alias("p"), F.transform(F.slice(p, 1, F.size(p) - 1), lambda x, i: pair_rank(x, F.get(p, i + 1))).alias("r")))

    def join(p: Column, r: Column, at: Column) -> Column:
        """The pieces and ranks after the pieces at places at and at + 1 (from 1) are joined."""
        joined = F.concat(F.get(p, at - 1), F.get(p, at))
        empty = F.array().cast("array<int>")

        def renewed(piece: Column) -> Column:
            left = F.when(at > 1, F.array(pair_rank(F.get(p, at - 2), piece))).otherwise(empty)
            right = F.when(at + 1 < F.size(p), F.array(pair_rank(piece, F.get(p, at + 1)))).otherwise(empty)
            pieces = F.concat(F.slice(p, F.lit(1), at - 1), F.array(piece), F.slice(p, at + 2, F.size(p)))
            return F.struct(pieces.alias("p"), F.concat(F.slice(r, F.lit(1), F.greatest(at - 2, F.lit(0))), left, right, F.slice(r, at + 2, F.size(p))).alias("r"))

        return _with(joined, renewed)

    def step(state: Column, _: Column) -> Column:
        p, r = state["p"], state["r"]
        least = F.array_min(r)
        return F.when(F.coalesce(least, F.lit(NONE)) == NONE, state).otherwise(_with(F.array_position(r, least).cast("int"), lambda at: join(p, r, at)))

    folded = F.aggregate(F.sequence(F.lit(2), n), start, step)
    ids = F.transform(folded["p"], rank)
    return F.when(n == 0, F.array().cast("array<int>")).when(n == 1, F.array(rank(word))).otherwise(ids)


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for one long word: pairs wait in a heap by rank and place, and pieces are a linked list."""
    n = len(word)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (rank := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[i], end[j]))

    for i in range(n - 1):
        offer(i)
    alive = [True] * n
    while heap:
        _, i, middle, stop = heapq.heappop(heap)
        if not alive[i] or end[i] != middle or after[i] >= n or end[after[i]] != stop:
            continue
        j = after[i]
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Splitter:
    """The words of a text by a split pattern of letters, numbers, others and white space, as in public_tokenizers.PATTERN.

    Texts up to U+017F take the same pattern with their letters and numbers written out, for the quicker standard module.
    """

    _LETTER, _NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾"
    _WIDE = re.compile(r"[^\x00-\x1b\x20-ſ]")
    _SPACE = "\\t-\\r \x85\xa0"

    def __init__(self, pattern: str):
        fixed = pattern.replace(r"\p{L}", self._LETTER).replace(r"\p{N}", self._NUMBER).replace(r"[^\s", f"[^{self._SPACE}").replace(r"\s", f"[{self._SPACE}]").replace(r"\S", f"[^{self._SPACE}]")
        for kind in ("L", "N"):  # outside brackets the classes need their own
            letters = self._LETTER if kind == "L" else self._NUMBER
            fixed = fixed.replace(f" ?{letters}+", f" ?[{letters}]+")
        self._plain = re.compile(fixed)
        wide = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self._full = regex.compile(wide)

    def __call__(self, text: str) -> list[str]:
        return (self._full if self._WIDE.search(text) else self._plain).findall(text)


def _word_batch(split: Splitter, texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
    words, counts = [], []
    for text in texts:
        found = split(text)
        words += found
        counts.append(len(found))
    return pa.array(words, pa.string()).dictionary_encode(), np.array(counts, np.int64)


class HashClash(ValueError):
    """Two words share a 64-bit key under the seed in use."""


def _keys(words: list[bytes], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of hash for each word: the key by which it is found, and the check that it is the one."""
    digest = xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join(digest(w, seed) for w in words), ">u8").reshape(-1, 2).astype(np.uint64)
    return both[:, 0].copy(), both[:, 1].copy()


def distinct_words(df: DataFrame, pattern: str, shards: int, text_col: str = "text", seed: int = 0) -> DataFrame:
    """(shard, key, word) of the texts, each word once: first within its task, by the word itself, then by a shuffle on its shard."""

    def run(batches):
        split, seen = Splitter(pattern), set()
        for part in text_slices(batches, "text"):
            coded, _ = _word_batch(split, [t or "" for t in part.column("text").to_pylist()])
            fresh = [w for w in coded.dictionary.cast(pa.binary()).to_pylist() if w not in seen]
            if len(seen) + len(fresh) > SEEN:
                seen.clear()
            seen.update(fresh)
            keys, _ = _keys(fresh, seed)
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(keys, shards), pa.int32()), pa.array(keys.view(np.int64)), pa.array(fresh, pa.binary())], names=["shard", "key", "word"])

    rows = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "shard int, key long, word binary")
    return rows.repartition("shard").dropDuplicates(["shard", "key", "word"])


def build_words(df: DataFrame, ranks: dict[bytes, int], pattern: str, path: str, text_col: str = "text", seed: int = 0) -> Words:
    """Encodes every distinct word of df once and writes the sorted arrays of their ids below path.

    Words of up to LONG bytes are folded in Spark, longer ones merged by a heap. Where two words share a key, the table is built
    again under the next seed. An empty table gives a table without words.
    """
    shards = SPREAD * word_shards(df)
    folded = F.when(F.octet_length("word") <= LONG, encode_words(F.col("word"), ranks))
    coded = distinct_words(df, pattern, shards, text_col, seed).select("shard", "key", "word", folded.alias("ids"))
    kind = np.uint16 if max(ranks.values(), default=0) < 1 << 16 else np.uint32

    def save(key, table):
        shard = key[0].as_py()
        table = table.combine_chunks()
        keys = table["key"].to_numpy().view(np.uint64)
        rows = np.argsort(keys)
        keys = keys[rows]
        size = -1 if len(rows) > 1 and (keys[1:] == keys[:-1]).any() else len(rows)
        table = table.take(pa.array(rows))
        words, lists = table["word"].to_pylist(), pa.concat_arrays(table["ids"].chunks) if table["ids"].num_chunks else pa.array([], pa.list_(pa.int32()))
        if lists.null_count:
            lists = pa.array([merge_long(w, ranks) if i is None else i for w, i in zip(words, lists.to_pylist(), strict=True)], pa.list_(pa.int32()))
        ends, ids = offsets_of(np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy().astype(kind)
        save_arrays(path, str(shard), {"key": keys, "check": _keys(words, seed)[1], "start": ends.astype(np.uint32 if ends[-1] < 1 << 32 else np.uint64), "ids": ids})
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([size], pa.int64())})

    sizes = {r["shard"]: r["n"] for r in cut(coded.groupBy("shard").applyInArrow(save, "shard int, n long"), f"{path}-sizes").collect()}
    if any(n < 0 for n in sizes.values()):
        return build_words(df, ranks, pattern, f"{path}-{seed + 1}", text_col, seed + 1)
    return Words(path, [sizes.get(k, 0) for k in range(shards)], pattern, seed)


@dataclass
class Words:
    """What a worker needs to open the word table."""

    path: str
    sizes: list[int]
    pattern: str
    seed: int


class WordIds:
    """Encodes texts by looking their words up in the mapped arrays."""

    def __init__(self, words: Words):
        self.split, self.shards, self.seed = Splitter(words.pattern), HashArrays(words.path, words.sizes), words.seed

    def _ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another in a table; begin and size of each word's."""
        keys, checks = _keys(words, self.seed)
        order = np.argsort(keys)
        edge = edges_of(keys[order], len(self.shards))
        begin, size, tables, at = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), [np.array([], np.int32)], 0
        for k in np.flatnonzero(np.diff(edge)):
            mine, shard = order[edge[k] : edge[k + 1]], self.shards[k]
            row, there = find(shard["key"], keys[mine]) if shard else (mine, np.zeros(len(mine), bool))
            if not there.all() or (shard["check"][row] != checks[mine]).any():
                raise ValueError("a word is missing from the word table; it must be built from the same texts")
            start = shard["start"][row].astype(np.int64)
            n = shard["start"][row + 1].astype(np.int64) - start
            ends = offsets_of(n)
            tables.append(shard["ids"][np.arange(ends[-1]) + np.repeat(start - ends[:-1], n)].astype(np.int32))
            begin[mine], size[mine] = at + ends[:-1], n
            at += ends[-1]
        return np.concatenate(tables), np.stack([begin, size])

    def encode(self, texts: list[str]) -> pa.ListArray:
        coded, counts = _word_batch(self.split, texts)
        table, (begin, size) = self._ids(coded.dictionary.cast(pa.binary()).to_pylist())
        codes = coded.indices.to_numpy()
        each = size[codes]
        ends = offsets_of(each)
        ids = table[np.arange(ends[-1]) + np.repeat(begin[codes] - ends[:-1], each)]
        return pa.ListArray.from_arrays(pa.array(ends[offsets_of(counts)].astype(np.int32)), pa.array(ids, pa.int32()))


def encode(df: DataFrame, words: Words, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) of every row, by the word table. Null texts count as empty and have no ids; repeated rows stay repeated; an empty table gives none."""

    def run(batches):
        table = WordIds(words)
        for part in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("id"), table.encode([t or "" for t in part.column("text").to_pylist()])], names=["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(ids: list[int], pieces: list[bytes]) -> bytes:
    return b"".join(map(pieces.__getitem__, ids))


def digests(df: DataFrame, words: Words, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) of every row: encoded by the word table, then decoded from the ids alone.

    Null texts count as empty and have no ids. Repeated rows stay repeated; an empty table gives an empty result.
    """

    def run(batches):
        table = WordIds(words)
        pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece
        decimals = [str(k) for k in range(len(pieces))]
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for part in text_slices(batches, "text"):
            lists = table.encode([t or "" for t in part.column("text").to_pylist()])
            edge, flat = lists.offsets.to_pylist(), lists.values.to_numpy().tolist()
            all_ids = [flat[a:b] for a, b in zip(edge, edge[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(np.diff(edge).astype(np.int64)), pa.array([sha(" ".join(map(decimals.__getitem__, i)).encode()) for i in all_ids]), pa.array([sha(decode(i, pieces)) for i in all_ids])],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with the 50k byte-level ranks and decoded again."""
    import public_tokenizers

    docs, ranks = documents(spark, sf_dir), load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    words = build_words(docs, ranks, public_tokenizers.PATTERN, f"{shared_dir(spark, 'byte-bpe')}/words")
    return digests(docs, words, ranks)
